"""Queries on sensitive data, the graph of tables, schema patterns, metadata matching and read models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quarrymark.functions import sensitive
from quarrymark.functions import types as kinds
from quarrymark.operators import graph, metadata_match, sensitive_scan, soft_keys, views
from quarrymark.operators.inclusion import Side, all_pairs
from quarrymark.plans.column_queries import QUALITY_SQL, side
from quarrymark.plans.relation_queries import fk_candidates, measured
from quarrymark.sources import exports
from quarrymark.sources.shared import new_folder
from quarrymark.sources.tables import names, table
from quarrymark.streaming.profile import windowed_profile

#: The text columns of the delivered tables, for SQL; queries take them from the schemas.
TEXTS = {
    "applications": ("status",),
    "articles": ("headline", "body",),
    "candidates": ("first_name", "last_name", "email", "phone", "resume_text", "status",),
    "categories": ("name", "slug", "description",),
    "col_inventory": ("column_name", "data_type", "type_class", "min_val", "max_val", "cardinality_method", "physical_type",),
    "customer": ("c_name", "c_mktsegment",),
    "documents": ("text", "lang", "source", "paper_key", "submitter", "main_file",),
    "employees": ("first_name", "last_name", "employee_code", "work_email", "personal_email", "work_phone", "status",),
    "events": ("event_type", "props",),
    "extract_cells": ("cell_value",),
    "key_values": ("key_value",),
    "lineitem": ("l_returnflag", "l_linestatus",),
    "mix_targets": ("source",),
    "nation": ("n_name",),
    "orders": ("o_orderstatus", "o_orderpriority",),
    "part": ("p_name", "p_brand", "p_type",),
    "payroll_entries": ("bank_account_last4", "iban", "routing_number", "currency",),
    "posts": ("title", "body",),
    "region": ("r_name",),
    "relationships": ("cardinality", "evidence",),
    "skill_taxonomy": ("name",),
    "subject_areas": ("subject", "scope_note",),
    "subject_labels": ("subject", "labeller",),
    "supplier": ("s_name",),
    "tbl_inventory": ("schema_name", "table_name", "status", "exclusion_reason", "parquet_path",),
}

# ---- inventory as a graph --------------------------------------------------------


def _columns(spark: SparkSession, d: str) -> DataFrame:
    """The inventoried columns with their table's name."""
    t = table(spark, d, "tbl_inventory").select("table_id", "table_name", "schema_name")
    return table(spark, d, "col_inventory").join(F.broadcast(t), "table_id")  # an inventory of tables


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """The recorded relationships by name."""
    c = _columns(spark, d)
    of = lambda s: c.select(F.col("column_id").alias(f"{s}_col_id"), F.col("table_name").alias(f"{s}_table"), F.col("column_name").alias(f"{s}_column"))
    return table(spark, d, "relationships").join(of("child"), "child_col_id").join(of("parent"), "parent_col_id")


_NAMED_SQL = """
WITH c AS (SELECT i.*, t.table_name, t.schema_name FROM col_inventory i JOIN tbl_inventory t USING (table_id)),
r AS (SELECT r.*, a.table_name AS child_table, a.column_name AS child_column, b.table_name AS parent_table, b.column_name AS parent_column FROM relationships r JOIN c a ON a.column_id = child_col_id JOIN c b ON b.column_id = parent_col_id)
"""


def _priors(spark: SparkSession, d: str) -> DataFrame:
    """table_name, column_name, pii_type, score: what the inventoried columns' names imply."""
    kind, strength = sensitive_scan.prior_columns(F.col("column_name"))
    return _columns(spark, d).select("table_name", "column_name", kind.alias("pii_type"), strength.alias("score")).where("pii_type is not null")


def name_priors(spark: SparkSession, d: str) -> DataFrame:
    return _priors(spark, d)


def _prior_sql() -> str:
    whens = " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{k}'" for p, k in sensitive.PRIORS)
    whole = " ".join(f"WHEN regexp_matches(n, '{p}') THEN CASE WHEN regexp_extract(n, '{p}') = n THEN 0.85 ELSE 0.5 END" for p, k in sensitive.PRIORS)
    return f"SELECT table_name, column_name, CASE {whens} END AS pii_type, (CASE {whole} END)::DOUBLE AS score FROM (SELECT *, replace(lower(column_name), '_', ' ') AS n FROM c)"


NAME_PRIORS_SQL = _NAMED_SQL + f"SELECT * FROM ({_prior_sql()}) WHERE pii_type IS NOT NULL"


def table_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.table_edges(_edges(spark, d), _priors(spark, d))


_EDGES_SQL = _NAMED_SQL + f""", p AS (SELECT DISTINCT table_name, pii_type FROM ({_prior_sql()}) WHERE pii_type IS NOT NULL),
w AS (SELECT parent_table, child_table, cardinality, sum(confidence * CASE WHEN cardinality = 'MANY_TO_MANY' THEN 0.3 ELSE 1.0 END + 0.15 + CASE WHEN EXISTS (SELECT 1 FROM p x JOIN p y USING (pii_type) WHERE x.table_name = child_table AND y.table_name = parent_table) THEN 0.1 ELSE 0.0 END) AS w
  FROM r WHERE confidence >= 0 AND child_table <> parent_table GROUP BY ALL),
e AS (SELECT parent_table AS parent, child_table AS child, round(sum(w), 6) AS weight, arg_max(cardinality, (w, cardinality)) AS cardinality FROM w GROUP BY ALL)
"""


def _tables(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tbl_inventory").select("table_name", F.coalesce("row_count_estimate", F.lit(0)).alias("row_count"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    cols = _columns(spark, d).select("table_name", "column_name", F.coalesce("is_pk", F.lit(False)).alias("is_key"), "data_type", F.col("is_pk"))
    return views.foreign_columns(cols, _edges(spark, d))


def archetypes(spark: SparkSession, d: str) -> DataFrame:
    return graph.archetypes(_tables(spark, d), _marked(spark, d), table_edges(spark, d))


ARCHETYPES_SQL = _EDGES_SQL + """
, o AS (SELECT child AS table_name, count(*) AS n_out, count(*) FILTER (cardinality = 'MANY_TO_ONE') AS n_mto, bool_and(coalesce(cardinality IN ('MANY_TO_ONE', 'ONE_TO_ONE'), false)) AS joins_only FROM e GROUP BY 1),
i AS (SELECT parent AS table_name, count(*) AS n_in FROM e GROUP BY 1),
k AS (SELECT table_name, count(*) AS n_cols, bool_or(coalesce(is_pk, false)) AS has_key, count(*) FILTER (NOT coalesce(is_pk, false) AND NOT EXISTS (SELECT 1 FROM r WHERE child_table = table_name AND child_column = column_name)
  AND NOT regexp_matches(lower(column_name), '^(created_at|updated_at|created_by|updated_by|deleted_at|created_on|updated_on|last_update|last_updated|last_modified|version|row_version|etl_loaded_at)$')) AS n_plain FROM c GROUP BY 1),
s AS (SELECT quantile_cont(row_count_estimate, 0.75) AS q3, list_sort(list(row_count_estimate))[count(*) // 2 + 1] AS median FROM tbl_inventory WHERE row_count_estimate > 0),
t AS (SELECT table_name, coalesce(row_count_estimate, 0) AS rc, coalesce(n_out, 0) AS n_out, coalesce(n_mto, 0) AS n_mto, joins_only, coalesce(n_in, 0) AS n_in, coalesce(n_cols, 0) AS n_cols, has_key, coalesce(n_plain, 0) AS n_plain, q3, median,
  regexp_matches(lower(table_name), 'audit|history|log|change|event') AND coalesce(n_in, 0) >= 1 AS audit FROM tbl_inventory LEFT JOIN o USING (table_name) LEFT JOIN i USING (table_name) LEFT JOIN k USING (table_name) CROSS JOIN s)
SELECT table_name, CASE WHEN rc = 0 THEN 'EMPTY' WHEN n_cols <= 4 AND n_out >= 2 AND joins_only AND has_key AND n_plain = 0 THEN 'JUNCTION' WHEN rc < 100 AND n_in >= 3 AND n_out <= 1 THEN 'LOOKUP' WHEN rc >= q3 AND n_mto >= 3 THEN 'FACT'
  WHEN rc < q3 AND n_in >= 1 AND n_out <= 2 AND rc >= median / 4 AND audit THEN 'AUDIT' WHEN rc < q3 AND n_in >= 1 AND n_out <= 2 AND rc >= median / 4 THEN 'DIMENSION' WHEN audit THEN 'AUDIT' WHEN rc >= median THEN 'FACT' ELSE 'DIMENSION' END AS archetype FROM t
"""


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return graph.clusters(_tables(spark, d), table_edges(spark, d), archetypes(spark, d), "inventory")


def _by_schema(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tbl_inventory").select("table_name", F.col("schema_name").alias("cluster_id"))


def schema_modularity(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the division by schema name."""
    return graph.modularity(table_edges(spark, d), _by_schema(spark, d)).withColumnRenamed("cluster_id", "schema_name")


MODULARITY_SQL = _EDGES_SQL + """
, x AS (SELECT e.weight AS w, a.schema_name AS p, b.schema_name AS q FROM e JOIN tbl_inventory a ON a.table_name = parent JOIN tbl_inventory b ON b.table_name = child), m AS (SELECT sum(w) AS m FROM x),
y AS (SELECT p AS schema_name, w, p = q AS inner_edge FROM x UNION ALL SELECT q, w, false FROM x)
SELECT schema_name, round(sum(CASE WHEN inner_edge THEN w ELSE 0 END), 6) AS inside, round(sum(w), 6) AS degree, round(sum(CASE WHEN inner_edge THEN w ELSE 0 END) / max(m) - pow(sum(w) / (2 * max(m)), 2), 6) AS modularity FROM y, m GROUP BY 1
"""


def schema_edges(spark: SparkSession, d: str) -> DataFrame:
    return views.cluster_edges(table_edges(spark, d), _by_schema(spark, d)).withColumnsRenamed({"cluster_a": "schema_a", "cluster_b": "schema_b"})


SCHEMA_EDGES_SQL = _EDGES_SQL + """
SELECT least(a.schema_name, b.schema_name) AS schema_a, greatest(a.schema_name, b.schema_name) AS schema_b, count(*) AS edges, round(sum(weight), 6) AS weight
FROM e JOIN tbl_inventory a ON a.table_name = parent JOIN tbl_inventory b ON b.table_name = child WHERE a.schema_name <> b.schema_name GROUP BY 1, 2
"""

# ---- patterns ---------------------------------------------------------------------


def known_schema(spark: SparkSession, d: str) -> DataFrame:
    return graph.known_schema(_tables(spark, d), least=0.05)


KNOWN_SCHEMA_SQL = (
    "WITH k(name, table_name) AS (VALUES " + ", ".join(f"('{s}', '{t}')" for s, ts in graph.KNOWN_SCHEMAS.items() for t in ts)
    + "), n AS (SELECT count(DISTINCT lower(table_name)) AS n FROM tbl_inventory), z AS (SELECT name, count(*) AS k FROM k GROUP BY 1) SELECT name, round(count(*) / (max(n) + max(z.k) - count(*)), 4) AS jaccard, count(*) AS matched"
    " FROM k JOIN (SELECT DISTINCT lower(table_name) AS table_name FROM tbl_inventory) USING (table_name) JOIN z USING (name) CROSS JOIN n GROUP BY name HAVING round(count(*) / (max(n) + max(z.k) - count(*)), 4) >= 0.05"
)


def temporal_coverage(spark: SparkSession, d: str) -> DataFrame:
    return graph.temporal_coverage(_columns(spark, d), kinds.TEMPORAL_NAME)


TEMPORAL_SQL = _NAMED_SQL + """
SELECT count(*) FILTER (tracked) AS tracked_tables, count(*) AS total_tables, round(count(*) FILTER (tracked) / count(*), 4) AS fraction, count(*) FILTER (tracked) / count(*) >= 0.75 AS supports_cdc
FROM (SELECT table_name, bool_or(lower(column_name) IN ('modified_date', 'modified_at', 'updated_at', 'updated_date', 'last_modified', 'last_updated', 'last_changed', 'date_modified')) AS tracked FROM c GROUP BY 1)
"""


def surrogate_keys(spark: SparkSession, d: str) -> DataFrame:
    return graph.surrogate_keys(_columns(spark, d))


SURROGATE_SQL = _NAMED_SQL + """
SELECT count(*) AS tables_with_pk, count(*) FILTER (s) AS surrogate_count, count(*) FILTER (i) AS integer_count, round(count(*) FILTER (s) / greatest(count(*), 1), 4) AS surrogate_pct, round(count(*) FILTER (i) / greatest(count(*), 1), 4) AS integer_pct
FROM (SELECT table_name, bool_or(lower(column_name) = 'id' OR lower(column_name) LIKE '%\\_id' ESCAPE '\\') AS s, bool_or(regexp_matches(lower(data_type), '^(int|integer|bigint|smallint|serial|bigserial|tinyint)\\b')) AS i FROM c WHERE is_pk GROUP BY 1)
"""


def bridges(spark: SparkSession, d: str) -> DataFrame:
    return graph.bridges(_columns(spark, d), _edges(spark, d).select(F.col("child_table").alias("child"), F.col("parent_table").alias("parent")))


BRIDGES_SQL = _NAMED_SQL + """
SELECT table_name, fk_count, total_cols, parents FROM (SELECT child_table AS table_name, count(DISTINCT parent_table) AS fk_count, string_agg(DISTINCT parent_table, ',' ORDER BY parent_table) AS parents FROM r WHERE child_table <> parent_table GROUP BY 1)
JOIN (SELECT table_name, count(*) AS total_cols FROM c GROUP BY 1) USING (table_name) WHERE fk_count BETWEEN 2 AND 3 AND total_cols - fk_count <= 2
"""


def supertypes(spark: SparkSession, d: str) -> DataFrame:
    return graph.supertypes(_edges(spark, d).select(F.col("child_table").alias("child"), "child_column", F.col("parent_table").alias("parent")))


SUPERTYPES_SQL = _NAMED_SQL + """
SELECT parent_table AS supertype, child_column AS fk_column, string_agg(DISTINCT child_table, ',' ORDER BY child_table) AS subtypes, count(DISTINCT child_table) AS "count" FROM r
WHERE child_table <> parent_table AND lower(child_column) IN ('id', lower(parent_table) || '_id', CASE WHEN parent_table LIKE '%ies' THEN regexp_replace(lower(parent_table), 'ies$', 'y') || '_id' END,
  CASE WHEN parent_table LIKE '%s' AND parent_table NOT LIKE '%ss' THEN regexp_replace(lower(parent_table), 's$', '') || '_id' END) GROUP BY 1, 2 HAVING count(DISTINCT child_table) >= 2
"""

# ---- names and types only ------------------------------------------------------------


def matched_columns(spark: SparkSession, d: str) -> DataFrame:
    pairs = metadata_match.matched_columns(table(spark, d, "col_inventory"))
    return metadata_match.scored(pairs).select("column_a", "column_b", F.round("score", 4).alias("score"), "total")


def sensitive_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "col_inventory")
    return c.select("column_id", metadata_match.sensitive_name(F.col("column_name")).alias("category")).where("category is not null")


SENSITIVE_NAMES_SQL = r"""
SELECT * FROM (SELECT column_id, CASE WHEN regexp_matches(column_name, '(?i)\b(salary|finance|amount|pay)\b') THEN 'FINANCIAL' WHEN regexp_matches(column_name, '(?i)\b(email|phone|name|address)\b') THEN 'PII'
  WHEN regexp_matches(column_name, '(?i)\b(health|ssn|dob|medical)\b') THEN 'PHI' WHEN regexp_matches(column_name, '(?i)\b(password|pwd|secret|key)\b') THEN 'HIGH_RISK_CREDENTIAL' END AS category FROM col_inventory) WHERE category IS NOT NULL
"""


def domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tbl_inventory").select("table_name", metadata_match.domain(F.col("table_name")).alias("domain"))


DOMAINS_SQL = "SELECT table_name, CASE WHEN regexp_matches(lower(table_name), 'cust|user|client') THEN 'Customer Data' WHEN regexp_matches(lower(table_name), 'pay|inv|fin') THEN 'Financial Data' ELSE 'Miscellaneous Data' END AS domain FROM tbl_inventory"


def entity_types(spark: SparkSession, d: str) -> DataFrame:
    sizes = _columns(spark, d).groupBy("table_name").agg(F.count("*").alias("n_cols"))
    return metadata_match.entity_type(sizes, _edges(spark, d).select(F.col("child_table").alias("child"), F.col("parent_table").alias("parent")))


ENTITY_SQL = _NAMED_SQL + """
, t AS (SELECT table_name, lower(table_name) AS n, count(*) AS n_cols, (SELECT count(*) FROM r WHERE child_table = table_name) AS n_out, (SELECT count(*) FROM r WHERE parent_table = table_name) AS n_in FROM c GROUP BY 1)
SELECT table_name, CASE WHEN regexp_matches(n, 'config|settings|prop') THEN 'Config' WHEN regexp_matches(n, '_(hist|history|log|audit)$') THEN 'History / Log' WHEN regexp_matches(n, '_(text|tl|i18n)$') THEN 'Text / Translation'
  WHEN regexp_matches(n, '_(type|status|category|code)$') OR (n_out = 0 AND n_in >= 1 AND n_cols <= 8) THEN 'Master Lookup' WHEN regexp_matches(n, '_(item|detail|line)$') THEN 'Transaction (Item)'
  WHEN regexp_matches(n, 'header|order|invoice') OR (n_out >= 2 AND n_cols >= 8) THEN 'Transaction (Header)' ELSE 'Standard Entity' END AS table_type FROM t
"""


def ratio_cardinality(spark: SparkSession, d: str) -> DataFrame:
    """Cardinality of orders to customers from distinct over rows of both sides."""
    a = table(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("ad"), F.count("*").alias("ar"))
    b = table(spark, d, "customer").agg(F.count_distinct("c_custkey").alias("bd"), F.count("*").alias("br"))
    return a.crossJoin(F.broadcast(b)).select(metadata_match.ratio_cardinality(F.col("ad"), F.col("ar"), F.col("bd"), F.col("br")).alias("cardinality"))  # one row each


RATIO_SQL = "SELECT CASE WHEN a > 0.9 AND b < 0.9 THEN '1:N' WHEN a < 0.9 AND b > 0.9 THEN 'N:1' WHEN a < 0.9 AND b < 0.9 THEN 'M:N' ELSE '1:1' END AS cardinality FROM (SELECT (SELECT count(DISTINCT o_custkey) / count(*) FROM orders) AS a, (SELECT count(DISTINCT c_custkey) / count(*) FROM customer) AS b)"


def context_links(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = views.context_graph(domains(spark, d).join(entity_types(spark, d), "table_name"), _edges(spark, d))
    return links.join(nodes.select(F.col("id").alias("source"), F.col("group").alias("source_group")), "source").select("source", "target", "weight", "source_group")


CONTEXT_SQL = _NAMED_SQL + f"SELECT child_table AS source, parent_table AS target, max(confidence) AS weight, any_value(domain) AS source_group FROM r JOIN ({DOMAINS_SQL}) x ON x.table_name = child_table GROUP BY 1, 2"

# ---- sensitive data -------------------------------------------------------------------


def _texts(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, list[str]]]:
    """Every table with its string columns."""
    found = {t: (df := table(spark, d, t), [c for c, kind in df.dtypes if kind == "string"]) for t in names(spark, d)}
    return {t: x for t, x in found.items() if x[1]}


def pii_findings(spark: SparkSession, d: str) -> DataFrame:
    return sensitive_scan.findings(sensitive_scan.match_counts(_texts(spark, d)))


def pii_findings_strict(spark: SparkSession, d: str) -> DataFrame:
    cells = _texts(spark, d)
    return views.with_regulations(sensitive_scan.findings(sensitive_scan.match_counts(cells, strict=True)), sensitive_scan.regulations(spark))


def email_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of each text column that hold an e-mail address by the catalog's pattern."""
    cells = sensitive_scan.text_cells(_texts(spark, d))
    return cells.where(F.col("value").rlike(sensitive.BY_NAME["EMAIL"].regex)).groupBy("table_name", "column_name").agg(F.count("*").alias("n"))


EMAIL_SQL = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n FROM {t} WHERE regexp_matches({c}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z][A-Za-z]+')" for t, cols in TEXTS.items() for c in cols) + ") WHERE n > 0"


def regulations(spark: SparkSession, d: str) -> DataFrame:
    """Regulations that the names of inventoried columns bring in."""
    rules = sensitive_scan.regulations(spark)
    return _priors(spark, d).join(F.broadcast(rules), "pii_type").groupBy("regulation").agg(F.count_distinct("table_name", "column_name").alias("columns"))


REGULATIONS_SQL = _NAMED_SQL + "SELECT regulation, count(DISTINCT (table_name, column_name)) AS columns FROM (" + _prior_sql() + ") JOIN (VALUES " + ", ".join(f"('{p.name}', '{r}')" for p in sensitive.PATTERNS for r in p.regulations) + ") v(pii_type, regulation) USING (pii_type) GROUP BY 1"
#: Card numbers of the test ranges that issuers publish, and some that are none.
CARDS = ("4111 1111 1111 1111", "5555555555554444", "378282246310005", "6011111111111117", "30569309025904", "3530111333300000", "2223003122003222", "6200000000000005", "4111111111111112", "1234", "", "2200000000000004", "5018 0000 0009")


def card_checks(spark: SparkSession, d: str) -> DataFrame:
    cards = spark.createDataFrame([(c,) for c in CARDS], "pan string")
    return cards.select("pan", sensitive_scan.luhn_valid(F.col("pan")).alias("valid"), sensitive_scan.card_brand(F.col("pan")).alias("brand"))


def _brand_sql() -> str:
    return "CASE " + " ".join(f"WHEN length(x) >= {n} AND TRY_CAST(left(x, {n}) AS INT) BETWEEN {low} AND {high} THEN '{b}'" for b, n, low, high in sensitive.card_ranges()) + " END"


CARDS_SQL = f"""
SELECT pan, length(x) >= 13 AND coalesce(list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(x)[i] AS INT) ELSE (2 * CAST(reverse(x)[i] AS INT)) // 10 + (2 * CAST(reverse(x)[i] AS INT)) % 10 END)) % 10 = 0, false) AS valid, {_brand_sql()} AS brand
FROM (SELECT pan, regexp_replace(pan, '[^0-9]', '', 'g') AS x FROM (VALUES {', '.join(f"('{c}')" for c in CARDS)}) v(pan))
"""


def pii_spread(spark: SparkSession, d: str) -> DataFrame:
    """How the kinds that column names imply spread along the recorded relationships."""
    return sensitive_scan.propagated(_priors(spark, d), _edges(spark, d), score_floor=0.5, confidence_floor=0.5)


_DIRECT_LIST = "'EMAIL', 'PHONE', 'SSN_US', 'SSN', 'PASSPORT_GB', 'PASSPORT_US', 'PASSPORT', 'IBAN', 'CC_NUMBER', 'PESEL_PL', 'BSN_NL', 'NIR_FR', 'AADHAAR_IN', 'MRN', 'NPI_US', 'MEDICARE_MBI', 'PERSONNUMMER_SE', 'TAX_ID_DE', 'CODICE_FISCALE_IT'"
SPREAD_SQL = _NAMED_SQL.replace("WITH c", "WITH RECURSIVE c") + f"""
, e AS (SELECT DISTINCT child_table, parent_table FROM r WHERE confidence >= 0.5 AND child_table <> parent_table), s AS (SELECT DISTINCT table_name, pii_type AS kind FROM ({_prior_sql()}) WHERE pii_type IN ({_DIRECT_LIST}) AND score >= 0.5),
w AS (SELECT table_name, kind, 0 AS distance FROM s UNION SELECT child_table, kind, distance + 1 FROM w JOIN e ON parent_table = table_name WHERE distance < 30)
SELECT table_name, kind, min(distance)::INTEGER AS distance FROM w GROUP BY 1, 2
"""
_LEAK_COLS = [("employees", "work_email"), ("employees", "personal_email"), ("candidates", "email"), ("candidates", "last_name"), ("employees", "last_name")]


def pii_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Columns whose values occur in employees' last names or mail addresses, found by shared values."""
    found = spark.createDataFrame([("employees", "last_name", "PERSON_NAME", 0.9), ("employees", "work_email", "EMAIL", 0.99)], "table_name string, column_name string, pii_type string, score double")
    pairs = all_pairs([side(spark, d, *c) for c in _LEAK_COLS]).select("child", "parent", "containment")
    classes = spark.createDataFrame([(f"{t}.{c}", "STRING_SHORT") for t, c in _LEAK_COLS], "name string, type_class string")
    return sensitive_scan.leaks(found, pairs, classes, containment_floor=0.05)


def _leak_sql(source: tuple[str, str], kind: str) -> str:
    st, sc = source
    return " UNION ALL ".join(
        f"SELECT '{st}.{sc}' AS source, '{t}.{c}' AS target, '{kind}' AS pii_type, round((SELECT count(*) FROM (SELECT DISTINCT {c} AS v FROM {t} INTERSECT SELECT {sc} FROM {st}) WHERE v IS NOT NULL) / (SELECT count(DISTINCT {c}) FROM {t}), 4) AS containment"
        for t, c in _LEAK_COLS if t != st
    )


LEAKS_SQL = f"SELECT * FROM ({_leak_sql(('employees', 'last_name'), 'PERSON_NAME')} UNION ALL {_leak_sql(('employees', 'work_email'), 'EMAIL')}) WHERE containment >= 0.05"

# ---- soft keys --------------------------------------------------------------------


def composite_keys(spark: SparkSession, d: str) -> DataFrame:
    """Composite keys among the candidates of the star schema, as found by shared values."""
    columns, shared = measured(spark, d)
    ids = columns.select("column_id", "table_name", "column_name", "distinct_count")
    of = lambda s: ids.select(F.col("column_id").alias(f"{s}_id"), F.col("table_name").alias(f"{s}_table"), F.col("column_name").alias(f"{s}_column"), F.col("distinct_count").alias(f"{s}_n"))
    singles = shared.join(of("child"), "child_id").join(of("parent"), "parent_id").withColumn("containment", F.col("shared") / F.col("child_n"))
    return soft_keys.composite_keys(spark, {t: table(spark, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}, soft_keys.composite_proposals(singles))


def polymorphic_keys(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of events tested as a discriminator of user_id."""
    parents = [side(spark, d, "customer", "c_custkey"), side(spark, d, "supplier", "s_suppkey"), side(spark, d, "part", "p_partkey")]
    return soft_keys.polymorphic_keys(table(spark, d, "events").select("event_type", "user_id"), "event_type", "user_id", parents).drop("cardinality", "orphans")


POLYMORPHIC_SQL = "SELECT kind, parent, child_distinct, parent_distinct, containment, round(0.7 * containment + 0.2 * 0.85 + 0.1 * least(child_distinct / 1000.0, 1.0), 4) AS confidence FROM (" + " UNION ALL ".join(
    f"SELECT event_type AS kind, '{t}.{c}' AS parent, count(DISTINCT user_id) AS child_distinct, (SELECT count(DISTINCT {c}) FROM {t}) AS parent_distinct, round(count(DISTINCT CASE WHEN user_id IN (SELECT {c} FROM {t}) THEN user_id END) / count(DISTINCT user_id), 4) AS containment FROM events WHERE event_type IS NOT NULL GROUP BY 1"
    for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))
) + ") WHERE containment >= 0.95"


def json_keys(spark: SparkSession, d: str) -> DataFrame:
    parents = {"int": [side(spark, d, "part", "p_partkey"), side(spark, d, "nation", "n_nationkey"), side(spark, d, "customer", "c_custkey")]}
    return soft_keys.json_keys("events", table(spark, d, "events").select("props"), "props", parents).drop("cardinality", "orphans")


JSON_KEYS_SQL = "SELECT path, parent, child_distinct, parent_distinct, containment, round(0.7 * containment + 0.2 * 0.6 + 0.1 * least(child_distinct / 1000.0, 1.0), 4) AS confidence FROM (" + " UNION ALL ".join(
    f"SELECT '$.k' AS path, '{t}.{c}' AS parent, count(DISTINCT k) AS child_distinct, (SELECT count(DISTINCT {c}) FROM {t}) AS parent_distinct, round(count(DISTINCT CASE WHEN k IN (SELECT {c}::VARCHAR FROM {t}) THEN k END) / count(DISTINCT k), 4) AS containment FROM (SELECT props->>'$.k' AS k FROM events)"
    for t, c in (("part", "p_partkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"))
) + ") WHERE containment >= 0.95 AND child_distinct >= 5"

# ---- read models --------------------------------------------------------------------

#: The star schema's true references.
GOLD = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("events", "user_id", "customer", "c_custkey"),
]


def discovery_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall and precision of primary candidates against the true references."""
    found = fk_candidates(spark, d).where("tier = 'primary'").withColumnsRenamed({f"{s}_{c}_name": f"{s}_{c}" for s in ("child", "parent") for c in ("table", "column")})
    gold = spark.createDataFrame(GOLD, "child_table string, child_column string, parent_table string, parent_column string")
    return views.recall_precision(found, gold)


def recorded_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the recorded relationships those of confidence 0.8 or more, against all of full containment."""
    e = _edges(spark, d)
    return views.recall_precision(e.where("confidence >= 0.8"), e.where("containment_full >= 0.95"))


RECALL_SQL = _NAMED_SQL + """
, k AS (SELECT DISTINCT child_table, child_column, parent_table, parent_column, bool_or(coalesce(confidence >= 0.8, false)) OVER w AS f, bool_or(coalesce(containment_full >= 0.95, false)) OVER w AS g FROM r WINDOW w AS (PARTITION BY child_table, child_column, parent_table, parent_column))
SELECT count(*) FILTER (f AND g) AS hits, count(*) FILTER (f) AS found, count(*) FILTER (g) AS expected, round(count(*) FILTER (f AND g) / greatest(count(*) FILTER (g), 1), 4) AS recall, round(count(*) FILTER (f AND g) / greatest(count(*) FILTER (f), 1), 4) AS "precision" FROM k
"""


def unified_relationships(spark: SparkSession, d: str) -> DataFrame:
    one = _edges(spark, d).select("child_table", "child_column", "parent_table", "parent_column", F.col("containment_full").alias("containment"), "confidence")
    many = spark.createDataFrame([("lineitem", "partsupp", "l_partkey,l_suppkey", "ps_partkey,ps_suppkey", 1.0, 0.9)], "child_table string, parent_table string, child_columns string, parent_columns string, containment double, confidence double")
    return views.unified(one, many)


UNIFIED_SQL = _NAMED_SQL + "SELECT 'single' AS kind, child_table, child_column, parent_table, parent_column, containment_full AS containment, confidence FROM r UNION ALL SELECT 'composite', 'lineitem', 'l_partkey', 'partsupp', 'ps_partkey', 1.0, 0.9"


def surviving_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of any relationship, and those whose extract nothing uses."""
    e = _edges(spark, d)
    used = e.select(F.col("child_table").alias("table_name")).union(e.select("parent_table")).distinct().withColumn("state", F.lit("used"))
    t = table(spark, d, "tbl_inventory")
    unused = exports.orphaned_files(t, t.join(used, "table_name").select("table_id")).join(t.select("table_id", "table_name"), "table_id").select("table_name", F.lit("unused extract").alias("state"))
    return used.unionByName(unused)


SURVIVING_SQL = _NAMED_SQL + ", u AS (SELECT child_table AS table_name FROM r UNION SELECT parent_table FROM r) SELECT table_name, 'used' AS state FROM u UNION ALL SELECT table_name, 'unused extract' FROM tbl_inventory WHERE parquet_path IS NOT NULL AND table_name NOT IN (SELECT table_name FROM u)"


def foreign_columns(spark: SparkSession, d: str) -> DataFrame:
    return views.foreign_columns(_columns(spark, d).select("table_name", "column_name", "ordinal_position"), _edges(spark, d))


FOREIGN_SQL = _NAMED_SQL + "SELECT table_name, column_name, ordinal_position, EXISTS (SELECT 1 FROM r WHERE child_table = table_name AND child_column = column_name) AS is_fk FROM c"


def latest_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The run-ledger rule on deliveries: the last of each candidate, by status."""
    log = table(spark, d, "candidates").select(F.lit("load").alias("phase"), F.lit("candidate").alias("scope_type"), F.col("id").alias("scope_id"), F.col("loaded_at").alias("finished_at"), F.coalesce("status", F.lit("none")).alias("status"))
    return views.run_summary(log)


LATEST_SQL = "SELECT 'load' AS phase, status, count(*) AS n FROM (SELECT coalesce(status, 'none') AS status, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, coalesce(status, 'none') DESC) AS rn FROM candidates) WHERE rn = 1 GROUP BY 2"

# ---- streams ------------------------------------------------------------------------


def stream_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of the events, read as a stream, by hour and kind; a window is in the result from its first event on."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path if not path.endswith(".parquet") else d, pathGlobFilter="events.parquet") if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    out = windowed_profile(stream, "ts", "event_type", "value")
    target = new_folder(spark, "windows")

    def keep(batch: DataFrame, number: int) -> None:  # a batch that is done again writes over itself
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", new_folder(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    # the last state of each window counts
    rows = spark.read.schema(out.schema.add("batch", T.IntegerType())).parquet(target)
    last = rows.groupBy("window_start", "group").agg(F.max_by(F.struct("n", "nulls", "low", "high"), "batch").alias("w")).select("window_start", "group", "w.*")
    return last.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


STREAM_SQL = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS \"group\", count(*) AS n, count(*) - count(value) AS nulls, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2"

QUERIES = {
    "name_priors": name_priors, "table_edges": table_edges, "archetypes": archetypes, "clusters": clusters, "schema_modularity": schema_modularity, "schema_edges": schema_edges, "known_schema": known_schema, "temporal_coverage": temporal_coverage,
    "surrogate_keys": surrogate_keys, "bridges": bridges, "supertypes": supertypes, "matched_columns": matched_columns, "sensitive_names": sensitive_names, "domains": domains, "entity_types": entity_types, "ratio_cardinality": ratio_cardinality,
    "context_links": context_links, "pii_findings": pii_findings, "pii_findings_strict": pii_findings_strict, "email_cells": email_cells, "regulations": regulations, "card_checks": card_checks, "pii_spread": pii_spread, "pii_leaks": pii_leaks,
    "composite_keys": composite_keys, "polymorphic_keys": polymorphic_keys, "json_keys": json_keys, "discovery_recall": discovery_recall, "recorded_recall": recorded_recall, "unified_relationships": unified_relationships,
    "surviving_tables": surviving_tables, "foreign_columns": foreign_columns, "latest_deliveries": latest_deliveries, "stream_profile": stream_profile,
}
ORACLE = {
    "name_priors": NAME_PRIORS_SQL, "table_edges": _EDGES_SQL + "SELECT * FROM e", "archetypes": ARCHETYPES_SQL, "schema_modularity": MODULARITY_SQL, "schema_edges": SCHEMA_EDGES_SQL, "known_schema": KNOWN_SCHEMA_SQL, "temporal_coverage": TEMPORAL_SQL,
    "surrogate_keys": SURROGATE_SQL, "bridges": BRIDGES_SQL, "supertypes": SUPERTYPES_SQL, "sensitive_names": SENSITIVE_NAMES_SQL, "domains": DOMAINS_SQL, "entity_types": ENTITY_SQL, "ratio_cardinality": RATIO_SQL, "context_links": CONTEXT_SQL,
    "email_cells": EMAIL_SQL, "regulations": REGULATIONS_SQL, "card_checks": CARDS_SQL, "pii_spread": SPREAD_SQL, "pii_leaks": LEAKS_SQL, "polymorphic_keys": POLYMORPHIC_SQL, "json_keys": JSON_KEYS_SQL, "recorded_recall": RECALL_SQL,
    "unified_relationships": UNIFIED_SQL, "surviving_tables": SURVIVING_SQL, "foreign_columns": FOREIGN_SQL, "latest_deliveries": LATEST_SQL, "stream_profile": STREAM_SQL,
}

#: SQL of the read models that put the patterns and schemas above together.
QUALITY_OF_SCHEMAS = {
    "schema_insights": (
        f"SELECT 'tables' AS insight, (SELECT count(DISTINCT table_name) FROM ({_NAMED_SQL} SELECT table_name FROM c))::DOUBLE AS value UNION ALL SELECT 'temporal_fraction', fraction FROM ({TEMPORAL_SQL}) UNION ALL SELECT 'surrogate_pct', surrogate_pct FROM ({SURROGATE_SQL})"
        f" UNION ALL SELECT 'integer_pct', integer_pct FROM ({SURROGATE_SQL}) UNION ALL SELECT 'bridge_tables', count(*) FROM ({BRIDGES_SQL}) UNION ALL SELECT 'supertypes', count(*) FROM ({SUPERTYPES_SQL})"
    ),
    "quality_view": f"SELECT row_number() OVER (ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, table_name, column_name, finding) AS rank, * FROM ({QUALITY_SQL})",
    "schema_detail": _EDGES_SQL + """
, x AS (SELECT e.weight AS w, a.schema_name AS p, b.schema_name AS q FROM e JOIN tbl_inventory a ON a.table_name = parent JOIN tbl_inventory b ON b.table_name = child)
SELECT t.schema_name, count(*) AS tables, sum(coalesce(row_count_estimate, 0))::BIGINT AS "rows", (SELECT count(*) FROM x WHERE p = q AND p = t.schema_name) AS inner_edges, (SELECT count(*) FROM x WHERE p <> q AND t.schema_name IN (p, q)) AS bridge_edges,
  coalesce((SELECT round(sum(w), 6) FROM x WHERE p = q AND p = t.schema_name), 0.0) AS inner_weight FROM tbl_inventory t GROUP BY 1
""",
}
