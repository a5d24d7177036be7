"""Queries on catalogs, fingerprints, quality rules and inclusion, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymark.functions import types as kinds
from quarrymark.operators import inclusion, profile
from quarrymark.operators.inclusion import Side
from quarrymark.sources.tables import table

#: The star schema's tables with their columns; * marks text columns.
STAR = {
    "region": "r_regionkey r_name*", "nation": "n_nationkey n_name* n_regionkey", "customer": "c_custkey c_name* c_nationkey c_acctbal c_mktsegment*", "supplier": "s_suppkey s_name* s_nationkey s_acctbal",
    "part": "p_partkey p_name* p_brand* p_type* p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus* o_totalprice o_orderdate o_orderpriority*",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag* l_linestatus* l_shipdate", "events": "event_id ts user_id event_type* value props*",
}
#: Key-like columns of integer family, whose inclusions are searched.
KEYS = [
    ("region", "r_regionkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("customer", "c_custkey"), ("customer", "c_nationkey"), ("supplier", "s_suppkey"), ("supplier", "s_nationkey"),
    ("part", "p_partkey"), ("orders", "o_orderkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"), ("events", "event_id"), ("events", "user_id"),
]
#: The only key column of a table, for the rule on duplicates.
SOLE_KEYS = ("region.r_regionkey", "nation.n_nationkey", "customer.c_custkey", "supplier.s_suppkey", "part.p_partkey", "orders.o_orderkey", "lineitem.l_orderkey", "events.event_id")
DIRTY = {"applications": "id candidate_id posting_id status* applied_at loaded_at", "employees": "id first_name* last_name* employee_code* dob work_email* personal_email* work_phone* hire_date department_id manager_id job_id status* deleted_at loaded_at"}


def _columns(tables: dict[str, str]) -> list[tuple[str, str, bool]]:
    return [(t, c.rstrip("*"), c.endswith("*")) for t, cols in tables.items() for c in cols.split()]


def side(spark: SparkSession, d: str, t: str, c: str) -> Side:
    return Side(f"{t}.{c}", table(spark, d, t).select(c), c)


# ---- catalog -------------------------------------------------------------------


def row_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.union_all([table(spark, d, t).agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t in STAR])


ROW_COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in STAR)


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return profile.catalog(spark, {t: table(spark, d, t) for t in STAR})


CATALOG_SQL = """
SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal,
  CASE data_type WHEN 'BIGINT' THEN 'BIGINT' WHEN 'INTEGER' THEN 'INTEGER' WHEN 'DOUBLE' THEN 'DOUBLE' WHEN 'TIMESTAMP' THEN 'TIMESTAMP' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'TIMESTAMP' ELSE 'VARCHAR' END AS physical_type,
  CASE data_type WHEN 'BIGINT' THEN 'INT_WIDE' WHEN 'INTEGER' THEN 'INT_NARROW' WHEN 'DOUBLE' THEN 'FLOAT' WHEN 'TIMESTAMP' THEN 'TIMESTAMP' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'TIMESTAMP' ELSE 'STRING_LONG' END AS type_class
FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')
"""


def declared_types(spark: SparkSession, d: str) -> DataFrame:
    """Classes of the inventoried columns by their declared types, key promotion and comparable group."""
    c = table(spark, d, "col_inventory")
    tc = kinds.type_class(F.col("data_type"), F.col("max_length"))
    out = c.select("column_id", "column_name", tc.alias("declared_class"), "is_pk", "is_unique_indexed")
    return out.select("column_id", "declared_class", kinds.is_eligible(F.col("declared_class"), F.col("column_name"), F.col("is_pk"), F.col("is_unique_indexed")).alias("eligible"), kinds.compat_group(F.col("declared_class")).alias("compat"))


DECLARED_TYPES_SQL = """
WITH c AS (SELECT *, lower(trim(data_type)) AS k FROM col_inventory), t AS (
  SELECT *, CASE WHEN k LIKE 'timestamp%' THEN 'TIMESTAMP' WHEN k IN ('integer', 'smallint', 'int', 'int2', 'int4') THEN 'INT_NARROW' WHEN k IN ('bigint', 'int8') THEN 'INT_WIDE' WHEN k = 'uuid' THEN 'UUID'
    WHEN k = 'date' THEN 'DATE' WHEN k IN ('boolean', 'bool') THEN 'BOOL' WHEN k IN ('numeric', 'decimal', 'double precision', 'float8', 'real', 'float4', 'money') THEN 'FLOAT' WHEN k = 'bytea' THEN 'BINARY'
    WHEN k IN ('jsonb', 'json') THEN 'JSONB' WHEN k IN ('character varying', 'varchar', 'character', 'char', 'text', 'bpchar') AND max_length <= 64 THEN 'STRING_SHORT' ELSE 'STRING_LONG' END AS tc FROM c
)
SELECT column_id, tc AS declared_class, tc IN ('INT_NARROW', 'INT_WIDE', 'UUID', 'STRING_SHORT', 'DATE', 'TIMESTAMP') OR coalesce(is_pk, false) OR coalesce(is_unique_indexed, false) OR (tc = 'STRING_LONG' AND (lower(column_name) = 'id' OR lower(column_name) LIKE '%\\_id' ESCAPE '\\')) AS eligible,
  CASE WHEN tc LIKE 'INT%' THEN 'INT' WHEN tc LIKE 'STRING%' THEN 'STRING' WHEN tc IN ('UUID', 'DATE', 'TIMESTAMP') THEN tc END AS compat FROM t
"""


def table_exclusions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tbl_inventory")
    return t.select("table_id", "table_name", kinds.exclusion_reason(F.col("table_name")).alias("reason"))


TABLE_EXCLUSIONS_SQL = """
SELECT table_id, table_name, CASE WHEN regexp_matches(lower(table_name), '_log(_.*)?$') THEN 'log_pattern' WHEN lower(table_name) LIKE 'temp\\_%' ESCAPE '\\' THEN 'temp_pattern' WHEN lower(table_name) LIKE 'tmp\\_%' ESCAPE '\\' THEN 'tmp_pattern'
  WHEN regexp_matches(lower(table_name), '_bak(_.*|[0-9]*)?$') THEN 'backup_pattern' WHEN regexp_matches(lower(table_name), '_archive(_.*)?$') THEN 'archive_pattern' WHEN regexp_matches(lower(table_name), '_events(_.*)?$') THEN 'events_pattern'
  WHEN lower(table_name) LIKE 'etl\\_%' ESCAPE '\\' THEN 'etl_pattern' WHEN regexp_matches(lower(table_name), '^migrations(_.*|$)') THEN 'migrations_pattern' END AS reason FROM tbl_inventory
"""

_NAME_RULES = {"is_pointer": kinds.POINTER_NAME, "is_key": kinds.KEY_NAME, "is_credential": kinds.CREDENTIAL_NAME, "is_free_text": kinds.FREE_TEXT_NAME, "is_temporal": kinds.TEMPORAL_NAME}


def column_name_rules(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "col_inventory")
    return c.select("column_id", *[F.col("column_name").rlike(p).alias(n) for n, p in _NAME_RULES.items()])


COLUMN_NAME_RULES_SQL = "SELECT column_id, " + ", ".join(f"regexp_matches(column_name, '{p}') AS {n}" for n, p in _NAME_RULES.items()) + " FROM col_inventory"

# ---- fingerprints and quality -----------------------------------------------------


def _fingerprints(spark: SparkSession, d: str, tables: dict[str, str]) -> DataFrame:
    return profile.union_all([profile.fingerprints(table(spark, d, t).select(*[c.rstrip("*") for c in cols.split()]), t) for t, cols in tables.items()])


def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    keep = ["table_name", "column_name", "row_count", "null_count", "null_pct", "distinct_count", "distinct_lower", "empty_count", "padded_count", "longest", "cardinality_method"]
    return _fingerprints(spark, d, STAR).select(*keep)


def _metrics_sql(tables: dict[str, str]) -> str:
    def one(t: str, c: str, text: bool) -> str:
        q = f'"{c}"'
        extra = f"count(DISTINCT lower({q})) AS distinct_lower, sum(CASE WHEN {q} = '' THEN 1 ELSE 0 END)::BIGINT AS empty_count, sum(CASE WHEN {q} <> trim({q}) THEN 1 ELSE 0 END)::BIGINT AS padded_count, max(length({q}))::BIGINT AS longest" if text else "NULL::BIGINT AS distinct_lower, NULL::BIGINT AS empty_count, NULL::BIGINT AS padded_count, NULL::BIGINT AS longest"
        return f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({q}) AS null_count, round(CASE WHEN count(*) > 0 THEN (count(*) - count({q})) / count(*) ELSE 0.0 END, 6) AS null_pct, count(DISTINCT {q}) AS distinct_count, {extra}, 'exact' AS cardinality_method FROM {t}"

    return " UNION ALL ".join(one(*x) for x in _columns(tables))


def key_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Extremes of the integer columns, as text, and the dense-serial test."""
    f = _fingerprints(spark, d, {t: " ".join(c for c in cols.split() if c.endswith(("key", "_id", "linenumber", "size"))) for t, cols in STAR.items()})
    low, high = F.col("min_val").try_cast("long"), F.col("max_val").try_cast("long")
    dense = (F.col("distinct_count") > 0) & (F.col("null_pct") < 0.01) & (low == 1) & (F.abs(high - F.col("distinct_count")) <= 1)
    return f.select("table_name", "column_name", "min_val", "max_val", F.coalesce(dense, F.lit(False)).alias("dense_serial"))


KEY_RANGES_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, min({c})::VARCHAR AS min_val, max({c})::VARCHAR AS max_val, min({c}) = 1 AND abs(max({c}) - count(DISTINCT {c})) <= 1 AND count({c}) > 0.99 * count(*) AS dense_serial FROM {t}"
    for t, c, _ in _columns(STAR)
    if c.endswith(("key", "_id", "linenumber", "size"))
)


def adaptive_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return profile.union_all([profile.adaptive_fingerprints(table(spark, d, t), t).drop("ordinal") for t in ("orders", "lineitem")])


def sketch_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Estimated containment of orders' customers in customers, from theta sketches alone."""
    a = table(spark, d, "orders").agg(F.expr("theta_sketch_agg(o_custkey)").alias("a"))
    b = table(spark, d, "customer").agg(F.expr("theta_sketch_agg(c_custkey)").alias("b"))
    both = a.crossJoin(F.broadcast(b))  # one row each
    return both.selectExpr("theta_sketch_estimate(theta_intersection(a, b)) AS shared", "theta_sketch_estimate(a) AS child_distinct", "theta_sketch_estimate(b) AS parent_distinct")


def quality_findings(spark: SparkSession, d: str) -> DataFrame:
    f = _fingerprints(spark, d, STAR | DIRTY)
    return profile.quality_findings(f.withColumn("is_pk", F.concat_ws(".", "table_name", "column_name").isin(*SOLE_KEYS, "applications.id", "employees.id")))


_KEY_LIST = ", ".join(f"'{k}'" for k in (*SOLE_KEYS, "applications.id", "employees.id"))
QUALITY_SQL = f"""
WITH m AS (SELECT *, row_count - null_count AS filled, table_name || '.' || column_name IN ({_KEY_LIST}) AS pk FROM ({_metrics_sql(STAR | DIRTY)}))
SELECT table_name, column_name, finding, severity, "count", round("count" / total, 4) AS fraction FROM (
  SELECT table_name, column_name, 'ALL_NULL' AS finding, 'HIGH' AS severity, null_count AS "count", row_count AS total FROM m WHERE row_count > 0 AND null_count = row_count
  UNION ALL SELECT table_name, column_name, 'NULL_HEAVY', 'MEDIUM', null_count, row_count FROM m WHERE row_count > 0 AND null_count < row_count AND null_count >= 0.5 * row_count
  UNION ALL SELECT table_name, column_name, 'DUPLICATE_PK', 'HIGH', filled - distinct_count, filled FROM m WHERE pk AND distinct_count < filled
  UNION ALL SELECT table_name, column_name, 'LEADING_TRAILING_WHITESPACE', 'LOW', padded_count, row_count FROM m WHERE padded_count > 0
  UNION ALL SELECT table_name, column_name, 'EMPTY_STRING', 'LOW', empty_count, row_count FROM m WHERE empty_count > 0
  UNION ALL SELECT table_name, column_name, 'MIXED_CASE', 'MEDIUM', distinct_count - distinct_lower, distinct_count FROM m WHERE distinct_lower < distinct_count
  UNION ALL SELECT table_name, column_name, 'LOW_CARDINALITY', 'LOW', distinct_count, row_count FROM m WHERE NOT pk AND row_count >= 1000 AND distinct_count BETWEEN 1 AND 4
)
"""


def first_rows_profile(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint of the first 5,000 rows of lineitem, by position in the file."""
    return profile.fingerprints(profile.first_rows(table(spark, d, "lineitem"), 5000).select("l_orderkey", "l_quantity", "l_returnflag"), "lineitem").select("column_name", "row_count", "distinct_count")


FIRST_ROWS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count FROM (SELECT {c} FROM lineitem LIMIT 5000)" for c in ("l_orderkey", "l_quantity", "l_returnflag"))


def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every k-th row of orders, at most about 1,000."""
    t = table(spark, d, "orders")
    return profile.every_kth(t, t.count(), 1000).select("o_orderkey", "o_custkey")


STRIDE_SQL = "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER () - 1 AS i FROM orders) WHERE i % (SELECT greatest(1, ceil(count(*) / 1000.0)) FROM orders) = 0"

# ---- inclusion --------------------------------------------------------------------


def one_containment(child: tuple[str, str], parent: tuple[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: inclusion.containment(side(spark, d, *child), side(spark, d, *parent))


_CLASS_SQL = "CASE WHEN orphans = 0 AND child_distinct = parent_distinct THEN 'ONE_TO_ONE' WHEN orphans = 0 AND child_distinct > 0 THEN 'MANY_TO_ONE' WHEN child_distinct > 0 AND 1 - orphans / child_distinct >= 0.95 THEN 'PARTIAL' ELSE 'NO_RELATIONSHIP' END"
_HELD_SQL = "round(CASE WHEN child_distinct > 0 THEN 1 - orphans / child_distinct ELSE 0.0 END, 4)"


def _counts_sql(child: tuple[str, str], parent: tuple[str, str]) -> str:
    (ct, cc), (pt, pc) = child, parent
    return f"""SELECT '{ct}.{cc}' AS child, '{pt}.{pc}' AS parent, (SELECT count(DISTINCT {cc}) FROM {ct}) AS child_distinct, (SELECT count(DISTINCT {pc}) FROM {pt}) AS parent_distinct,
      (SELECT count(*) FROM (SELECT DISTINCT {cc} AS v FROM {ct} WHERE {cc} IS NOT NULL) x LEFT JOIN (SELECT DISTINCT {pc} AS v FROM {pt} WHERE {pc} IS NOT NULL) y USING (v) WHERE y.v IS NULL) AS orphans"""


def containment_sql(*pairs: tuple[tuple[str, str], tuple[str, str]]) -> str:
    return f"SELECT *, {_HELD_SQL} AS containment, {_CLASS_SQL} AS cardinality FROM ({' UNION ALL '.join(_counts_sql(*p) for p in pairs)})"


_SINGLES = {
    "containment_orders_customer": (("orders", "o_custkey"), ("customer", "c_custkey")),
    "containment_lineitem_orders": (("lineitem", "l_orderkey"), ("orders", "o_orderkey")),
    "containment_events_customer": (("events", "user_id"), ("customer", "c_custkey")),
    "containment_applications_candidates": (("applications", "candidate_id"), ("candidates", "id")),
}


def type_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return inclusion.containment(side(spark, d, "customer", "c_name"), side(spark, d, "customer", "c_custkey"))


TYPE_MISMATCH_SQL = "SELECT 'customer.c_name' AS child, 'customer.c_custkey' AS parent, 0::BIGINT AS child_distinct, 0::BIGINT AS parent_distinct, 0::BIGINT AS orphans, 0.0::DOUBLE AS containment, 'TYPE_MISMATCH' AS cardinality"
_NATION = [("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_regionkey"), ("customer", "c_name")]
_PARENTS = [("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey"), ("nation", "n_nationkey"), ("nation", "n_name")]


def group_validation(spark: SparkSession, d: str) -> DataFrame:
    return inclusion.grouped(side(spark, d, "nation", "n_nationkey"), [side(spark, d, *c) for c in _NATION]).withColumn("pos", F.col("pos").cast("long"))


GROUP_SQL = "SELECT CASE child WHEN 'customer.c_nationkey' THEN 0 WHEN 'supplier.s_nationkey' THEN 1 ELSE 2 END::BIGINT AS pos, * FROM (" + containment_sql(*[(c, ("nation", "n_nationkey")) for c in _NATION[:3]]) + ") UNION ALL SELECT 3, 'customer.c_name', 'nation.n_nationkey', 0, 0, 0, 0.0, 'TYPE_MISMATCH'"


def top_parents(spark: SparkSession, d: str) -> DataFrame:
    out = inclusion.top_k(side(spark, d, "lineitem", "l_partkey"), [side(spark, d, *p) for p in _PARENTS], k=3)
    return out.select(F.col("rank").cast("long").alias("rank"), "parent", "child_distinct", "parent_distinct", "orphans", "containment", "cardinality")


TOP_SQL = (
    "SELECT rank, parent, child_distinct, parent_distinct, orphans, containment, cardinality FROM (SELECT *, row_number() OVER (ORDER BY containment DESC, CASE parent "
    + " ".join(f"WHEN '{t}.{c}' THEN {i}" for i, (t, c) in enumerate(_PARENTS)) + " END) AS rank FROM (" + containment_sql(*[(("lineitem", "l_partkey"), p) for p in _PARENTS[:5]]) + ")) WHERE rank <= 3"
)


def inclusion_pairs(spark: SparkSession, d: str) -> DataFrame:
    return inclusion.all_pairs([side(spark, d, *k) for k in KEYS]).select("child", "parent", "shared", "child_distinct", "parent_distinct", "orphans", "containment", "cardinality")


INCLUSION_SQL = f"""
WITH v AS ({' UNION '.join(f"SELECT '{t}.{c}' AS name, {c}::BIGINT AS v FROM {t} WHERE {c} IS NOT NULL" for t, c in KEYS)}), s AS (SELECT name, count(*) AS n FROM v GROUP BY name),
p AS (SELECT a.name AS child, b.name AS parent, count(*) AS shared FROM v a JOIN v b ON a.v = b.v AND a.name <> b.name GROUP BY ALL)
SELECT child, parent, shared, child_distinct, parent_distinct, orphans, {_HELD_SQL} AS containment, {_CLASS_SQL} AS cardinality
FROM (SELECT child, parent, shared, x.n AS child_distinct, y.n AS parent_distinct, x.n - shared AS orphans FROM p JOIN s x ON x.name = child JOIN s y ON y.name = parent)
"""


def composite_containment(spark: SparkSession, d: str) -> DataFrame:
    """(part, supplier) of lineitem against the pairs of its first ships' month, a tuple test within one table."""
    li = table(spark, d, "lineitem")
    return inclusion.tuple_containment(li, ["l_partkey", "l_suppkey"], li.where("l_linenumber <= 6"), ["l_partkey", "l_suppkey"])


COMPOSITE_SQL = f"""
SELECT *, {_HELD_SQL} AS containment, {_CLASS_SQL} AS cardinality FROM (
  SELECT count(*) AS child_distinct, sum(CASE WHEN p THEN 1 ELSE 0 END)::BIGINT AS parent_distinct, sum(CASE WHEN p THEN 0 ELSE 1 END)::BIGINT AS orphans
  FROM (SELECT l_partkey, l_suppkey, bool_or(l_linenumber <= 6) AS p FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY ALL))
"""


def partition_containment(spark: SparkSession, d: str) -> DataFrame:
    """Users of each kind of event within customers or suppliers."""
    parents = {"click": side(spark, d, "customer", "c_custkey"), "view": side(spark, d, "supplier", "s_suppkey"), "error": side(spark, d, "nation", "n_nationkey")}
    return inclusion.partition_containment(table(spark, d, "events").select("event_type", "user_id"), "event_type", "user_id", parents)


PARTITION_SQL = f"SELECT kind, parent, child_distinct, parent_distinct, orphans, {_HELD_SQL} AS containment, {_CLASS_SQL} AS cardinality FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, '{t}.{c}' AS parent, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = '{k}') AS child_distinct, (SELECT count(DISTINCT {c}) FROM {t}) AS parent_distinct, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = '{k}' AND user_id NOT IN (SELECT {c} FROM {t})) AS orphans"
    for k, t, c in (("click", "customer", "c_custkey"), ("view", "supplier", "s_suppkey"), ("error", "nation", "n_nationkey"))
) + ")"


def json_containment(spark: SparkSession, d: str) -> DataFrame:
    """The leaf $.k of events' props within parts and nations, compared as text."""
    leaf = inclusion.json_side("events.props.$.k", table(spark, d, "events").select("props"), "props", "$.k")
    return profile.union_all([inclusion.containment(leaf, inclusion.as_text(side(spark, d, *p))) for p in (("part", "p_partkey"), ("nation", "n_nationkey"))])


JSON_SQL = f"SELECT *, {_HELD_SQL} AS containment, {_CLASS_SQL} AS cardinality FROM (" + " UNION ALL ".join(
    f"SELECT 'events.props.$.k' AS child, '{t}.{c}' AS parent, (SELECT count(DISTINCT props->>'$.k') FROM events) AS child_distinct, (SELECT count(DISTINCT {c}) FROM {t}) AS parent_distinct, (SELECT count(DISTINCT props->>'$.k') FROM events WHERE props->>'$.k' NOT IN (SELECT {c}::VARCHAR FROM {t})) AS orphans"
    for t, c in (("part", "p_partkey"), ("nation", "n_nationkey"))
) + ")"


def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    return inclusion.json_leaves(table(spark, d, "events").select("props"), "props")


JSON_LEAVES_SQL = "SELECT '$.k' AS path, 'int' AS kind, count(*) AS n FROM events WHERE regexp_full_match(props->>'$.k', '[0-9]+') GROUP BY ALL"

QUERIES = {
    "row_counts": row_counts, "catalog": catalog, "declared_types": declared_types, "table_exclusions": table_exclusions, "column_name_rules": column_name_rules, "fingerprint": fingerprint, "key_ranges": key_ranges,
    "adaptive_fingerprint": adaptive_fingerprint, "sketch_overlap": sketch_overlap, "quality_findings": quality_findings, "first_rows_profile": first_rows_profile, "stride_sample": stride_sample,
    **{n: one_containment(*p) for n, p in _SINGLES.items()},
    "type_mismatch": type_mismatch, "group_validation": group_validation, "top_parents": top_parents, "inclusion_pairs": inclusion_pairs, "composite_containment": composite_containment,
    "partition_containment": partition_containment, "json_containment": json_containment, "json_leaves": json_leaves,
}
ORACLE = {
    "row_counts": ROW_COUNTS_SQL, "catalog": CATALOG_SQL, "declared_types": DECLARED_TYPES_SQL, "table_exclusions": TABLE_EXCLUSIONS_SQL, "column_name_rules": COLUMN_NAME_RULES_SQL, "fingerprint": _metrics_sql(STAR),
    "key_ranges": KEY_RANGES_SQL, "quality_findings": QUALITY_SQL, "first_rows_profile": FIRST_ROWS_SQL, "stride_sample": STRIDE_SQL, **{n: containment_sql(p) for n, p in _SINGLES.items()},
    "type_mismatch": TYPE_MISMATCH_SQL, "group_validation": GROUP_SQL, "top_parents": TOP_SQL, "inclusion_pairs": INCLUSION_SQL, "composite_containment": COMPOSITE_SQL,
    "partition_containment": PARTITION_SQL, "json_containment": JSON_SQL, "json_leaves": JSON_LEAVES_SQL,
}
