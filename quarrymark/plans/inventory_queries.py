"""Queries on the inventory, the gates that depend on it, and read models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymark.operators import discovery, graph, inventory, sensitive_scan, views
from quarrymark.plans.column_queries import quality_findings as star_quality
from quarrymark.plans.schema_queries import _NAMED_SQL, QUALITY_OF_SCHEMAS, _by_schema, _columns, _edges, _priors, _prior_sql, _tables, table_edges
from quarrymark.sources.tables import table

#: A small catalog: two base tables, a view, a log; keys of one and of two columns, an index on an expression.
CATALOG = {
    "tables": ("table_name string, table_type string", [("people", "BASE TABLE"), ("visits", "BASE TABLE"), ("recent", "VIEW"), ("audit_log", "BASE TABLE")]),
    "columns": (
        "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, character_maximum_length int",
        [("people", "id", 1, "bigint", "NO", None), ("people", "code", 2, "character varying", "YES", 12), ("people", "note", 3, "text", "YES", None), ("visits", "person_id", 1, "bigint", "NO", None), ("visits", "seen_on", 2, "date", "NO", None), ("visits", "doc_id", 3, "text", "YES", None), ("recent", "id", 1, "bigint", "YES", None), ("audit_log", "id", 1, "integer", "NO", None)],
    ),
    "constraints": ("constraint_name string, table_name string, constraint_type string", [("people_pk", "people", "PRIMARY KEY"), ("visits_pk", "visits", "PRIMARY KEY"), ("visits_fk", "visits", "FOREIGN KEY")]),
    "key_usage": ("constraint_name string, table_name string, column_name string, ordinal_position int", [("people_pk", "people", "id", 1), ("visits_pk", "visits", "person_id", 1), ("visits_pk", "visits", "seen_on", 2), ("visits_fk", "visits", "person_id", 1)]),
    "refs": ("constraint_name string, parent_table string, parent_column string", [("visits_fk", "people", "id")]),
    "idx": ("indrelid long, indkey string, indisunique boolean, indisprimary boolean", [(10, "1", True, True), (10, "2", True, False), (20, "1 2", True, True), (20, "3 0", False, False), (99, "1", True, False)]),
    "att": ("attrelid long, attnum int, attname string", [(10, 1, "id"), (10, 2, "code"), (10, 3, "note"), (20, 1, "person_id"), (20, 2, "seen_on"), (20, 3, "doc_id"), (99, 1, "id")]),
    "cls": ("oid long, relname string, nspname string", [(10, "people", "app"), (20, "visits", "app"), (99, "people", "other")]),
}


def _literal(v: object) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)


_CATALOG_SQL = "WITH " + ", ".join(
    f"{name}({', '.join(c.split()[0] for c in schema.split(', '))}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)})" for name, (schema, rows) in CATALOG.items()
)


def _catalog(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame(rows, schema) for name, (schema, rows) in CATALOG.items()}


def index_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of the indexes of a small catalog: every column of a unique index is flagged, expressions and other schemas aren't."""
    c = _catalog(spark)
    return inventory.index_flags(c["idx"], c["att"], c["cls"], "app")


_FLAGS_SQL = _CATALOG_SQL + """, flags AS (
  SELECT relname AS table_name, attname AS column_name, bool_or(indisunique OR indisprimary) AS is_unique_indexed
  FROM (SELECT *, unnest(string_split(indkey, ' '))::INT AS n FROM idx) x JOIN cls ON oid = indrelid AND nspname = 'app' JOIN att ON attrelid = indrelid AND attnum = n GROUP BY ALL)
"""


def inventory_columns(spark: SparkSession, d: str) -> DataFrame:
    """The inventory that the same catalog gives."""
    c = _catalog(spark)
    return inventory.inventory(c["tables"], c["columns"], c["constraints"], c["key_usage"], index_flags(spark, d))


INVENTORY_SQL = _FLAGS_SQL + """, pk AS (SELECT DISTINCT table_name, column_name FROM constraints JOIN key_usage USING (constraint_name, table_name) WHERE constraint_type = 'PRIMARY KEY'),
x AS (SELECT c.table_name, c.column_name, ordinal_position AS ordinal, data_type, CASE data_type WHEN 'bigint' THEN 'INT_WIDE' WHEN 'integer' THEN 'INT_NARROW' WHEN 'date' THEN 'DATE' ELSE CASE WHEN character_maximum_length <= 64 THEN 'STRING_SHORT' ELSE 'STRING_LONG' END END AS type_class,
  is_nullable = 'YES' AS is_nullable, pk.table_name IS NOT NULL AS is_pk, f.table_name IS NOT NULL AS is_indexed, coalesce(f.is_unique_indexed, false) AS is_unique_indexed
  FROM columns c JOIN tables t ON t.table_name = c.table_name AND t.table_type = 'BASE TABLE' LEFT JOIN pk ON pk.table_name = c.table_name AND pk.column_name = c.column_name LEFT JOIN flags f ON f.table_name = c.table_name AND f.column_name = c.column_name)
SELECT *, type_class <> 'STRING_LONG' OR is_pk OR is_unique_indexed OR column_name LIKE '%\\_id' ESCAPE '\\' AS eligible, CASE WHEN table_name LIKE '%\\_log' ESCAPE '\\' THEN 'excluded' ELSE 'pending' END AS status, CASE WHEN table_name LIKE '%\\_log' ESCAPE '\\' THEN 'log_pattern' END AS exclusion_reason FROM x
"""


def declared_edges(spark: SparkSession, d: str) -> DataFrame:
    c = _catalog(spark)
    return inventory.declared_edges(c["constraints"], c["key_usage"], c["refs"])


DECLARED_SQL = _CATALOG_SQL + "SELECT k.table_name AS child_table, k.column_name AS child_column, parent_table, parent_column, 1.0::DOUBLE AS confidence, '1:N' AS cardinality FROM constraints c JOIN key_usage k USING (constraint_name) JOIN refs USING (constraint_name) WHERE constraint_type = 'FOREIGN KEY'"


def unexcluded(spark: SparkSession, d: str) -> DataFrame:
    """The recorded tables after a new look by which only names with _log are left out."""
    old = table(spark, d, "tbl_inventory").select("table_name", "status", "exclusion_reason", "parquet_path")
    now = old.select("table_name", F.when(F.col("table_name").rlike("_log$"), "log_pattern").alias("exclusion_reason"))
    return inventory.re_inventoried(old, now)


UNEXCLUDED_SQL = """
SELECT table_name, CASE WHEN table_name LIKE '%\\_log' ESCAPE '\\' THEN 'excluded' WHEN status = 'excluded' THEN 'pending' ELSE status END AS status,
  CASE WHEN table_name LIKE '%\\_log' ESCAPE '\\' THEN 'log_pattern' WHEN status = 'excluded' THEN NULL ELSE exclusion_reason END AS exclusion_reason, CASE WHEN table_name NOT LIKE '%\\_log' ESCAPE '\\' AND status = 'excluded' THEN NULL ELSE parquet_path END AS parquet_path FROM tbl_inventory
"""


def schema_scope(spark: SparkSession, d: str) -> DataFrame:
    """Inventoried columns of the first two schemas by name."""
    t = table(spark, d, "tbl_inventory")
    first = [r[0] for r in t.select("schema_name").distinct().orderBy("schema_name").limit(2).collect()]
    return inventory.in_scope(_columns(spark, d), first).select("schema_name", "table_name", "column_name")


SCOPE_SQL = _NAMED_SQL + "SELECT schema_name, table_name, column_name FROM c WHERE schema_name IN (SELECT DISTINCT schema_name FROM tbl_inventory WHERE schema_name IS NOT NULL ORDER BY 1 LIMIT 2)"


def pii_fk_gate(spark: SparkSession, d: str) -> DataFrame:
    """Inventoried columns that names mark as personal, and which of them stay eligible as keys."""
    c = _columns(spark, d).select("table_name", "column_name", "is_pk", F.col("is_unique_indexed").alias("is_unique"), F.coalesce("is_fk_eligible", F.lit(False)).alias("eligible"))
    found = _priors(spark, d).withColumn("validated", F.lit(False))
    return discovery.pii_gate(c, found).select("table_name", "column_name", "is_pii", "eligible")


GATE_SQL = _NAMED_SQL + f""", p AS (SELECT DISTINCT table_name, column_name FROM ({_prior_sql()}) WHERE score >= 0.7)
SELECT table_name, column_name, p.table_name IS NOT NULL AS is_pii, coalesce(is_fk_eligible, false) AND (p.table_name IS NULL OR coalesce(is_pk, false) OR coalesce(is_unique_indexed, false) OR lower(column_name) = 'id' OR lower(column_name) LIKE '%\\_id' ESCAPE '\\') AS eligible
FROM c LEFT JOIN p USING (table_name, column_name)
"""


def cardinality_refined(spark: SparkSession, d: str) -> DataFrame:
    """The recorded relationships with the cardinality that the newest identifiers of the child's column speak for."""
    kv = table(spark, d, "key_values").where("column_id is not null")
    newest = kv.groupBy("column_id").agg(F.max("load_no").alias("load_no"))
    counts = kv.join(newest, ["column_id", "load_no"]).groupBy(F.col("column_id").alias("child_col_id")).agg(F.count("*").alias("total"), F.count_distinct("key_value").alias("distinct"))
    r = table(spark, d, "relationships").select("rel_id", "child_col_id", "cardinality", "confidence")
    return discovery.refined_cardinality(r, counts, floor=0.5).select("rel_id", "cardinality", "refined")


REFINED_SQL = """
WITH k AS (SELECT *, max(load_no) OVER (PARTITION BY column_id) AS newest FROM key_values), n AS (SELECT column_id, count(*) AS total, count(DISTINCT key_value) AS d FROM k WHERE load_no = newest GROUP BY 1)
SELECT rel_id, cardinality, CASE WHEN cardinality = 'MANY_TO_ONE' AND confidence >= 0.5 AND total = d THEN 'ONE_TO_ONE' ELSE cardinality END AS refined FROM relationships LEFT JOIN n ON column_id = child_col_id
"""
_PROBED = [("orders", "o_orderkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("events", "event_type"), ("candidates", "id")]


def cardinality_probe(spark: SparkSession, d: str) -> DataFrame:
    return discovery.probed({t: table(spark, d, t) for t, _ in _PROBED}, _PROBED)


PROBE_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS total, count(DISTINCT {c}) AS \"distinct\" FROM {t}" for t, c in _PROBED)

#: Counts of matches by column and kind (null: cells), and what each column's name implies, written out for SQL.
COUNTS_SCHEMA = "table_name string, column_name string, kind string, matched long, valid long, example string"
COUNTS = [
    ("users", "email", None, 100, 0, None), ("users", "email", "EMAIL", 95, 95, "a***@b***.org"), ("users", "email", "CARD_HOLDER_NAME", 40, 40, "A***"), ("users", "notes", None, 200, 0, None), ("users", "notes", "EMAIL", 12, 12, "a***@b***.org"), ("users", "notes", "SSN_US", 4, 0, "***1234"),
    ("users", "order_id", None, 50, 0, None), ("users", "order_id", "MRN", 50, 50, "1***"), ("users", "password_hash", None, 50, 0, None), ("users", "password_hash", "API_KEY", 50, 10, "***"), ("users", "password_hash", "CREDENTIAL_HASH", 50, 50, "x***"), ("users", "phone", None, 80, 0, None), ("users", "city", None, 90, 0, None), ("users", "city", "ICD10", 3, 0, "A***"), ("users", "city", "IBAN", 9, 0, "***0001"),
    ("staff", "employee_ssn", None, 60, 0, None), ("staff", "employee_ssn", "SSN_US", 6, 0, "***6789"), ("staff", "empty", None, 0, 0, None),
]
PRIORS_SCHEMA = "column_name string, prior string, strength double"
PRIORS = [("email", "EMAIL", 0.85), ("phone", "PHONE", 0.85), ("password_hash", "CREDENTIAL_HASH", 0.85), ("employee_ssn", "SSN_US", 0.5)]


def pii_scores(spark: SparkSession, d: str) -> DataFrame:
    """What literal counts of matches come to: scores, suppression by names, findings by name alone, what is kept."""
    return sensitive_scan.findings(spark.createDataFrame(COUNTS, COUNTS_SCHEMA))


def _values(name: str, schema: str, rows: list[tuple]) -> str:
    return f"{name}({', '.join(c.split()[0] for c in schema.split(', '))}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)})"


SCORES_SQL = "WITH " + _values("m", COUNTS_SCHEMA, COUNTS) + ", " + _values("n", PRIORS_SCHEMA, PRIORS) + """
, c AS (SELECT table_name, column_name, matched AS cells, prior, strength, column_name IN ('order_id') AS pointer, column_name IN ('password_hash') AS credential, column_name IN ('notes') AS prose FROM m LEFT JOIN n USING (column_name) WHERE kind IS NULL),
x AS (SELECT c.*, kind, matched, valid, example, CASE WHEN kind = prior THEN strength ELSE 0.0 END AS s FROM c JOIN m USING (table_name, column_name) WHERE kind IS NOT NULL),
y AS (SELECT * FROM x WHERE NOT (s = 0 AND (pointer OR credential OR kind IN ('CARD_HOLDER_NAME', 'CARD_CVV', 'AADHAAR_IN'))))
SELECT table_name, column_name, kind AS pii_type, 'regex' AS detector, round(valid / cells, 4)::DOUBLE AS match_rate,
  round((1 - (1 - s) * (1 - least(1.0, matched / cells / 0.30)) * (1 - valid / matched)) * CASE WHEN prose AND s = 0 THEN 0.4 ELSE 1.0 END, 4)::DOUBLE AS score, valid > 0 AS validated, s > 0 AS name_prior, example
FROM y WHERE valid / cells >= 0.05 OR valid > 0 OR s > 0
UNION ALL SELECT table_name, column_name, prior, 'name_prior', 0.0, strength::DOUBLE, false, true, NULL FROM c WHERE prior IS NOT NULL AND NOT EXISTS (SELECT 1 FROM y WHERE y.table_name = c.table_name AND y.column_name = c.column_name AND y.kind = c.prior)
"""

# ---- read models -------------------------------------------------------------------


def relationship_directions(spark: SparkSession, d: str) -> DataFrame:
    """The recorded relationships with why they point the way they do."""
    c = table(spark, d, "col_inventory")
    of = lambda s: c.select(F.col("column_id").alias(f"{s}_col_id"), F.col("is_pk").alias(f"{s}_pk"), F.col("is_unique_indexed").alias(f"{s}_unique"))
    e = _edges(spark, d).join(of("child"), "child_col_id").join(of("parent"), "parent_col_id")
    why = views.direction_reason(F.col("child_column"), F.col("parent_column"), F.col("child_pk"), F.col("parent_pk"), F.col("parent_unique"))
    return e.select("rel_id", "child_table", "child_column", "parent_table", "parent_column", why.alias("direction_reason"))


DIRECTION_SQL = _NAMED_SQL + """
SELECT rel_id, child_table, child_column, parent_table, parent_column, CASE
  WHEN lower(child_column) IN ('manager_id', 'parent_id', 'head_id', 'owner_id', 'supervisor_id', 'referrer_id', 'reports_to', 'head_employee_id', 'head_user_id', 'approved_by', 'assigned_to', 'created_by', 'modified_by', 'updated_by', 'managed_by', 'posted_by', 'reported_by', 'reviewer_id', 'assigned_hr_id', 'submitted_by', 'received_by', 'from_id', 'to_id', 'predecessor_id', 'successor_id')
    AND (lower(parent_column) = 'id' OR lower(parent_column) LIKE '%\\_id' ESCAPE '\\') THEN 'role-FK bypass'
  WHEN coalesce(b.is_pk, false) AND NOT coalesce(a.is_pk, false) THEN 'declared PK on parent' WHEN coalesce(b.is_pk, false) AND coalesce(a.is_pk, false) THEN 'inheritance — both PKs, larger parent'
  WHEN coalesce(b.is_unique_indexed, false) THEN 'implicit PK reconciled' ELSE 'name similarity / containment' END AS direction_reason
FROM r JOIN col_inventory a ON a.column_id = child_col_id JOIN col_inventory b ON b.column_id = parent_col_id
"""


def schema_insights(spark: SparkSession, d: str) -> DataFrame:
    """insight, value: the patterns of the inventoried schema in one list."""
    c, e = _columns(spark, d), _edges(spark, d)
    time = graph.temporal_coverage(c, r"(?i)^(modified_date|modified_at|updated_at|updated_date|last_modified|last_updated|last_changed|date_modified)$")
    keys = graph.surrogate_keys(c)
    bridges = graph.bridges(c, e.select(F.col("child_table").alias("child"), F.col("parent_table").alias("parent")))
    supers = graph.supertypes(e.select(F.col("child_table").alias("child"), "child_column", F.col("parent_table").alias("parent")))
    named = lambda df, name, value: df.select(F.lit(name).alias("insight"), value.cast("double").alias("value"))
    out = [named(c.agg(F.count_distinct("table_name").alias("n")), "tables", F.col("n")), named(time, "temporal_fraction", F.col("fraction")), named(keys, "surrogate_pct", F.col("surrogate_pct")), named(keys, "integer_pct", F.col("integer_pct")), named(bridges.agg(F.count("*").alias("n")), "bridge_tables", F.col("n")), named(supers.agg(F.count("*").alias("n")), "supertypes", F.col("n"))]
    first, *rest = out
    for x in rest:
        first = first.unionByName(x)
    return first


def quality_view(spark: SparkSession, d: str) -> DataFrame:
    return views.quality_view(star_quality(spark, d)).select("rank", "table_name", "column_name", "finding", "severity", "count", "fraction")


def schema_detail(spark: SparkSession, d: str) -> DataFrame:
    """The schemas as clusters: their tables, rows, inner edges and edges to others."""
    return views.cluster_detail(_tables(spark, d), table_edges(spark, d), _by_schema(spark, d)).withColumnRenamed("cluster_id", "schema_name")


def source_schemas(spark: SparkSession, d: str) -> DataFrame:
    return views.source_schemas(table(spark, d, "tbl_inventory"))


QUERIES = {
    "index_flags": index_flags, "inventory": inventory_columns, "declared_edges": declared_edges, "unexcluded": unexcluded, "schema_scope": schema_scope, "pii_fk_gate": pii_fk_gate, "cardinality_refined": cardinality_refined, "cardinality_probe": cardinality_probe, "pii_scores": pii_scores,
    "relationship_directions": relationship_directions, "schema_insights": schema_insights, "quality_view": quality_view, "schema_detail": schema_detail, "source_schemas": source_schemas,
}
ORACLE = {
    "index_flags": _FLAGS_SQL + "SELECT * FROM flags", "inventory": INVENTORY_SQL, "declared_edges": DECLARED_SQL, "unexcluded": UNEXCLUDED_SQL, "schema_scope": SCOPE_SQL, "pii_fk_gate": GATE_SQL, "cardinality_refined": REFINED_SQL, "cardinality_probe": PROBE_SQL, "pii_scores": SCORES_SQL,
    "relationship_directions": DIRECTION_SQL, **QUALITY_OF_SCHEMAS, "source_schemas": "SELECT schema_name, count(*) AS table_count FROM tbl_inventory WHERE schema_name NOT IN ('pg_catalog', 'information_schema') GROUP BY 1",
}
