"""The gates and demotions of candidates on literal facts, with their SQL: names are given as similarities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymark.operators import candidates


def _literal(v: object) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)


def _values(name: str, schema: str, rows: list[tuple]) -> str:
    return f"{name}({', '.join(c.split()[0] for c in schema.split(', '))}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)})"


FACTS = "column_id int, table_name string, column_name string, ordinal int, type_class string, row_count long, distinct_count long, null_pct double, min_val string, max_val string, is_pk boolean, is_unique boolean, is_implicit_pk boolean, eligible boolean"
COLUMNS = [
    (0, "customers", "id", 1, "INT_WIDE", 500, 500, 0.0, "1000", "1499", True, False, False, True), (1, "orders", "id", 1, "INT_WIDE", 900, 900, 0.0, "5000", "5899", True, False, False, True),
    (2, "orders", "cust_ref", 2, "INT_WIDE", 900, 400, 0.1, "1000", "1499", False, False, False, True), (3, "staff", "id", 1, "INT_NARROW", 30, 30, 0.0, "1", "30", True, False, False, True),
    (4, "staff", "manager_id", 2, "INT_NARROW", 30, 4, 0.2, "1", "9", False, False, False, True), (5, "logs", "code", 1, "INT_WIDE", 200, 150, 0.0, "1010", "1300", False, False, False, True),
    (6, "logs", "line", 2, "INT_NARROW", 200, 200, 0.0, "1", "200", False, False, False, True), (7, "steps", "seq", 1, "INT_WIDE", 300, 300, 0.0, "1", "300", False, True, False, True),
    (8, "notes", "tag", 1, "STRING_SHORT", 400, 300, 0.0, "a", "z", False, False, False, True), (9, "tags", "name", 1, "STRING_SHORT", 350, 350, 0.0, "a", "z", False, True, False, True),
    (10, "days", "day", 1, "DATE", 365, 365, 0.0, "2024-01-01", "2024-12-30", False, False, True, True), (11, "visits", "on_day", 1, "DATE", 1000, 200, 0.0, "2024-02-01", "2024-03-30", False, False, False, True),
    (12, "visits", "amount", 2, "FLOAT", 1000, 900, 0.0, "0.0", "9.5", False, False, False, False), (13, "visits", "few", 3, "INT_WIDE", 1000, 20, 0.0, "1000", "1100", False, False, False, True),
    (14, "clients", "id", 1, "INT_WIDE", 450, 450, 0.0, "1000", "1449", True, False, False, True), (15, "visits", "client_code", 4, "INT_WIDE", 1000, None, 0.0, "1000", "1400", False, False, False, True),
]
SIMILAR = [(2, 0, 0.65), (8, 9, 0.5), (5, 0, 0.9), (11, 10, 0.62), (6, 7, 0.3), (7, 6, 0.9), (4, 3, 0.2), (13, 0, 0.9), (14, 0, 0.86), (0, 14, 0.86), (15, 0, 0.95), (5, 14, 0.4), (13, 14, 0.6)]
SHARED = [(2, 0, 380), (2, 14, 390), (5, 0, 150), (5, 14, 140), (8, 9, 290), (11, 10, 200), (6, 7, 200), (7, 6, 200), (13, 0, 20), (4, 3, 4), (14, 0, 450), (0, 14, 450), (3, 6, 30), (3, 7, 30)]
SIMILAR_SCHEMA, SHARED_SCHEMA = "child_column_id int, parent_column_id int, name double", "child_id int, parent_id int, shared long"


def _inputs(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.createDataFrame(COLUMNS, FACTS), spark.createDataFrame(SIMILAR, SIMILAR_SCHEMA), spark.createDataFrame(SHARED, SHARED_SCHEMA)


def candidate_gates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of both stages before any demotion."""
    columns, similar, shared = _inputs(spark)
    keep = ["source_stage", "child_column_id", "parent_column_id", "tier", "confidence", "estimated_containment", "sketch_jaccard", "parent_pk_unknown", "locked"]
    return candidates.prefiltered(columns, similar).select(*keep).unionByName(candidates.searched(columns, shared, similar).select(*keep))


def _dense(s: str) -> str:
    return f"{s}.type_class LIKE 'INT%' AND coalesce({s}.distinct_count, 0) > 0 AND {s}.null_pct < 0.01 AND TRY_CAST({s}.min_val AS BIGINT) = 1 AND abs(TRY_CAST({s}.max_val AS BIGINT) - {s}.distinct_count) <= 1"


_PAIRS_SQL = "WITH " + _values("f", FACTS, COLUMNS) + ", " + _values("s", SIMILAR_SCHEMA, SIMILAR) + ", " + _values("sh", SHARED_SCHEMA, SHARED) + f"""
, k AS (SELECT *, is_pk OR is_unique OR is_implicit_pk AS is_key, bool_or(is_pk OR is_unique OR is_implicit_pk) OVER (PARTITION BY table_name) AS keyed, CASE WHEN type_class LIKE 'INT%' THEN 'INT' WHEN type_class LIKE 'STRING%' THEN 'STRING' WHEN type_class IN ('DATE', 'TIMESTAMP', 'UUID') THEN type_class END AS g FROM f),
p AS (SELECT c.column_id AS child_column_id, p.column_id AS parent_column_id, c.is_pk AS c_pk, p.is_pk AS p_pk, p.is_key AS p_key, p.is_unique OR p.is_implicit_pk AS p_uniq, NOT p.is_key AS parent_pk_unknown, coalesce(s.name, 0.0) AS name, c.distinct_count AS cd, p.distinct_count AS pd,
    c.table_name <> p.table_name AS disjoint, c.column_name = 'manager_id' AND p.column_name = 'id' AND p.is_key AS bypass, coalesce({_dense('c')}, false) AND coalesce({_dense('p')}, false) AS dense,
    CASE c.g WHEN 'INT' THEN TRY_CAST(c.min_val AS BIGINT) >= TRY_CAST(p.min_val AS BIGINT) AND TRY_CAST(c.max_val AS BIGINT) <= TRY_CAST(p.max_val AS BIGINT) WHEN 'DATE' THEN TRY_CAST(c.min_val AS DATE) >= TRY_CAST(p.min_val AS DATE) AND TRY_CAST(c.max_val AS DATE) <= TRY_CAST(p.max_val AS DATE) END AS within
  FROM k c JOIN k p ON c.g = p.g AND c.column_id <> p.column_id LEFT JOIN s ON s.child_column_id = c.column_id AND s.parent_column_id = p.column_id
  WHERE c.eligible AND p.eligible AND (p.is_key OR NOT p.keyed) AND coalesce(c.distinct_count <= 1.05 * p.distinct_count, true) AND coalesce(p.distinct_count >= 0.95 * c.distinct_count, true)),
e AS (SELECT *, 'sql_prefilter' AS source_stage, 0.0 AS jac, 0.0 AS est FROM p UNION ALL SELECT *, least(1.0, jac * (cd + pd) / (1 + jac) / cd) AS est FROM (SELECT p.*, 'lsh_search' AS source_stage, shared / (cd + pd - shared) AS jac FROM p JOIN sh ON child_id = child_column_id AND parent_id = parent_column_id)),
v AS (SELECT * FROM e WHERE (source_stage = 'sql_prefilter' OR est >= 0.7 - 1e-9) AND NOT (dense AND NOT bypass AND (name < 0.4 OR (source_stage = 'sql_prefilter' AND name >= 0.85 AND disjoint))) AND coalesce(within, true)
  AND (coalesce(cd, 0) >= 100 OR CASE WHEN bypass THEN coalesce(cd, 0) >= 1 ELSE name >= 0.85 AND p_key END) AND NOT (source_stage = 'sql_prefilter' AND c_pk AND p_pk AND name <= 0.85 AND NOT bypass)),
gated AS (SELECT source_stage, child_column_id, parent_column_id, CASE WHEN bypass AND NOT parent_pk_unknown THEN 'primary' WHEN parent_pk_unknown OR (c_pk AND p_pk AND name <= 0.85) OR (dense AND name <= 0.6 AND NOT (p_key AND est >= 0.95 AND name > 0.3)) THEN 'advisory_lowconf' WHEN name > 0.6 OR est > 0.9 THEN 'primary' ELSE 'advisory_lowconf' END AS tier,
  round(greatest(0.0, least(1.0, 0.40 * est + 0.30 * name + 0.15 * CASE WHEN p_pk THEN 1.0 WHEN p_uniq THEN 0.5 ELSE 0.0 END + 0.10 * CASE WHEN coalesce(cd, 0) <= 0 OR coalesce(pd, 0) <= 0 THEN 0.0 WHEN cd / pd <= 1.05 THEN 1.0 ELSE greatest(0.0, 1 - (cd / pd - 1.05) / 0.95) END + 0.05 * jac)), 4)::DOUBLE AS confidence,
  round(est, 4)::DOUBLE AS estimated_containment, round(jac, 4)::DOUBLE AS sketch_jaccard, parent_pk_unknown, bypass AND NOT parent_pk_unknown AS locked FROM v)
"""
CANDIDATES = (
    "child_column_id int, parent_column_id int, child_table_name string, child_column_name string, parent_table_name string, parent_column_name string, tier string, confidence double, name double, estimated_containment double, locked boolean, "
    "parent_is_pk boolean, parent_is_unique boolean, parent_is_implicit_pk boolean, parent_is_key boolean, child_row_count long, child_distinct_count long, parent_row_count long, parent_distinct_count long"
)
#: Candidates that meet each rule: both directions decided by key, count, identity, name id and order; a child with several anchors; ranges; more than two of a child.
MADE = [
    (1, 2, "a", "x", "b", "id", "primary", 0.9, 0.9, 0.95, False, True, False, False, True, 100, 90, 100, 100), (2, 1, "b", "id", "a", "x", "primary", 0.8, 0.9, 0.95, False, False, False, False, False, 100, 100, 100, 90),
    (3, 4, "c", "k", "d", "k", "primary", 0.7, 0.9, 0.9, False, True, False, False, True, 60, 50, 80, 80), (4, 3, "d", "k", "c", "k", "primary", 0.7, 0.9, 0.9, False, True, False, False, True, 80, 80, 60, 50),
    (5, 6, "e", "m", "f", "m", "primary", 0.6, 0.9, 0.9, False, False, False, False, False, 100, 50, 100, 99), (6, 5, "f", "m", "e", "m", "primary", 0.6, 0.9, 0.9, False, False, False, False, False, 100, 99, 100, 50),
    (7, 8, "g", "id", "h", "y", "primary", 0.6, 0.9, 0.9, False, False, False, False, False, 100, 50, 100, 50), (8, 7, "h", "y", "g", "id", "primary", 0.6, 0.9, 0.9, False, False, False, False, False, 100, 50, 100, 50),
    (9, 10, "i", "z", "j", "z", "primary", 0.6, 0.9, 0.9, False, False, False, False, False, 100, 50, 100, 50), (10, 9, "j", "z", "i", "z", "primary", 0.6, 0.9, 0.9, False, False, False, False, False, 100, 50, 100, 50),
    (11, 20, "k", "r", "p", "r", "primary", 0.9, 0.8, 1.0, False, False, False, False, False, 100, 80, 100, 90), (11, 21, "k", "r", "q", "r", "primary", 0.85, 0.7, 1.0, False, False, False, False, False, 100, 80, 100, 90), (11, 22, "k", "r", "s", "r", "primary", 0.84, 0.7, 1.0, False, False, True, False, True, 100, 80, 100, 90), (11, 23, "k", "r", "t", "r", "primary", 0.83, 0.7, 1.0, True, False, False, False, False, 100, 80, 100, 90),
    (12, 20, "l", "u", "p", "r", "primary", 0.55, 0.3, 0.95, False, True, False, False, True, 100, 9, 100, 90), (12, 24, "l", "u", "v", "r", "primary", 0.52, 0.3, 0.95, True, True, False, False, True, 100, 9, 100, 90), (13, 20, "m", "u", "p", "r", "primary", 0.05, 0.3, 0.95, False, True, False, False, True, 100, 9, 100, 90),
    (14, 20, "n", "w", "p", "r", "primary", 0.9, 0.8, 0.9, False, True, False, False, True, 100, 80, 100, 90), (14, 21, "n", "w", "q", "r", "primary", 0.9, 0.8, 0.9, False, True, False, False, True, 100, 80, 100, 90), (14, 22, "n", "w", "s", "r", "primary", 0.7, 0.8, 0.9, False, True, False, False, True, 100, 80, 100, 90), (14, 23, "n", "w", "t", "r", "primary", 0.6, 0.8, 0.9, True, True, False, False, True, 100, 80, 100, 90), (14, 24, "n", "w", "v", "r", "advisory_lowconf", 0.95, 0.8, 0.9, False, True, False, False, True, 100, 80, 100, 90),
]


def candidate_demotions(spark: SparkSession, d: str) -> DataFrame:
    """Direction, anchors, ranges, the two best of each child and a cap of 12, one after the other."""
    df = spark.createDataFrame(MADE, CANDIDATES).withColumn("note", F.lit(None).cast("string"))
    out = candidates.range_penalty(candidates.one_anchor(candidates.one_direction(df)))
    return candidates.capped(candidates.best_of_child(out, 2), 12).select("child_column_id", "parent_column_id", "tier", "confidence", "note")


_ONE = "CASE WHEN abs({0}_row_count - {0}_distinct_count) <= 0.05 * {0}_row_count THEN 1 ELSE 0 END"
_LOSE = "SELECT * EXCLUDE (lose, tier, note), CASE WHEN lose THEN 'advisory_lowconf' ELSE tier END AS tier, CASE WHEN lose THEN '{0}' ELSE note END AS note FROM (SELECT *, coalesce(tier = 'primary' AND ({1}), false) AS lose FROM {2})"
DEMOTIONS_SQL = (
    "WITH " + _values("c0", CANDIDATES, MADE)
    + f""", c AS (SELECT *, NULL::VARCHAR AS note, (parent_is_implicit_pk OR parent_is_unique)::INT AS k, {_ONE.format('parent')} - {_ONE.format('child')} AS ident, (lower(parent_column_name) = 'id')::INT AS canon, parent_table_name || '|' || parent_column_name || '|' || child_table_name || '|' || child_column_name AS o FROM c0),
b AS (SELECT a.child_column_id AS x, a.parent_column_id AS y FROM c a JOIN c r ON r.child_column_id = a.parent_column_id AND r.parent_column_id = a.child_column_id WHERE a.tier = 'primary' AND r.tier = 'primary' AND NOT CASE
  WHEN a.parent_is_pk <> r.parent_is_pk THEN a.parent_is_pk WHEN ((a.parent_is_pk AND r.parent_is_pk) OR (a.k = 1 AND r.k = 1)) AND a.parent_distinct_count <> r.parent_distinct_count THEN a.parent_distinct_count > r.parent_distinct_count
  WHEN a.ident <> r.ident THEN a.ident > r.ident WHEN a.canon <> r.canon THEN a.canon > r.canon ELSE a.o <= r.o END),
d1 AS ({_LOSE.format('reverse_direction', '(child_column_id, parent_column_id) IN (SELECT (x, y) FROM b)', 'c')}),
d2 AS (SELECT *, count(*) OVER w AS fulls, min((-name, abs(coalesce(parent_row_count, parent_distinct_count) - child_distinct_count))) OVER w AS best FROM (SELECT *, tier = 'primary' AND estimated_containment >= 0.99 AS is_full FROM d1) WINDOW w AS (PARTITION BY child_column_id, is_full)),
d3 AS ({_LOSE.format('bridge_collision', 'is_full AND fulls >= 2 AND (-name, abs(coalesce(parent_row_count, parent_distinct_count) - child_distinct_count)) <> best AND NOT locked AND child_table_name <> parent_table_name AND NOT parent_is_key', 'd2')}),
d4 AS (SELECT * REPLACE (CASE WHEN lose THEN 'advisory_lowconf' ELSE tier END AS tier, CASE WHEN lose THEN 'range_overlap' ELSE note END AS note, CASE WHEN lose THEN greatest(0.0, round(confidence - 0.1, 4)) ELSE confidence END AS confidence) FROM (SELECT *, tier = 'primary' AND NOT locked AND child_table_name <> parent_table_name AND child_distinct_count > 0 AND child_distinct_count * 10 <= parent_distinct_count AND name < 0.5 AS lose FROM d3)),
d5 AS (SELECT * EXCLUDE (lose), row_number() OVER (PARTITION BY child_column_id, tier ORDER BY confidence DESC, parent_column_id) AS rn FROM d4),
d6 AS ({_LOSE.format('top_k', 'rn > 2 AND NOT locked', 'd5')}),
d7 AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY confidence DESC, child_column_id, parent_column_id) AS rc FROM d6),
d8 AS ({_LOSE.format('cap', 'rc > 12', 'd7')})
SELECT child_column_id, parent_column_id, tier, confidence, note FROM d8
"""
)

QUERIES = {"candidate_gates": candidate_gates, "candidate_demotions": candidate_demotions}
ORACLE = {"candidate_gates": _PAIRS_SQL + "SELECT * FROM gated", "candidate_demotions": DEMOTIONS_SQL}
