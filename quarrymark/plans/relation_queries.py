"""Queries on candidate and validated relationships of the star schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymark.operators import candidates, discovery, inclusion
from quarrymark.plans.column_queries import STAR
from quarrymark.sources.tables import table


def measured(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Facts of all eligible columns of the star schema, and the values that pairs of them share."""
    return discovery.measured(spark, {t: table(spark, d, t) for t in STAR})


def implicit_keys(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d)[0].select("table_name", "column_name", "distinct_count", "is_implicit_pk", "is_unique")


_REALS = ("c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value")
_TIMES = ("o_orderdate", "l_shipdate", "ts")


def _fact_sql(t: str, i: int, c: str, text: bool) -> str:
    group = "STRING" if text else "TIMESTAMP" if c in _TIMES else "INT"
    held = f"coalesce(max(length({c})), 65) <= 64" if text else "true"
    return f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS ordinal, '{group}' AS g, {held} AS eligible, count(*) AS n, count(DISTINCT {c}) AS d, (count(*) - count({c})) / greatest(count(*), 1) AS null_pct FROM {t}"


IMPLICIT_SQL = (
    "WITH f AS (" + " UNION ALL ".join(_fact_sql(t, i, c.rstrip("*"), c.endswith("*")) for t, cols in STAR.items() for i, c in enumerate(cols.split()) if c.rstrip("*") not in _REALS)
    + """), k AS (SELECT *, n >= 2 AND abs(d - n) <= 0.03 * n AND null_pct <= 0.01 AS is_key FROM f WHERE eligible),
s AS (SELECT *, CASE WHEN lower(table_name) LIKE '%s' AND lower(table_name) NOT LIKE '%ss' THEN left(lower(table_name), length(table_name) - 1) ELSE lower(table_name) END AS one FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY table_name, is_key ORDER BY CASE WHEN lower(column_name) = 'id' THEN 0 WHEN lower(column_name) = lower(table_name) || '_id' THEN 1 WHEN lower(column_name) = one || '_id' THEN 2 ELSE 3 END, ordinal) AS rn FROM s),
i AS (SELECT *, is_key AND rn = 1 AS first_key, is_key AND rn > 1 AS other_key FROM r),
sc AS (SELECT a.table_name, a.column_name, a.g, 10 * (SELECT count(DISTINCT b.table_name) FROM k b WHERE b.table_name <> a.table_name AND lower(b.column_name) IN (lower(a.table_name) || '_id', a.one || '_id'))
  + CASE WHEN lower(a.column_name) = 'id' THEN 2 WHEN lower(a.column_name) IN (lower(a.table_name) || '_id', a.one || '_id') THEN 1 ELSE 0 END AS score FROM i a WHERE first_key),
l AS (SELECT table_name, column_name, score < max(score) OVER (PARTITION BY g) AS lost FROM sc)
SELECT table_name, column_name, d AS distinct_count, first_key AND NOT coalesce(lost, false) AS is_implicit_pk, other_key OR coalesce(lost, false) AS is_unique FROM i LEFT JOIN l USING (table_name, column_name)
"""
)


def fk_candidates(spark: SparkSession, d: str) -> DataFrame:
    out = candidates.discovered(*measured(spark, d))
    return out.select("child_table_name", "child_column_name", "parent_table_name", "parent_column_name", "source_stage", "tier", "confidence", F.round("name", 4).alias("name_similarity"), "estimated_containment", "parent_pk_unknown", "note")


def fk_relationships(spark: SparkSession, d: str) -> DataFrame:
    columns, shared = measured(spark, d)
    return candidates.inherited(candidates.validated(candidates.discovered(columns, shared), shared), columns).drop("child_column_id", "parent_column_id")


def recorded_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of the recorded relationships, from their recorded figures and no name or Jaccard."""
    r = table(spark, d, "relationships")
    zero = F.lit(0.0)
    keys = table(spark, d, "col_inventory").select(F.col("column_id").alias("parent_col_id"), "is_pk", "is_unique_indexed")
    out = r.join(keys, "parent_col_id")
    score = candidates.confidence(F.coalesce("containment_full", zero), zero, F.col("is_pk"), F.col("is_unique_indexed"), F.coalesce("child_distinct", F.lit(0)), F.coalesce("parent_distinct", F.lit(0)), zero)
    return out.select("rel_id", score.alias("score"))


CONFIDENCE_SQL = """
SELECT rel_id, round(greatest(0.0, least(1.0, 0.40 * greatest(0.0, least(1.0, coalesce(containment_full, 0.0))) + 0.15 * CASE WHEN is_pk THEN 1.0 WHEN is_unique_indexed THEN 0.5 ELSE 0.0 END
  + 0.10 * CASE WHEN coalesce(r.child_distinct, 0) <= 0 OR coalesce(r.parent_distinct, 0) <= 0 THEN 0.0 WHEN r.child_distinct / r.parent_distinct <= 1.05 THEN 1.0 ELSE greatest(0.0, 1 - (r.child_distinct / r.parent_distinct - 1.05) / 0.95) END)), 4)::DOUBLE AS score
FROM relationships r JOIN col_inventory c ON c.column_id = r.parent_col_id
"""


def exact_relationships(spark: SparkSession, d: str) -> DataFrame:
    """The recorded relationships with the figures that the key values really have."""
    kv = table(spark, d, "key_values").where("key_value is not null and key_value <> ''").select("column_id", "key_value").distinct()
    r = table(spark, d, "relationships").select("rel_id", "child_col_id", "parent_col_id")
    sizes = kv.groupBy("column_id").agg(F.count("*").alias("n"))
    a = r.join(kv, F.col("child_col_id") == F.col("column_id")).select("rel_id", "parent_col_id", "key_value")
    b = kv.select(F.col("column_id").alias("parent_col_id"), "key_value")
    shared = a.join(b, ["parent_col_id", "key_value"]).groupBy("rel_id").agg(F.count("*").alias("shared"))
    out = r.join(sizes.select(F.col("column_id").alias("child_col_id"), F.col("n").alias("child_distinct")), "child_col_id").join(sizes.select(F.col("column_id").alias("parent_col_id"), F.col("n").alias("parent_distinct")), "parent_col_id")
    out = out.join(shared, "rel_id", "left").withColumn("orphans", F.col("child_distinct") - F.coalesce("shared", F.lit(0)))
    return inclusion._judged(out, 0.95).select("rel_id", "child_distinct", "parent_distinct", "orphans", "containment", "cardinality")


EXACT_SQL = """
WITH kv AS (SELECT DISTINCT column_id, key_value FROM key_values WHERE key_value <> ''), s AS (SELECT column_id, count(*) AS n FROM kv GROUP BY 1),
sh AS (SELECT rel_id, count(*) AS shared FROM relationships r JOIN kv a ON a.column_id = child_col_id JOIN kv b ON b.column_id = parent_col_id AND b.key_value = a.key_value GROUP BY 1),
x AS (SELECT rel_id, p.n AS child_distinct, q.n AS parent_distinct, p.n - coalesce(shared, 0) AS orphans FROM relationships JOIN s p ON p.column_id = child_col_id JOIN s q ON q.column_id = parent_col_id LEFT JOIN sh USING (rel_id))
SELECT *, round(CASE WHEN child_distinct > 0 THEN 1 - orphans / child_distinct ELSE 0.0 END, 4) AS containment,
  CASE WHEN orphans = 0 AND child_distinct = parent_distinct THEN 'ONE_TO_ONE' WHEN orphans = 0 AND child_distinct > 0 THEN 'MANY_TO_ONE' WHEN child_distinct > 0 AND 1 - orphans / child_distinct >= 0.95 THEN 'PARTIAL' ELSE 'NO_RELATIONSHIP' END AS cardinality FROM x
"""

QUERIES = {"implicit_keys": implicit_keys, "fk_candidates": fk_candidates, "fk_relationships": fk_relationships, "recorded_confidence": recorded_confidence, "exact_relationships": exact_relationships}
ORACLE = {"implicit_keys": IMPLICIT_SQL, "recorded_confidence": CONFIDENCE_SQL, "exact_relationships": EXACT_SQL}
