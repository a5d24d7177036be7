"""What relationships are found from: facts of all columns of a set of tables, and the values they share.

Every column whose class may take part in a key is compared, by its schema and not by its name.
The distinct values of all of them are made once, by one shuffle for each physical family, and
give both the distinct counts and the shared values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymark.functions import types as kinds
from quarrymark.operators import candidates, inclusion, profile
from quarrymark.operators.inclusion import Side
from quarrymark.sources.shared import staged

FACTS = ("column_id", "table_name", "column_name", "ordinal", "type_class", "row_count", "distinct_count", "null_pct", "min_val", "max_val", "is_pk", "is_unique", "eligible")


def scanned(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``column_facts`` of all columns of all tables with their type class; one scan of each table."""
    facts = reduce(DataFrame.unionByName, [profile.column_facts(df, t) for t, df in tables.items()])
    native = profile.catalog(spark, tables).select("table_name", "column_name", F.col("type_class").alias("native"))
    short = (F.col("native") == "STRING_LONG") & (F.col("longest") <= kinds.SHORT_LENGTH)
    return staged(facts.join(F.broadcast(native), ["table_name", "column_name"]).withColumn("type_class", F.when(short, "STRING_SHORT").otherwise(F.col("native"))).drop("native"), "scanned")


def measured(spark: SparkSession, tables: dict[str, DataFrame], declared: list[tuple[str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """Facts (FACTS, with is_implicit_pk) of every eligible column, and child_id, parent_id, shared of all pairs of them that share a value.

    declared: (table, column) of declared keys. column_id numbers the columns by table and name.
    """
    facts = scanned(spark, tables)
    pk = F.concat_ws(".", "table_name", "column_name").isin([f"{t}.{c}" for t, c in declared]) if declared else F.lit(False)
    facts = facts.withColumns({"is_pk": pk, "is_unique": F.lit(False)})
    facts = facts.withColumn("eligible", kinds.is_eligible(F.col("type_class"), F.col("column_name"), F.col("is_pk"), F.col("is_unique"))).where("eligible")
    names = [(r[0], r[1]) for r in facts.select("table_name", "column_name").orderBy("table_name", "column_name").collect()]  # names of columns
    if not names:
        none = spark.createDataFrame([], "child_id int, parent_id int, shared long")
        return facts.withColumns({"column_id": F.lit(0), "distinct_count": F.lit(0).cast("long"), "null_pct": F.lit(0.0), "is_implicit_pk": F.lit(False)}).select(*FACTS, "is_implicit_pk"), none
    held = staged(inclusion.memberships([Side(f"{t}.{c}", tables[t].select(f"`{c}`"), c) for t, c in names]), "memberships")
    ids = F.broadcast(spark.createDataFrame([(i, t, c, f"{t}.{c}") for i, (t, c) in enumerate(names)], "column_id int, table_name string, column_name string, name string"))
    sizes = inclusion.sizes_of(held).withColumnRenamed("size", "distinct_count")
    facts = facts.join(ids, ["table_name", "column_name"]).join(sizes, "name", "left").fillna(0, ["distinct_count"])
    facts = facts.withColumn("null_pct", F.round(F.when(F.col("row_count") > 0, F.col("null_count") / F.col("row_count")).otherwise(0.0), 6)).select(*FACTS)
    pairs = inclusion.pairs_of(held).select("child", "parent", "shared")
    number = lambda side: ids.select(F.col("column_id").alias(f"{side}_id"), F.col("name").alias(side))
    shared = pairs.join(number("child"), "child").join(number("parent"), "parent").select("child_id", "parent_id", "shared")
    return staged(candidates.reconciled_keys(candidates.implicit_keys(facts)), "facts"), staged(shared, "shared")


def pii_gate(columns: DataFrame, findings: DataFrame, least: float = 0.7) -> DataFrame:
    """columns with is_pii, and eligible taken from those with a finding that is validated or scores ``least``, unless they are keys or named id or *_id; findings: table_name, column_name, validated, score."""
    sure = findings.where(F.coalesce("validated", F.lit(False)) | (F.col("score") >= least)).select("table_name", "column_name", F.lit(True).alias("is_pii")).distinct()
    low = F.lower("column_name")
    structural = F.coalesce("is_pk", F.lit(False)) | F.coalesce("is_unique", F.lit(False)) | (low == "id") | low.endswith("_id")
    out = columns.join(sure, ["table_name", "column_name"], "left").withColumn("is_pii", F.coalesce("is_pii", F.lit(False)))
    return out.withColumn("eligible", F.col("eligible") & (~F.col("is_pii") | structural))


def refined_cardinality(relationships: DataFrame, counts: DataFrame, floor: float = 0.85) -> DataFrame:
    """relationships with refined: the cardinality, ONE_TO_ONE in place of MANY_TO_ONE where the confidence reaches the floor and every row of the child's column has a value of its own; counts: the child's key columns, total, distinct."""
    on = [c for c in counts.columns if c not in ("total", "distinct")]
    turns = (F.col("cardinality") == "MANY_TO_ONE") & (F.col("confidence") >= floor) & (F.col("total") > 0) & (F.col("total") == F.col("distinct"))
    out = relationships.join(counts, on, "left")
    return out.withColumn("refined", F.when(F.coalesce(turns, F.lit(False)), "ONE_TO_ONE").otherwise(F.col("cardinality"))).drop("total", "distinct")


def probed(tables: dict[str, DataFrame], pairs: list[tuple[str, str]]) -> DataFrame:
    """table_name, column_name, total, distinct of the (table, column) pairs; each table is read once. Unknown names are refused."""
    out = None
    for t in dict.fromkeys(t for t, _ in pairs):
        cols = [c for u, c in pairs if u == t]
        if t not in tables or set(cols) - set(tables[t].columns):
            raise ValueError(f"unknown table or column: {t}, {cols}")
        df = tables[t].select(*[f"`{c}`" for c in cols])
        total = df.agg(F.count(F.lit(1)).alias("total"))
        one = profile.distinct_counts(df).select(F.lit(t).alias("table_name"), "column_name", F.col("distinct_count").alias("distinct"))
        every = total.select("total", F.explode(F.array(*[F.lit(c) for c in cols])).alias("column_name"))
        one = every.join(one, "column_name", "left").select(F.lit(t).alias("table_name"), "column_name", "total", F.coalesce("distinct", F.lit(0)).alias("distinct"))
        out = one if out is None else out.unionByName(one)
    return out
