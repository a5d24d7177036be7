"""Fingerprints and quality metrics of whole columns.

A table is scanned once for what needs no shuffle (counts, nulls, extremes, text flaws). Exact
distinct counts come from the (column, value) pairs of all columns at once, made distinct
map-side before one shuffle; the sketch form needs no shuffle of values at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quarrymark.functions.types import physical_name, spark_class

#: Below so many estimated values a distinct count is made exact in the adaptive form.
EXACT_BELOW = 10_000
HLL_BITS = 14


def _text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def _stacked(df: DataFrame, structs: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*structs)))


def column_facts(df: DataFrame, table_name: str) -> DataFrame:
    """table_name, column_name, row_count, null_count, min_val, max_val, empty_count, padded_count, longest: one row per column, from one scan.

    min_val and max_val are extremes of the native values, as text; empty, padded and longest are
    of strings and null for other types. An empty table has zero counts and null extremes.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"v{i}"))
        ordered = not isinstance(f.dataType, (T.MapType, T.VariantType))
        aggs += [(F.min(c) if ordered else F.lit(None)).cast("string").alias(f"lo{i}"), (F.max(c) if ordered else F.lit(None)).cast("string").alias(f"hi{i}")]
        if isinstance(f.dataType, T.StringType):
            aggs += [F.count_if(c == "").alias(f"e{i}"), F.count_if(c != F.trim(c)).alias(f"p{i}"), F.max(F.length(c)).alias(f"l{i}")]
    one = df.agg(*aggs)
    none = F.lit(None).cast("long")
    rows = []
    for i, f in enumerate(df.schema.fields):
        text = isinstance(f.dataType, T.StringType)
        rows.append(
            F.struct(
                F.lit(table_name).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(i + 1).alias("ordinal"), F.col("n").alias("row_count"), (F.col("n") - F.col(f"v{i}")).alias("null_count"),
                F.col(f"lo{i}").alias("min_val"), F.col(f"hi{i}").alias("max_val"),
                (F.col(f"e{i}") if text else none).alias("empty_count"), (F.col(f"p{i}") if text else none).alias("padded_count"), (F.col(f"l{i}").cast("long") if text else none).alias("longest"),
            )
        )
    return _stacked(one, rows)


def _comparable(kind: T.DataType) -> T.DataType:
    """Type in which the values of a column are made distinct: columns of one such type go together, without turning numbers into text."""
    if isinstance(kind, T.IntegralType):
        return T.LongType()
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    return kind if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else T.StringType()


def distinct_counts(df: DataFrame) -> DataFrame:
    """column_name, distinct_count, distinct_lower (of strings): exact, nulls aside, from one shuffle of the distinct (column, value) pairs of each type."""
    groups: dict[str, list[tuple[int, str, bool]]] = {}
    for i, f in enumerate(df.schema.fields):
        groups.setdefault(_comparable(f.dataType).simpleString(), []).append((i, f.name, isinstance(f.dataType, T.StringType)))
    parts = []
    for kind, fields in groups.items():
        pairs = _stacked(df, [F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast(kind).alias("value"), F.lit(text).alias("is_text")) for i, c, text in fields])
        values = pairs.where("value is not null").distinct()
        if any(text for _, _, text in fields):
            # lower-case forms fold on the values' own partitioning, so that a column's set is never in one task
            values = values.groupBy("i", "is_text", F.when(F.col("is_text"), F.lower("value")).otherwise(F.col("value")).alias("low")).agg(F.count("*").alias("n"))
        else:
            values = values.withColumn("n", F.lit(1))
        parts.append(values.groupBy("i").agg(F.sum("n").cast("long").alias("distinct_count"), F.max("is_text").alias("is_text"), F.count("*").alias("low")))
    names = F.array(*[F.lit(c) for c in df.columns])
    return union_all(parts).select(names[F.col("i")].alias("column_name"), "distinct_count", F.when(F.col("is_text"), F.col("low")).alias("distinct_lower"))


def fingerprints(df: DataFrame, table_name: str, max_length: dict[str, int] | None = None) -> DataFrame:
    """column_facts with exact distinct counts, null_pct and cardinality_method ``exact``."""
    facts = column_facts(df, table_name).join(distinct_counts(df), "column_name", "left").fillna(0, ["distinct_count"])
    pct = F.when(F.col("row_count") > 0, F.col("null_count") / F.col("row_count")).otherwise(0.0)
    return facts.withColumn("null_pct", F.round(pct, 6)).withColumn("cardinality_method", F.lit("exact"))


def sketched_fingerprints(df: DataFrame, table_name: str) -> DataFrame:
    """table_name, column_name, estimate, sketch: HLL++ estimates and mergeable theta sketches of each column, in one scan without shuffling values.

    Sketches of two columns tell their overlap by theta_intersection; use them where exact
    counts are not worth a shuffle.
    """
    aggs, rows = [], []
    for i, f in enumerate(df.schema.fields):
        aggs += [F.approx_count_distinct(_text(f.name), 0.01).alias(f"a{i}"), F.call_function("theta_sketch_agg", _text(f.name)).alias(f"t{i}")]
        rows.append(F.struct(F.lit(table_name).alias("table_name"), F.lit(f.name).alias("column_name"), F.col(f"a{i}").alias("estimate"), F.col(f"t{i}").alias("sketch")))
    return _stacked(df.agg(*aggs), rows)


def adaptive_fingerprints(df: DataFrame, table_name: str) -> DataFrame:
    """As ``fingerprints``, exact only for columns estimated below EXACT_BELOW; others keep the estimate and say ``hll++``."""
    estimated = sketched_fingerprints(df, table_name).select("column_name", "estimate")
    few = [r["column_name"] for r in estimated.where(F.col("estimate") < EXACT_BELOW).collect()]  # names of columns
    facts = column_facts(df, table_name).join(estimated, "column_name")
    if few:
        facts = facts.join(distinct_counts(df.select(*[f"`{c}`" for c in few])), "column_name", "left")
    else:
        facts = facts.withColumn("distinct_count", F.lit(None).cast("long")).withColumn("distinct_lower", F.lit(None).cast("long"))
    exact = F.col("column_name").isin(few)
    return facts.withColumn("distinct_count", F.when(exact, F.coalesce("distinct_count", F.lit(0))).otherwise(F.col("estimate"))).withColumn("cardinality_method", F.when(exact, "exact").otherwise("hll++")).drop("estimate")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, ordinal, physical_type, type_class: of the tables' schemas, without reading data."""
    rows = [(t, f.name, i + 1, physical_name(f.dataType), spark_class(f.dataType)) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, physical_type string, type_class string")


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of each file of a Parquet table, by position and not by arrival."""
    return df.where(F.col("_metadata.row_index") < n)


def every_kth(df: DataFrame, rows: int, at_most: int) -> DataFrame:
    """A systematic sample of at most about at_most rows: each row whose position in its file is a multiple of the stride."""
    stride = max(1, -(-rows // at_most))
    return df.where(F.col("_metadata.row_index") % stride == 0)


#: Finding, severity and condition of each quality rule; f is what the fraction is of.
def quality_findings(metrics: DataFrame, null_threshold: float = 0.5, low_floor: int = 5, low_min_rows: int = 1000) -> DataFrame:
    """table_name, column_name, finding, severity, count, fraction from fingerprints with is_pk (boolean, the only key column).

    ALL_NULL takes the place of NULL_HEAVY. DUPLICATE_PK counts non-null values beyond the
    distinct ones; MIXED_CASE the values that differ only in case. Fractions have four digits.
    """
    c = F.col
    filled = c("row_count") - c("null_count")
    share = lambda n, of: F.round(F.when(of > 0, n / of).otherwise(0.0), 4)
    rule = lambda when, name, severity, n, of: F.when(when, F.struct(F.lit(name).alias("finding"), F.lit(severity).alias("severity"), n.cast("long").alias("count"), share(n, of).alias("fraction")))
    all_null = (c("row_count") > 0) & (c("null_count") == c("row_count"))
    pk = F.coalesce(c("is_pk"), F.lit(False))
    rules = [
        rule(all_null, "ALL_NULL", "HIGH", c("null_count"), c("row_count")),
        rule(~all_null & (c("row_count") > 0) & (c("null_count") >= null_threshold * c("row_count")), "NULL_HEAVY", "MEDIUM", c("null_count"), c("row_count")),
        rule(pk & (c("distinct_count") < filled), "DUPLICATE_PK", "HIGH", filled - c("distinct_count"), filled),
        rule(c("padded_count") > 0, "LEADING_TRAILING_WHITESPACE", "LOW", c("padded_count"), c("row_count")),
        rule(c("empty_count") > 0, "EMPTY_STRING", "LOW", c("empty_count"), c("row_count")),
        rule(c("distinct_lower") < c("distinct_count"), "MIXED_CASE", "MEDIUM", c("distinct_count") - c("distinct_lower"), c("distinct_count")),
        rule(~pk & (c("row_count") >= low_min_rows) & (c("distinct_count") > 0) & (c("distinct_count") < low_floor), "LOW_CARDINALITY", "LOW", c("distinct_count"), c("row_count")),
    ]
    return metrics.select("table_name", "column_name", F.inline(F.array_compact(F.array(*rules))))
