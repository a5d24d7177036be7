"""Operators that need names and declared types only: matching columns, sensitive names, domains and kinds of tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quarrymark.functions import names

#: Declared types that are never matched, and patterns of sensitive names.
UNSTRUCTURED = ("blob", "clob", "nclob", "bfile", "json", "jsonb", "xml", "bytea", "raw", "long raw", "image", "binary", "varbinary")
SENSITIVE_NAMES = (
    ("FINANCIAL", r"(?i)\b(salary|finance|amount|pay)\b"), ("PII", r"(?i)\b(email|phone|name|address)\b"),
    ("PHI", r"(?i)\b(health|ssn|dob|medical)\b"), ("HIGH_RISK_CREDENTIAL", r"(?i)\b(password|pwd|secret|key)\b"),
)


@F.pandas_udf(T.DoubleType())
def _match(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([max(names.indel_ratio(x, y), names.token_sort_ratio(x, y)) for x, y in zip(a, b)], dtype=float)


def matched_columns(columns: DataFrame, least: float = 55.0, most: float = 100.0) -> DataFrame:
    """Pairs of columns of different tables with the same declared type whose names match by least to most of 100.

    columns: table_id, column_id, column_name, data_type; pairs: table_id of a < that of b.
    """
    cols = columns.withColumn("kind", F.lower("data_type")).where(~F.col("kind").isin(*UNSTRUCTURED)).select("table_id", "column_id", F.lower("column_name").alias("name"), "kind")
    a = cols.select("kind", F.col("table_id").alias("table_a"), F.col("column_id").alias("column_a"), F.col("name").alias("name_a"))
    b = cols.select("kind", F.col("table_id").alias("table_b"), F.col("column_id").alias("column_b"), F.col("name").alias("name_b"))
    pairs = a.join(b, "kind").where("table_a < table_b").withColumn("score", _match("name_a", "name_b"))
    return pairs.where(F.col("score").between(least, most))


def scored(pairs: DataFrame, least: float = 0.0, most: float = 100.0) -> DataFrame:
    """pairs with 15 added where one name holds the other (two letters at least), at most 100."""
    holds = (F.length("name_a") >= 2) & (F.length("name_b") >= 2) & (F.contains("name_a", "name_b") | F.contains("name_b", "name_a"))
    total = F.least(F.lit(100.0), F.col("score") + F.when(holds, 15.0).otherwise(0.0))
    return pairs.withColumn("total", F.round(total, 4)).where(F.col("total").between(least, most))


def sensitive_name(column: Column) -> Column:
    """Class of a sensitive column name; an underscore is part of a word, so that user_email has none."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(SENSITIVE_NAMES):
        out = F.when(column.rlike(pattern), kind).otherwise(out)
    return out


def domain(table: Column) -> Column:
    has = lambda *parts: F.lower(table).rlike("|".join(parts))
    return F.when(has("cust", "user", "client"), "Customer Data").when(has("pay", "inv", "fin"), "Financial Data").otherwise("Miscellaneous Data")


def entity_type(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """table_name, table_type by ordered rules on name, degrees and number of columns; tables: table_name, n_cols; edges: child, parent."""
    out_n = edges.groupBy(F.col("child").alias("table_name")).agg(F.count("*").alias("n_out"))
    in_n = edges.groupBy(F.col("parent").alias("table_name")).agg(F.count("*").alias("n_in"))
    t = tables.join(out_n, "table_name", "left").join(in_n, "table_name", "left").fillna(0, ["n_out", "n_in"])
    name, ends = F.lower("table_name"), lambda *e: F.lower("table_name").rlike("_(" + "|".join(e) + ")$")
    kind = (
        F.when(name.rlike("config|settings|prop"), "Config").when(ends("hist", "history", "log", "audit"), "History / Log").when(ends("text", "tl", "i18n"), "Text / Translation")
        .when(ends("type", "status", "category", "code"), "Master Lookup").when((F.col("n_out") == 0) & (F.col("n_in") >= 1) & (F.col("n_cols") <= 8), "Master Lookup").when(ends("item", "detail", "line"), "Transaction (Item)")
        .when(name.rlike("header|order|invoice"), "Transaction (Header)").when((F.col("n_out") >= 2) & (F.col("n_cols") >= 8), "Transaction (Header)").otherwise("Standard Entity")
    )
    return t.select("table_name", kind.alias("table_type"))


def ratio_cardinality(a_distinct: Column, a_rows: Column, b_distinct: Column, b_rows: Column) -> Column:
    """1:N, N:1, M:N or 1:1 from distinct over rows of both sides; exactly 0.9 counts as neither."""
    a, b = a_distinct / a_rows, b_distinct / b_rows
    return F.when((a > 0.9) & (b < 0.9), "1:N").when((a < 0.9) & (b > 0.9), "N:1").when((a < 0.9) & (b < 0.9), "M:N").otherwise("1:1")
