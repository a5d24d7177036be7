"""How many identifiers each pair of many large sets shares, without building the shared sets.

Method: rows (set, identifier) are deduplicated, which is done map-side before the shuffle, so
that an identifier or set with a third of all rows shrinks to its distinct pairs first. The
distinct rows are joined with themselves on the identifier, keeping a pair of sets once (a < b),
and counted per pair; the map-side part of that count follows the join in the same task, so that
shared identifiers are counted as they stream by and stored nowhere. Figures are exact.

An identifier held by k sets gives k^2/2 joined rows. From SPLIT_FROM sets on its rows are split
into blocks by set, one side copied to every block, so that no task has more than k * SPLIT_FROM
of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrymark.sources.shared import staged


#: An identifier in more sets than this is split into blocks of about as many sets.
SPLIT_FROM = 256


def distinct_members(df: DataFrame, set_col: str, id_col: str) -> DataFrame:
    """code, ident: distinct, written once; null sets, null identifiers and empty strings are left out, all else compared exactly."""
    rows = df.where(F.col(set_col).isNotNull() & F.col(id_col).isNotNull() & (F.col(id_col) != "")).select(F.col(set_col).alias("code"), F.col(id_col).alias("ident"))
    return staged(rows.distinct(), "members")


def overlaps(df: DataFrame, set_col: str, id_col: str) -> DataFrame:
    """a, b, shared, size_a, size_b, containment (shared over the smaller set), jaccard: every pair a < b sharing an identifier.

    An empty table, or one in which no identifier is shared, gives no rows.
    """
    members = distinct_members(df, set_col, id_col)
    sizes = members.groupBy("code").agg(F.count("*").alias("size"))
    # identifiers that very many sets hold, with their number of blocks
    wide = staged(members.groupBy("ident").agg(F.count("*").alias("k")).where(F.col("k") > SPLIT_FROM).select("ident", F.ceil(F.col("k") / SPLIT_FROM).cast("int").alias("blocks")), "wide")
    if wide.limit(1).count():
        marked = members.join(wide, "ident", "left").fillna(1, ["blocks"])
    else:
        marked = members.withColumn("blocks", F.lit(1))
    left = marked.select(F.col("code").alias("a"), "ident", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int").alias("block"))
    right = marked.select(F.col("code").alias("b"), "ident", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    shared = left.join(right, ["ident", "block"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(sizes.select(F.col("code").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("code").alias("b"), F.col("size").alias("size_b")), "b")
    return out.select("a", "b", "shared", "size_a", "size_b", (F.col("shared") / F.least("size_a", "size_b")).alias("containment"), (F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("jaccard"))
