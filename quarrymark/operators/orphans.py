"""References to records that do not exist, are deleted or arrive later.

Method: the parent keys fill a Bloom filter of blocks, kept as a table (block, 64-bit mask) sized
by the number of keys. The different values of the references are probed: one that the filter
rejects is a definite orphan, and only the others are verified, by an exact join with the parents.
Up to MAX_BLOCKS the filter is broadcast; beyond, it lies partitioned by the hash of its blocks
and is joined by shuffle, and rejects as many as before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quarrymark.sources.shared import staged

#: The greatest filter that is broadcast: 2^20 rows of two longs, for 4 million keys.
MAX_BLOCKS = 2**20
KEYS_PER_BLOCK = 4
#: A reference value with more rows than the 1/HOT_SHARE part is joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def bloom_mask(key: Column, salt: int = 7) -> Column:
    """The four bits of a key within its 64-bit block, as a long."""
    h = F.xxhash64(key, F.lit(salt))
    places = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(4)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("long"), x) for x in places])


def bloom_block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_filter(parents: DataFrame, key: str, keys: int) -> tuple[DataFrame, int]:
    """(block, mask) of the keys, and the number of blocks, a power of two with KEYS_PER_BLOCK keys in each at most on average."""
    blocks = 64
    while blocks * KEYS_PER_BLOCK < keys:
        blocks *= 2
    return parents.groupBy(bloom_block(F.col(key), blocks).alias("block")).agg(F.bit_or(bloom_mask(F.col(key))).alias("mask")), blocks


def parent_states(parents: DataFrame, key: str, deleted: str, loaded: str) -> DataFrame:
    """ref, first_loaded, deleted: one row per non-null key; deleted as in the row with the latest load.

    Deliveries of one key at the same latest time: deleted if any of them is. A null load time
    counts as earliest for "latest", and as unknown for first_loaded.
    """
    deleted_flag = F.col(deleted).isNotNull()
    return (
        parents.where(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("long").alias("ref"))
        .agg(F.min(loaded).alias("first_loaded"), F.max(F.struct(F.col(loaded), deleted_flag.alias("d"))).alias("_last"))
        .select("ref", "first_loaded", F.col("_last.d").alias("deleted"))
    )


def child_references(children: DataFrame, key: str, ref: str, loaded: str) -> DataFrame:
    """row_id, ref, child_loaded: one row per child id with the reference of its latest delivery and its first load.

    Children without id or whose latest reference is null refer to nothing and are left out.
    """
    return (
        children.where(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("long").alias("row_id"))
        .agg(F.max(F.struct(F.col(loaded), F.col(ref).cast("long").alias("ref"))).alias("_last"), F.min(loaded).alias("child_loaded"))
        .select("row_id", F.col("_last.ref").alias("ref"), "child_loaded")
        .where("ref is not null")
    )


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Inner join on keys, unique in right, where a few keys may hold most of left's rows.

    Keys with more than rows/HOT_SHARE of left's rows, fewer than HOT_SHARE, go by a broadcast of
    right's rows for them; the others by shuffle.
    """
    least = max(rows // HOT_SHARE, 10_000)
    if rows <= least:  # no key can be hot
        return left.join(right, keys)
    hot = left.groupBy(*keys).count().where(F.col("count") > least).select(*keys, F.lit(True).alias("_hot"))
    hot = F.broadcast(staged(hot, "hot"))
    marked = left.join(hot, keys, "left")
    few = right.join(hot.drop("_hot"), keys, "left_semi")
    return marked.where("_hot").drop("_hot").join(F.broadcast(few), keys).unionByName(marked.where("_hot is null").drop("_hot").join(right, keys))


def orphan_references(children: DataFrame, parents: DataFrame, *, child_key: str, ref: str, child_loaded: str, parent_key: str, deleted: str, parent_loaded: str) -> DataFrame:
    """row_id, child_loaded, reason: the children whose reference is ``absent``, ``deleted`` or ``late``.

    absent: the target is in no row of parents; deleted: so marked in its latest row; late:
    first loaded after the child was (equal or unknown times are no case). One row per child id;
    empty tables give no rows, an empty parent table makes every reference absent.
    """
    states = staged(parent_states(parents, parent_key, deleted, parent_loaded), "parents")
    refs = staged(child_references(children, child_key, ref, child_loaded), "references")
    mask, blocks = bloom_filter(states, "ref", states.count())
    used = refs.groupBy("ref").agg(F.min("child_loaded").alias("earliest")).withColumn("block", bloom_block(F.col("ref"), blocks))
    probed = used.join(F.broadcast(mask) if blocks <= MAX_BLOCKS else mask, "block", "left")
    bits = bloom_mask(F.col("ref"))
    maybe = F.coalesce(F.col("mask").bitwiseAND(bits) == bits, F.lit(False))
    probed = staged(probed.select("ref", "earliest", maybe.alias("maybe")), "probed")
    definite = probed.where("not maybe").select("ref", F.lit(None).cast("boolean").alias("deleted"), F.lit(None).cast("timestamp").alias("first_loaded"))
    # only values with a finding leave the exact join: absent, deleted, or loaded after some child
    verified = probed.where("maybe").join(states, "ref", "left").where("deleted is null or deleted or first_loaded > earliest").select("ref", "deleted", F.col("first_loaded").cast("timestamp").alias("first_loaded"))
    late = F.col("first_loaded") > F.col("child_loaded")
    reason = F.when(F.col("deleted").isNull(), "absent").when(F.col("deleted"), "deleted").when(late, "late")
    bad = staged(definite.unionByName(verified), "bad")
    return join_hot(refs, bad, ["ref"], refs.count()).select("row_id", "child_loaded", reason.alias("reason")).where("reason is not null")


def orphan_counts(found: DataFrame) -> DataFrame:
    """child_table, month, reason, orphan_count from rows (child_table, row_id, child_loaded, reason)."""
    return found.groupBy("child_table", F.date_format("child_loaded", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("orphan_count"))
