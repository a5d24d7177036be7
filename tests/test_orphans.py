import datetime as dt
import random

from pyspark.sql import functions as F

from quarrymark.operators import orphans

T = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def run(spark, children, parents):
    c = spark.createDataFrame(children, "id long, ref long, loaded timestamp, deleted string")
    p = spark.createDataFrame(parents, "id long, deleted timestamp, loaded timestamp, ref string")
    found = orphans.orphan_references(c, p, child_key="id", ref="ref", child_loaded="loaded", parent_key="id", deleted="deleted", parent_loaded="loaded")
    return {(r["row_id"], r["reason"]) for r in found.collect()}


def brute(children, parents):
    out = set()
    for i in {c[0] for c in children if c[0] is not None}:
        mine = sorted((c for c in children if c[0] == i), key=lambda c: (c[2] is not None, c[2] or 0, c[1] is not None, c[1] or 0))
        ref, first = mine[-1][1], min((c[2] for c in mine if c[2]), default=None)
        if ref is None:
            continue
        target = sorted((p for p in parents if p[0] == ref), key=lambda p: (p[2] is not None, p[2] or 0, p[1] is not None))
        if not target:
            out.add((i, "absent"))
        elif target[-1][1]:
            out.add((i, "deleted"))
        elif first and (loaded := min((p[2] for p in target if p[2]), default=None)) and loaded > first:
            out.add((i, "late"))
    return out


def test_random_against_brute_force(spark):
    r = random.Random(2)
    parents = [(r.randrange(80), r.choice([None, None, None, T(1)]), T(r.randrange(50)), "x") for _ in range(120)]
    children = [(r.randrange(300), r.choice([None, 5, r.randrange(100)]), r.choice([None, T(r.randrange(50))]), "x") for _ in range(400)]
    assert run(spark, children, parents) == brute(children, parents)


def test_empty_tables(spark):
    assert run(spark, [], [(1, None, T(0), "")]) == set()
    assert run(spark, [(1, 9, T(0), "")], []) == {(1, "absent")}


def test_equal_times_are_no_case(spark):
    assert run(spark, [(1, 9, T(5), "")], [(9, None, T(5), "")]) == set()


def test_filter_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(orphans, "MAX_BLOCKS", 0)
    parents = [(i, None, T(0), "") for i in range(0, 4000, 2)]
    children = [(i, i, T(9), "") for i in range(1000)]
    assert run(spark, children, parents) == {(i, "absent") for i in range(1, 1000, 2)}


def test_filter_grows_with_the_keys_and_rejects_most(spark):
    keys = spark.range(0, 60_000, 2).toDF("k")
    mask, blocks = orphans.bloom_filter(keys, "k", 30_000)
    assert blocks * orphans.KEYS_PER_BLOCK >= 30_000
    odd = spark.range(1, 60_000, 2).toDF("k").withColumn("block", orphans.bloom_block(F.col("k"), blocks)).join(mask, "block", "left")
    bits = orphans.bloom_mask(F.col("k"))
    assert odd.where(F.coalesce(F.col("mask").bitwiseAND(bits) == bits, F.lit(False))).count() < 0.1 * 30_000


def test_hot_reference(spark, monkeypatch):
    monkeypatch.setattr(orphans, "HOT_SHARE", 2)
    left = spark.createDataFrame([(1, i) for i in range(25_000)] + [(2, 7)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, w string")
    assert orphans.join_hot(left, right, ["k"], 25_001).groupBy("w").count().orderBy("w").collect() == [("a", 25_000), ("b", 1)]
