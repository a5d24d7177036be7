import datetime as dt
import random

from quarrymark.operators import intervals

D = dt.date
SCHEMA = "entity long, a date, b date, s string"


def brute(rows):
    """Gaps and periods by marking days."""
    gaps, periods = set(), set()
    for e in {r[0] for r in rows if r[0] is not None}:
        mine = [(a, b or D(9999, 12, 31)) for x, a, b, _ in rows if x == e and a and (b is None or b >= a)]
        mine.sort()
        upto = start = None
        for a, b in mine:
            if upto is not None and upto < D(9999, 12, 31) and a > upto + dt.timedelta(1):
                gaps.add((e, upto + dt.timedelta(1), a - dt.timedelta(1)))
                periods.add((e, start, upto))
                start = a
            start = a if start is None else start
            upto = b if upto is None else max(upto, b)
        if mine:
            periods.add((e, start, None if upto == D(9999, 12, 31) else upto))
    return gaps, periods


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    gaps, periods = brute(rows)
    assert {tuple(r) for r in intervals.gaps(df, "entity", "a", "b").collect()} == gaps
    assert {tuple(r)[:3] for r in intervals.periods(df, "entity", "a", "b").collect()} == periods


def test_random_against_brute_force(spark):
    r = random.Random(1)
    day = lambda: D(2020, 1, 1) + dt.timedelta(r.randrange(900))
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([day(), day(), None]), r.choice([None, day(), day(), day(), D(9999, 12, 31)]) if r.random() < 0.1 else day(), "x") for _ in range(400)]
    check(spark, rows)


def test_hot_entity_over_many_partitions(spark):
    rows = [(7, D(2000, 1, 1) + dt.timedelta(i * 3), D(2000, 1, 1) + dt.timedelta(i * 3 + i % 4), "x") for i in range(2000)] + [(8, D(1960, 1, 1), D(1960, 1, 2), "x")]
    check(spark, rows)


def test_long_interval_carries_over_partitions(spark):
    check(spark, [(1, D(2000, 1, 1), D(2004, 1, 1), "")] + [(1, D(2000, 1, 2) + dt.timedelta(2 * i), D(2000, 1, 2) + dt.timedelta(2 * i), "") for i in range(1000)])


def test_ties_repeats_and_empty(spark):
    check(spark, [])
    check(spark, [(1, D(2020, 1, 1), D(2020, 1, 5), "a")] * 3 + [(1, D(2020, 1, 1), D(2020, 1, 2), "b"), (1, D(2020, 1, 6), D(2020, 1, 7), ""), (1, D(2020, 1, 9), None, None), (1, D(2021, 1, 1), D(2020, 1, 1), "")])


def test_gaps_survive_a_union(spark):
    a = spark.createDataFrame([(1, D(2020, 1, 1), D(2020, 1, 2), ""), (1, D(2020, 1, 9), D(2020, 1, 9), "")], SCHEMA)
    g = intervals.gaps(a, "entity", "a", "b")
    assert g.unionByName(g).count() == 2


def test_latest_version(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "b"), (2, None, "c"), (None, 1, "d"), (None, 2, "d")], "k long, v long, x string")
    assert sorted(map(tuple, intervals.latest_version(df, "k", "v").collect()), key=str) == sorted([(1, 7, "b"), (2, None, "c"), (None, 1, "d"), (None, 2, "d")], key=str)
