import random
from itertools import combinations

from quarrymark.llm import overlap


def test_against_sets(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 2, 3, 4, None]), r.choice([None, "", "hot", "hot", str(r.randrange(60)), " 1"]), 5) for _ in range(900)]
    sets = {c: {i for k, i, _ in rows if k == c and i} for c in (1, 2, 3, 4)}
    got = {(x["a"], x["b"]): (x["shared"], x["size_a"], x["size_b"]) for x in overlap.overlaps(spark.createDataFrame(rows, "code long, ident string, size long"), "code", "ident").collect()}
    assert got == {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in combinations(sets, 2) if sets[a] & sets[b]}


def test_empty_and_disjoint(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "A")], "c long, i string")
    assert overlap.overlaps(df, "c", "i").count() == 0 and overlap.overlaps(df.limit(0), "c", "i").count() == 0


def test_an_identifier_of_very_many_sets(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SPLIT_FROM", 4)
    rows = [(c, "all") for c in range(30)] + [(c, f"own{c % 7}") for c in range(30)] + [(1, None), (None, "x"), (2, "")]
    got = {(r["a"], r["b"]): r["shared"] for r in overlap.overlaps(spark.createDataFrame(rows, "code long, ident string"), "code", "ident").collect()}
    assert got == {(a, b): 1 + (a % 7 == b % 7) for a in range(30) for b in range(a + 1, 30)}
