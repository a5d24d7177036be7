import random

from quarrymark.operators import hierarchy


def brute(parent):
    out = {}
    for n in parent:
        path = [n]
        while (p := parent[path[-1]]) is not None and p in parent and p not in path:
            path.append(p)
        p = parent[path[-1]]
        if p is None or p not in parent:
            out[n] = (path[-1], len(path) - 1, False, path[::-1])
        else:
            out[n] = (min(path[path.index(p) :]), None, True, None)
    return out


def check(spark, parent):
    df = spark.createDataFrame(list(parent.items()) + [(None, 1)], "id long, p long")
    got = hierarchy.resolve(hierarchy.links(df, "t", "id", "p"), paths=True)
    assert {r["id"]: (r["root"], r["depth"], r["cyclic"], r["path"]) for r in got.collect()} == brute(parent)
    pairs = {(r["ancestor"], r["node"], r["distance"]) for r in hierarchy.descendants(got).collect()}
    assert pairs == {(a, n, len(path) - 1 - i) for n, (_, _, _, path) in brute(parent).items() if path for i, a in enumerate(path[:-1])}


def test_forest_with_cycles(spark):
    r = random.Random(3)
    parent = {n: r.choice([None, r.randrange(60), r.randrange(60), 999]) for n in range(60)}
    parent |= {100: 101, 101: 102, 102: 100, 103: 100, 104: 103, 105: 105, 106: 105}
    check(spark, parent)


def test_deep_chain(spark):
    check(spark, {n: n - 1 if n else None for n in range(70)})


def test_only_cycles_and_empty(spark):
    check(spark, {1: 2, 2: 1, 3: 3})
    check(spark, {})


def test_repeats_and_several_parents(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (2, 1), (2, 5), (3, None)], "id long, p long")
    assert {(r["id"], r["parent"]) for r in hierarchy.links(df, "t", "id", "p").collect()} == {(1, None), (2, 1), (3, None)}


def test_a_parent_with_most_of_the_children(spark, monkeypatch):
    from quarrymark.operators import orphans

    monkeypatch.setattr(orphans, "HOT_SHARE", 3)
    parent = {0: None} | {n: 0 for n in range(1, 25_000)} | {30_000: 7, 30_001: 30_000, 30_002: 30_003, 30_003: 30_002}
    df = spark.createDataFrame(list(parent.items()), "id long, p long")
    got = hierarchy.resolve(hierarchy.links(df, "t", "id", "p"))
    assert {(r["root"], r["depth"]): r["count"] for r in got.groupBy("root", "depth").count().collect()} == {(0, 0): 1, (0, 1): 24_999, (0, 2): 1, (0, 3): 1, (30_002, None): 2}
