import pytest
from pyspark.sql import functions as F

from quarrymark.functions import names, types
from quarrymark.operators import candidates, inclusion, profile, soft_keys
from quarrymark.operators.inclusion import Side


def side(spark, name, values, kind="long"):
    return Side(name, spark.createDataFrame([(v,) for v in values], f"c {kind}"), "c")


@pytest.mark.parametrize(
    ("child", "parent", "want"),
    [
        ([1, 1, 2, None], [1, 2, 3], (2, 3, 0, 1.0, "MANY_TO_ONE")), ([1, 2], [2, 1, 1], (2, 2, 0, 1.0, "ONE_TO_ONE")), (list(range(100)), range(1, 200), (100, 199, 1, 0.99, "PARTIAL")),
        ([1, 2], [3], (2, 1, 2, 0.0, "NO_RELATIONSHIP")), ([], [], (0, 0, 0, 0.0, "ONE_TO_ONE")), ([None], [1], (0, 1, 0, 0.0, "NO_RELATIONSHIP")),
    ],
)
def test_containment(spark, child, parent, want):
    assert tuple(inclusion.containment(side(spark, "a", child), side(spark, "b", parent)).first())[2:] == want


def test_mismatch_group_and_top(spark):
    a, b, s = side(spark, "a", [1, 2, 3]), side(spark, "b", [1, 2]), side(spark, "s", ["1"], "string")
    assert inclusion.containment(s, a).first()["cardinality"] == "TYPE_MISMATCH"
    g = inclusion.grouped(a, [b, s]).orderBy("pos").collect()
    assert [(r["child"], r["containment"], r["cardinality"]) for r in g] == [("b", 1.0, "MANY_TO_ONE"), ("s", 0.0, "TYPE_MISMATCH")]
    top = inclusion.top_k(b, [s, side(spark, "half", [1]), a], k=2).orderBy("rank").collect()
    assert [(r["parent"], r["containment"]) for r in top] == [("a", 1.0), ("half", 0.5)]
    pairs = {(r["child"], r["parent"]): r["orphans"] for r in inclusion.all_pairs([a, b, s]).collect()}
    assert pairs == {("a", "b"): 1, ("b", "a"): 0}


def test_tuples_partitions_json(spark):
    t = spark.createDataFrame([(1, 1), (1, 2), (None, 5), (2, 2)], "x long, y long")
    p = spark.createDataFrame([(1, 1), (1, 2)], "x long, y long")
    r = inclusion.tuple_containment(t, ["x", "y"], p, ["x", "y"]).first()
    assert (r["child_distinct"], r["parent_distinct"], r["orphans"]) == (3, 2, 1)
    c = spark.createDataFrame([("Post", 1), ("Post", 2), ("Article", 9), (None, 1)], "k string, i long")
    found = soft_keys.polymorphic_keys(c, "k", "i", [Side("s.posts.id", p, "y"), Side("s.articles.id", spark.createDataFrame([(9,)], "y long"), "y")])
    assert {(r["kind"], r["parent"], r["confidence"]) for r in found.collect()} == {("Post", "s.posts.id", 0.9002), ("Article", "s.articles.id", 0.9001)}
    j = spark.createDataFrame([('{"a": {"id": 7}, "l": [1, {"x": "u"}]}',), ("no json",), (None,)], "j string")
    assert {(r["path"], r["kind"], r["n"]) for r in inclusion.json_leaves(j, "j").collect()} == {("$.a.id", "int", 1), ("$.l[*]", "int", 1), ("$.l[*].x", "string", 1)}


def test_quality_rules(spark):
    rows = [
        ("t", "all_null", 10, 10, 0, 0, 0, 0, False), ("t", "heavy", 10, 5, 3, 3, 0, 0, False), ("t", "pk", 10, 0, 9, None, None, None, True), ("t", "text", 2000, 0, 4, 3, 2, 1, False), ("t", "empty_table", 0, 0, 0, 0, 0, 0, False),
    ]
    df = spark.createDataFrame(rows, "table_name string, column_name string, row_count long, null_count long, distinct_count long, distinct_lower long, empty_count long, padded_count long, is_pk boolean")
    got = {(r["column_name"], r["finding"], r["count"], r["fraction"]) for r in profile.quality_findings(df).collect()}
    assert got == {
        ("all_null", "ALL_NULL", 10, 1.0), ("heavy", "NULL_HEAVY", 5, 0.5), ("pk", "DUPLICATE_PK", 1, 0.1), ("text", "LEADING_TRAILING_WHITESPACE", 1, 0.0005), ("text", "EMPTY_STRING", 2, 0.001),
        ("text", "MIXED_CASE", 1, 0.25), ("text", "LOW_CARDINALITY", 4, 0.002),
    }


def test_fingerprints_of_odd_tables(spark):
    df = spark.createDataFrame([("a ", 1, None), ("A ", 1, None), ("", None, None)], "`x.y` string, n int, z string")
    got = {r["column_name"]: (r["null_count"], r["distinct_count"], r["distinct_lower"], r["empty_count"], r["padded_count"], r["min_val"]) for r in profile.fingerprints(df, "t").collect()}
    assert got == {"x.y": (0, 3, 2, 1, 2, ""), "n": (1, 1, None, None, None, "1"), "z": (3, 0, None, 0, 0, None)}
    assert {r["row_count"] for r in profile.fingerprints(df.limit(0), "t").collect()} == {0}
    assert {r["column_name"]: r["distinct_count"] for r in profile.adaptive_fingerprints(df, "t").collect()} == {"x.y": 3, "n": 1, "z": 0}


def test_names():
    assert names.similarity("customer_id", "customers") == 1.0 and names.stem("id") == "id" and names.stem("IDs") == "id"
    assert [names.singular(x) for x in ("posts", "categories", "addresses", "status")] == ["post", "category", "addresses"[:-1], "statu"]
    assert names.table_forms("Category") == ["category", "categories"] and names.table_forms("") == []
    assert names.indel_ratio("abc", "abc") == 100 and names.indel_ratio("", "") == 100 and round(names.indel_ratio("o_custkey", "c_custkey"), 2) == 88.89


def test_types(spark):
    rows = [("integer", None, "INT_NARROW"), ("varchar", 64, "STRING_SHORT"), ("varchar", 65, "STRING_LONG"), ("text", None, "STRING_LONG"), ("Timestamp with time zone", None, "TIMESTAMP"), ("inet", None, "STRING_LONG"), ("money", None, "FLOAT")]
    df = spark.createDataFrame(rows, "k string, n int, want string")
    assert df.where(types.type_class(F.col("k"), F.col("n")) != F.col("want")).count() == 0
    assert [types.excluded(x) for x in ("audit_log", "events", "user_events", "x_bak2", "tmp_a", "logs")] == ["log_pattern", None, "events_pattern", "backup_pattern", "tmp_pattern", None]


FACTS = "column_id long, table_name string, column_name string, ordinal int, type_class string, row_count long, distinct_count long, null_pct double, min_val string, max_val string, is_pk boolean, is_unique boolean, eligible boolean"


def facts(spark, rows):
    full = [(i, t, c, i, k, n, d, 0.0, lo, hi, pk, False, True) for i, (t, c, k, n, d, lo, hi, pk) in enumerate(rows)]
    return candidates.reconciled_keys(candidates.implicit_keys(spark.createDataFrame(full, FACTS)))


def test_candidates(spark):
    rows = [
        ("customers", "id", "INT_WIDE", 500, 500, "1000", "1499", True), ("orders", "id", "INT_WIDE", 900, 900, "5000", "5899", True), ("orders", "customer_id", "INT_WIDE", 900, 400, "1000", "1499", False),
        ("orders", "amount", "FLOAT", 900, 800, "0", "9", False), ("employees", "id", "INT_NARROW", 30, 30, "1", "30", True), ("employees", "manager_id", "INT_NARROW", 30, 4, "1", "9", False),
    ]
    found = {(r["child_table_name"], r["child_column_name"], r["parent_table_name"]): r for r in candidates.prefiltered(facts(spark, rows)).collect()}
    assert found["orders", "customer_id", "customers"]["tier"] == candidates.PRIMARY and found["employees", "manager_id", "employees"]["locked"]
    assert ("orders", "amount", "customers") not in found and ("customers", "id", "orders") not in found  # out of range
    overlap = spark.createDataFrame([(2, 0, 400), (5, 4, 4)], "child_id long, parent_id long, shared long")
    rel = candidates.validated(candidates.discovered(facts(spark, rows), overlap), overlap).collect()
    assert {(r["child_column_name"], r["cardinality"], r["containment_full"]) for r in rel} == {("customer_id", "MANY_TO_ONE", 1.0), ("manager_id", "MANY_TO_ONE", 1.0)}


def test_implicit_key_by_name(spark):
    rows = [("films", "code", "INT_WIDE", 50, 50, "1", "50", False), ("films", "film_id", "INT_WIDE", 50, 50, "1", "50", False), ("films", "note", "STRING_LONG", 50, 50, "a", "z", False)]
    got = {r["column_name"]: (r["is_implicit_pk"], r["is_unique"]) for r in facts(spark, rows).collect()}
    assert got == {"code": (False, True), "film_id": (True, False), "note": (False, False)}


def test_confidence_bounds(spark):
    one = spark.range(1).select(candidates.confidence(F.lit(1.0), F.lit(1.0), F.lit(True), F.lit(False), F.lit(10), F.lit(10), F.lit(1.0)).alias("a"), candidates.confidence(F.lit(0.5), F.lit(0.5), F.lit(False), F.lit(True), F.lit(30), F.lit(20), F.lit(0.0)).alias("b")).first()
    assert one["a"] == 1.0 and one["b"] == round(0.2 + 0.15 + 0.075 + 0.1 * (1 - 0.45 / 0.95), 4)


def test_role_rules(spark):
    def holds(rule, *texts):
        return spark.range(1).select(rule(*[F.lit(t) for t in texts])).first()[0]

    assert holds(names.role_reference, "posted_by", "employees", "id") and not holds(names.role_reference, "posted", "employees", "id")
    assert holds(names.role_reference, "manager_id", "Employees", "employee_id") and not holds(names.role_reference, "manager_id", "Employees", "code")
    assert holds(names.suffix_match, "storage_policy_id", "ads_st_config_policy", "id") and not holds(names.suffix_match, "id", "ids", "id") and holds(names.suffix_match, "ab_id", "abc", "id")
    assert holds(names.disjoint, "orders", "films") and not holds(names.disjoint, "ads_app", "ads_apple") and not holds(names.disjoint, "a_", "a_b") and holds(names.disjoint, "hr_jobs", "hr_people") and not holds(names.disjoint, "hr_job", "hr_jobs")
    for name in ("id", "IDs", "customer_id", "_id", "s", "class", "x.id", "orders", "status_id"):
        assert holds(names.stem_of, name) == names.stem(name), name


def test_the_best_named_key_of_a_group_stays(spark):
    rows = [("orders", "id", True), ("customers", "id", True), ("customers", "name", False), ("orders", "customer_id", False), ("visits", "customer_id", False), ("visits", "visit_no", True), ("notes", "code", True)]
    full = [(i, t, c, 1, "STRING_SHORT" if t == "notes" else "INT_WIDE", 10, 10, 0.0, None, None, False, False, True, k) for i, (t, c, k) in enumerate(rows)]
    got = candidates.reconciled_keys(spark.createDataFrame(full, FACTS + ", is_implicit_pk boolean"))
    assert {(r["table_name"], r["column_name"]): (r["is_implicit_pk"], r["is_unique"]) for r in got.collect() if r["is_implicit_pk"] or r["is_unique"]} == {
        ("customers", "id"): (True, False), ("orders", "id"): (False, True), ("visits", "visit_no"): (False, True), ("notes", "code"): (True, False)
    }
