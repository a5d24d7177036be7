import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrymark.operators import quality

CELLS = "column_id long, load_no long, row_no long, cell_value string, extracted_at timestamp"
COLUMNS = "column_id long, data_type string, is_nullable boolean, max_length int, min_val string, max_val string"
AT = dt.datetime(2024, 1, 1)

GOOD = {
    "integer": ["1", "+1", "-2147483648", " 2147483647 ", "0000000000000000000000000001"], "bigint": ["9223372036854775807", "-9223372036854775808"], "numeric": ["1", "-1.50", "+0.1", "9" * 50],
    "boolean": ["true", "F", " t ", "FALSE"], "date": ["2024-02-29", " 1999-12-31"], "timestamp with time zone": ["2024-02-29 00:00:00", "2024-02-29T23:59:59.123Z", "2024-02-29 01:02:03+05", "2024-02-29 01:02:03-05:30"],
    "uuid": ["00000000-0000-0000-0000-00000000000A"], "jsonb": ["{}", " [1, null]", '"x"', "1e5"], "character varying": ["", "abcde", " abcde "], "text": ["", "anything"],
}
BAD = {
    "integer": ["2147483648", "1.0", "", "x", "- 1", "9" * 30], "bigint": ["9223372036854775808"], "numeric": ["1.", ".5", "1e3", "", "NaN"], "boolean": ["yes", "1", ""],
    "date": ["2023-02-29", "2024-1-1", "2024-01-01 00:00:00", ""], "timestamp with time zone": ["2024-02-30 00:00:00", "2024-02-29 24:00:00", "2024-02-29", "2024-02-29 01:02:03 Z"],
    "uuid": ["0000", "g0000000-0000-0000-0000-00000000000A"], "jsonb": ["{'a': 1}", "NaN", "{} x", "", "[1,]"], "character varying": ["abcdef"], "text": [],
}


@pytest.fixture(scope="module")
def verdicts(spark):
    kinds = sorted(GOOD)
    cells = [(i, 1, n, v, AT) for i, k in enumerate(kinds) for n, v in enumerate(GOOD[k] + BAD[k])]
    columns = [(i, k, True, 5, None, None) for i, k in enumerate(kinds)]
    j = quality.profiled_loads(spark.createDataFrame(cells, CELLS), spark.createDataFrame(columns, COLUMNS))
    return {(kinds[r["column_id"]], r["cell_value"]): r["valid"] for r in j.collect()}


def test_types(verdicts):
    for kind in GOOD:
        assert [v for v in GOOD[kind] if not verdicts[kind, v]] == [], kind
        assert [v for v in BAD[kind] if verdicts[kind, v]] == [], kind


def test_measure_orders_time_zones(spark):
    df = spark.createDataFrame([("2024-01-01 12:00:00+02",), ("2024-01-01 10:00:00",), ("2024-01-01T10:00:00.000Z",)], "c string")
    assert df.select(quality.measure(F.col("c"), F.lit("timestamp with time zone")).alias("m")).distinct().count() == 1


def test_findings_and_missing_loads(spark):
    cells = [(1, l, i, v, AT) for l, vs in ((1, ["5", "6", "7"]), (3, ["50", "60", None]), (4, ["50", "60", "x"])) for i, v in enumerate(vs)] * 2
    cells += [(2, 1, 0, "a", AT), (2, 1, 1, "b", AT), (2, 2, 0, "a", AT), (2, 2, 1, "a", AT), (3, 1, 0, None, None), (None, 1, 1, "z", AT)]
    columns = [(1, "integer", False, None, "5", "55"), (2, "character varying", True, 9, None, None), (3, "text", True, None, None, None), (4, "text", True, None, None, None)]
    j = quality.profiled_loads(spark.createDataFrame(cells, CELLS), spark.createDataFrame(columns, COLUMNS))
    assert {tuple(r) for r in quality.findings(j).collect()} == {(1, 3, "null"), (1, 3, "range"), (1, 4, "range"), (1, 4, "type"), (1, 3, "shift"), (1, 4, "shift"), (2, 2, "shift")}
    p = {(r["column_id"], r["load_no"]): r for r in quality.profile(j).collect()}
    assert (p[1, 3]["cells"], p[1, 3]["nulls"], p[1, 3]["distinct_values"], p[2, 1]["entropy"], p[2, 2]["entropy"]) == (3, 1, 2, 1.0, 0.0)


def test_empty(spark):
    j = quality.profiled_loads(spark.createDataFrame([], CELLS), spark.createDataFrame([], COLUMNS))
    assert quality.findings(j).count() == quality.profile(j).count() == 0


def test_weighted_quantiles(spark):
    import numpy as np

    values = [(1, float(i % 17), i % 5 + 1) for i in range(300)] + [(2, 4.0, 1)]
    got = {(r[0], r[1]): r[2] for r in quality.weighted_quantiles(spark.createDataFrame(values, "g long, v double, n long"), ["g"], "v", "n", [0.1, 0.5, 0.9]).collect()}
    flat = np.concatenate([np.repeat(v, n) for g, v, n in values if g == 1])
    for p in (0.1, 0.5, 0.9):
        assert abs(got[1, p] - np.quantile(flat, p)) < 1e-9 and got[2, p] == 4.0


def test_store_applies_signed_deltas(spark):
    store = quality.ValueCounts(spark)
    store.apply(spark.createDataFrame([(1, "a", 2), (1, None, 1)], store.SCHEMA))
    state = store.apply(spark.createDataFrame([(1, "a", -2), (1, None, 3), (2, "b", 1)], store.SCHEMA))
    assert {tuple(r) for r in state.collect()} == {(1, None, 4), (2, "b", 1)}


def test_store_opens_again_and_skips_what_it_has(spark):
    store = quality.ValueCounts(spark)
    assert store.add_load(spark.createDataFrame([(1, "a", 2), (1, None, 1), (2, "z", 5)], store.SCHEMA), 1)
    again = quality.ValueCounts(spark, store.path)
    assert {tuple(r) for r in again.state().collect()} == {(1, "a", 2), (1, None, 1), (2, "z", 5)}
    assert not again.add_load(spark.createDataFrame([(1, "b", 9)], store.SCHEMA), 1)
    assert again.add_load(spark.createDataFrame([(1, "a", 3)], store.SCHEMA), 4)
    assert {tuple(r) for r in store.state().collect()} == {(1, "a", 3), (2, "z", 5)}
    rows = {tuple(r) for r in again.changes([4]).select("column_id", "load_no", "prev_load", "cell_value", "n", "n_before").collect()}
    assert rows == {(1, 4, 1, "a", 3, 2), (1, 4, 1, None, 0, 1)}
    # a version that failed before its manifest was written is written over
    spark.createDataFrame([(7, "junk", 1, 0, 9, "0")], store.ROWS + ", bucket string").write.partitionBy("bucket").parquet(f"{store.path}/v=3")
    again.apply(spark.createDataFrame([(2, "z", -5), (3, "n", 1)], store.SCHEMA))
    assert {tuple(r) for r in store.state().collect()} == {(1, "a", 3), (3, "n", 1)}
    gone = store.vacuum()
    assert "v=1" in gone and {tuple(r) for r in quality.ValueCounts(spark, store.path).state().collect()} == {(1, "a", 3), (3, "n", 1)} and store.vacuum() == []


def test_a_replayed_batch_is_skipped(spark):
    store = quality.ValueCounts(spark)
    one = spark.createDataFrame([(1, "a", 2)], store.SCHEMA)
    for number in (0, 0, 1, 1, 0):
        store.apply(one, batch=("s", number))
    store.apply(one, batch=("other", 0))
    assert [tuple(r) for r in store.state().collect()] == [(1, "a", 6)]


@pytest.mark.parametrize("buckets", [1, 16])
def test_loads_of_two_runs_give_the_findings_of_one(spark, monkeypatch, buckets):
    monkeypatch.setattr(quality, "BUCKETS", buckets)
    cells = [(c, l, i, v, AT) for c, l, vs in ((1, 1, "1 2 3 4"), (2, 1, "a a b"), (1, 2, "9 9 9 8"), (2, 3, "b b b"), (1, 4, "8 9 9 x")) for i, v in enumerate(vs.split())]
    columns = spark.createDataFrame([(1, "integer", False, None, "1", "9"), (2, "character varying", False, 5, None, None)], COLUMNS)
    df = spark.createDataFrame(cells, CELLS)
    whole = {tuple(r) for r in quality.findings(quality.profiled_loads(df, columns)).collect()}
    sizes = {(r["column_id"], r["load_no"]): r["cells"] for r in quality.profile(quality.profiled_loads(df, columns)).collect()}
    assert sizes == {(1, 1): 4, (2, 1): 3, (1, 2): 4, (2, 3): 3, (1, 4): 4}
    store = quality.ValueCounts(spark)
    first = quality.findings(quality.profiled_loads(df.where("load_no < 3"), columns, store)).collect()
    second = quality.findings(quality.profiled_loads(df, columns, quality.ValueCounts(spark, store.path))).collect()
    assert {tuple(r) for r in first + second} == whole and {r["load_no"] for r in second} <= {3, 4} and (2, 3, "shift") in whole


def test_ranges_to_the_last_digit(spark):
    cells = [(1, 1, i, v, AT) for i, v in enumerate(["10.0000004", "10", "-0.00000001", "-0", "9" * 40, "0005", "+9.9999999"])]
    columns = [(1, "numeric", True, None, "0", "10.0")]
    j = quality.profiled_loads(spark.createDataFrame(cells, CELLS), spark.createDataFrame(columns, COLUMNS))
    assert {r["cell_value"] for r in j.where("outside").collect()} == {"10.0000004", "-0.00000001", "9" * 40}
