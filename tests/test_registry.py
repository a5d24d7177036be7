import __spark_entry__ as entry
from quarrymark.plans import registry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())


def test_stream_counts_match_a_store(spark, tmp_path):
    from quarrymark.operators.quality import ValueCounts
    from quarrymark.streaming.profile import keep_counts

    rows = [(1, "a", 1), (1, "a", 1), (1, "b", -1), (2, None, 4)]
    spark.createDataFrame(rows, ValueCounts.SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    store = ValueCounts(spark)
    stream = spark.readStream.schema(ValueCounts.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keep_counts(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in store.state().collect()} == {(1, "a", 2), (1, "b", -1), (2, None, 4)}
