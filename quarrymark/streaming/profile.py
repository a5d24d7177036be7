"""Profiles of streams: counts by window with late data, and value counts kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrymark.operators.quality import ValueCounts


def windowed_profile(stream: DataFrame, time: str, group: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, group, n, nulls, low, high by tumbling window; events later than the watermark allows are dropped."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(group).alias("group"))
    return timed.agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("nulls"), F.min(value).alias("low"), F.max(value).alias("high")).select(F.col("w.start").alias("window_start"), "group", "n", "nulls", "low", "high")


def keep_counts(stream: DataFrame, store: ValueCounts, checkpoint: str) -> StreamingQuery:
    """Adds a stream of signed cells (column_id, cell_value, n) to a store, a batch at a time, until the input is used up.

    Each batch becomes a new version of the store, which keeps the batch's number; a batch that
    fails leaves the version before it, and one that is replayed after it was kept is skipped.
    """

    def apply(batch: DataFrame, number: int) -> None:
        store.apply(batch.select("column_id", "cell_value", "n"), batch=(checkpoint, number))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
