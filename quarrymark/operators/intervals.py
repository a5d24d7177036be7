"""Continuous periods of overlapping day intervals, and the gaps between them.

Method: the intervals are range-sorted by (entity, start) over the whole cluster, so a hot
entity spreads over many partitions. Each partition hands one summary row (last entity, its
maximum end, start of its last island) to the driver; these are as many as partitions, whatever
the data. They are combined from left to right, and a second scan of the same partitions starts
from the carried state, giving each interval the maximum end before it and its island's label.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrymark.sources.shared import pinned

#: Day number of an end that never comes; beyond 9999-12-31.
OPEN_DAY = 2**22
FOREVER = dt.date(9999, 12, 31)
_NEVER = -(2**22)


def latest_version(df: DataFrame, key: str, version: str) -> DataFrame:
    """Of each key, the row with the greatest version (null counts as least).

    Rows of equal version: the greatest in the order of the remaining columns, so the result
    doesn't depend on row order. Rows whose key is null can't be corrected; each stays.
    """
    rest = [c for c in df.columns if c not in (key, version)]
    kept = (
        df.where(F.col(f"`{key}`").isNotNull())
        .groupBy(key)
        .agg(F.max(F.struct(F.col(f"`{version}`"), *[F.col(f"`{c}`") for c in rest])).alias("_row"))
        .select(key, *[F.col(f"_row.`{c}`") for c in df.columns if c != key])
    )
    return kept.select(df.columns).unionByName(df.where(F.col(f"`{key}`").isNull()))


def _sorted_days(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, s, e) as day numbers, one row of each (entity, s), range-sorted and pinned."""
    e = F.when(F.col(end).isNull() | (F.col(end) >= F.lit(FOREVER)), F.lit(OPEN_DAY)).otherwise(F.unix_date(F.col(end)))
    days = (
        df.where(F.col(entity).isNotNull() & F.col(start).isNotNull())
        .select(F.col(entity).cast("long").alias("entity"), F.unix_date(F.col(start)).cast("long").alias("s"), e.cast("long").alias("e"))
        .where("e >= s")
        .groupBy("entity", "s")
        .agg(F.max("e").alias("e"))
    )
    return pinned(days.repartitionByRange("entity", "s").sortWithinPartitions("entity", "s").select("entity", "s", "e", F.spark_partition_id().cast("long").alias("pid")))


def _scan(entity: np.ndarray, s: np.ndarray, e: np.ndarray, carry: tuple[int, int, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int, int]]:
    """One sorted batch: maximum end before each row, island start of each row, is-first flags, state after it.

    carry is (entity, maximum end, island start) of the rows before. Ends are small, so that a
    segment number in the high bits makes one running maximum serve all entities.
    """
    new = np.empty(len(entity), bool)
    new[0] = carry is None or entity[0] != carry[0]
    new[1:] = entity[1:] != entity[:-1]
    seg = np.cumsum(new).astype(np.int64) << 24
    off = 2**23
    run = seg + e + off
    if not new[0]:
        run[0] = max(run[0], seg[0] + carry[1] + off)
    run = np.maximum.accumulate(run)
    upto = run - seg - off
    before = np.empty_like(upto)
    before[1:] = upto[:-1]
    before[new] = _NEVER
    if not new[0]:
        before[0] = carry[1]
    opens = new | (s > before + 1)
    at = np.maximum.accumulate(np.where(opens, np.arange(len(s)), -1))
    island = np.where(at >= 0, s[np.maximum(at, 0)], carry[2] if carry else 0)
    return before, island, new, (int(entity[-1]), int(upto[-1]), int(island[-1]))


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]


def _pid(batch: pa.RecordBatch) -> int:
    """The partition a batch was pinned in; the task's own number may differ, as in a union."""
    return batch.column(3)[0].as_py()


def _summaries(df: DataFrame) -> list:
    """One row per non-empty partition: pid, first entity, last entity, its maximum end and last island's start."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, state, pid = None, None, None
        for b in batches:
            if b.num_rows:
                cols = _columns(b)
                if first is None:
                    first, pid = int(cols[0][0]), _pid(b)
                state = _scan(*cols, state)[3]
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"pid": pid, "first": first, "entity": state[0], "most": state[1], "island": state[2]}])

    return sorted(df.mapInArrow(summary, "pid long, first long, entity long, most long, island long").collect())


def _prefix(summaries: list) -> dict[int, tuple[int, int, int]]:
    """The state carried into each partition."""
    carried, state = {}, None
    for x in summaries:
        if state is not None:
            carried[x.pid] = state
        most, island = x.most, x.island
        if state is not None and x.first == x.entity == state[0]:  # the whole partition continues the entity
            if state[1] + 1 >= island:
                island = state[2]
            most = max(most, state[1])
        state = (x.entity, most, island)
    return carried


def islands(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Each distinct (entity, start) with the maximum end before it and the start of its island.

    Columns: entity, s, e, before (null for an entity's first), island; days since 1970-01-01,
    OPEN_DAY for an end that never comes. Both days belong to an interval; adjacent days join.
    Rows without entity or start, or that end before they start, are ignored; an empty input
    gives no rows; other columns are not read, so that their names can't clash.
    """
    rows = _sorted_days(df, entity, start, end)
    carried = _prefix(_summaries(rows))

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, begun = None, False
        for b in batches:
            if b.num_rows:
                state, begun = (state if begun else carried.get(_pid(b))), True
                ent, s, e = _columns(b)
                before, island, _, state = _scan(ent, s, e, state)
                yield pa.RecordBatch.from_arrays([pa.array(ent), pa.array(s), pa.array(e), pa.array(before, mask=before == _NEVER), pa.array(island)], names=["entity", "s", "e", "before", "island"])

    return rows.mapInArrow(rescan, "entity long, s long, e long, before long, island long")


def gaps(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """entity, gap_start, gap_end (dates, both inside the gap): each longest uncovered run between two intervals of an entity."""
    found = islands(df, entity, start, end).where("s > before + 1")
    return found.select("entity", F.date_from_unix_date((F.col("before") + 1).cast("int")).alias("gap_start"), F.date_from_unix_date((F.col("s") - 1).cast("int")).alias("gap_end"))


def periods(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """entity, period_start, period_end (null: never ends), intervals: each continuous period."""
    joined = islands(df, entity, start, end).groupBy("entity", "island").agg(F.max("e").alias("e"), F.count("*").alias("starts"))
    last = F.when(F.col("e") < OPEN_DAY, F.date_from_unix_date(F.col("e").cast("int")))
    return joined.select("entity", F.date_from_unix_date(F.col("island").cast("int")).alias("period_start"), last.alias("period_end"), "starts")
