"""Column-level data quality profile of loads of raw text cells.

Method: a persistent table of value counts per column. Each load is turned into signed deltas
against the counts kept so far (a value that is gone has a negative one) and the deltas are added
to them, so that what is kept are the counts of each column's newest load. Every metric (nulls,
distinct values, ranges, type violations, medians, shares, entropy) comes from the kept counts and
their deltas and not from the cells.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from quarrymark.sources import shared
from quarrymark.sources.shared import new_folder, staged

#: Parts of a store by column; only those whose columns change are written anew.
BUCKETS = 16
INTEGER_BITS = {"integer": 32, "bigint": 64}
#: Data types whose valid values have an order used for ranges and medians.
MEASURED = ("integer", "bigint", "numeric", "date", "timestamp with time zone")
CATEGORICAL = ("boolean", "character varying")
DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
CLOCK = r"([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
STAMP = rf"^({DAY})[ T]({CLOCK})(\.[0-9]+)?(Z|[+-][0-9]{{2}}(:[0-9]{{2}})?)?$"


class ValueCounts:
    """Counts of (column_id, cell_value) as of each column's newest load, kept as Parquet in a folder of its own.

    A version is a folder with the buckets that it changed, whole; a small manifest, written last,
    says which version holds each bucket, which loads and stream batches are in it, and of which
    load each column is. So a job which fails midway leaves the last version usable, a store can
    be opened again at its path, and what was applied once isn't applied again.

    Rows: column_id, cell_value, n, n_before (the count that the version's change began from),
    load_no (of the column). A row with n 0 tells of a value that is gone.
    """

    SCHEMA = "column_id long, cell_value string, n long"
    ROWS = "column_id long, cell_value string, n long, n_before long, load_no long"
    EMPTY = {"version": 0, "buckets": {}, "columns": {}, "loads": {}, "batches": {}}

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_folder(spark, "value-counts")

    def manifest(self) -> dict:
        found = [int(n) for n in shared.listed(self.spark, f"{self.path}/manifest") if n.isdigit()]
        return json.loads(shared.read_text(self.spark, f"{self.path}/manifest/{max(found)}")) if found else json.loads(json.dumps(self.EMPTY))

    @property
    def version(self) -> int:
        return self.manifest()["version"]

    def _rows(self, paths: list[str], *more: str) -> DataFrame:
        """ROWS of the paths, and the version (v) or bucket if wanted."""
        if not paths:
            return self.spark.createDataFrame([], self.ROWS + "".join(f", {c} int" for c in more))
        return self.spark.read.schema(self.ROWS + ", v int, bucket int").option("basePath", self.path).parquet(*paths).drop(*{"v", "bucket"} - {*more})

    def _held(self, manifest: dict, buckets: list[str]) -> DataFrame:
        return self._rows([f"{self.path}/v={manifest['buckets'][b]}/bucket={b}" for b in buckets if b in manifest["buckets"]]).where("n <> 0")

    def state(self) -> DataFrame:
        """column_id, cell_value, n as of the newest version."""
        m = self.manifest()
        return self._held(m, [*m["buckets"]]).select("column_id", "cell_value", "n")

    def _write(self, rows: DataFrame, manifest: dict, touched: list[str]) -> None:
        """rows (as ROWS, of the touched buckets) become a version; the manifest goes last."""
        now = manifest["version"] + 1
        path = f"{self.path}/v={now}"
        rows.withColumn("bucket", _bucket()).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)
        there = {f.removeprefix("bucket=") for f in shared.listed(self.spark, path) if f.startswith("bucket=")}
        manifest["buckets"] = {b: v for b, v in manifest["buckets"].items() if b not in touched} | {b: now for b in touched if b in there}
        manifest["version"] = now
        shared.write_text(self.spark, f"{self.path}/manifest/{now}", json.dumps(manifest))

    def apply(self, deltas: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Adds signed deltas (column_id, cell_value, n) and returns the new state; a value at zero is gone.

        batch: name and number of a stream's batch; a number not above the last one of that name was applied before and is skipped.
        """
        m = self.manifest()
        if batch and m["batches"].get(batch[0], -1) >= batch[1]:
            return self.state()
        deltas = staged(deltas.groupBy("column_id", "cell_value").agg(F.sum("n").alias("n")).where("n <> 0"), "deltas")
        touched = [r[0] for r in deltas.select(_bucket()).distinct().collect()]  # at most BUCKETS
        old = self._held(m, touched).select("column_id", "cell_value", F.lit(0).cast("long").alias("n"), F.col("n").alias("n_before"), "load_no")
        new = deltas.select("column_id", "cell_value", "n", F.lit(0).cast("long").alias("n_before"), F.lit(None).cast("long").alias("load_no"))
        both = old.unionByName(new).groupBy("column_id", "cell_value").agg((F.sum("n") + F.sum("n_before")).alias("n"), F.sum("n_before").alias("n_before"), F.max("load_no").alias("load_no"))
        if batch:
            m["batches"][batch[0]] = batch[1]
        self._write(both.where("n <> 0 or n_before <> 0"), m, touched)
        return self.state()

    def add_load(self, counts: DataFrame, load_no: int) -> bool:
        """The counts (column_id, cell_value, n) of one load, as signed deltas against the kept counts of its columns; other columns stay as they are. False if the load is in the store already."""
        m = self.manifest()
        if str(load_no) in m["loads"]:
            return False
        columns = [r[0] for r in counts.select("column_id").distinct().collect()]  # a list of columns
        touched = [r[0] for r in counts.select(_bucket()).distinct().collect()]  # at most BUCKETS
        held = self._held(m, touched)
        mine = F.col("column_id").isin(columns)
        zero = F.lit(0).cast("long")
        old = held.where(mine).select("column_id", "cell_value", zero.alias("n"), F.col("n").alias("n_before"))
        now = counts.select("column_id", "cell_value", "n", zero.alias("n_before")).unionByName(old).groupBy("column_id", "cell_value").agg(F.sum("n").alias("n"), F.sum("n_before").alias("n_before"))
        rest = held.where(~mine).select("column_id", "cell_value", "n", F.col("n").alias("n_before"), "load_no")
        m["loads"][str(load_no)] = {"version": m["version"] + 1, "before": {str(c): m["columns"].get(str(c)) for c in columns}}
        m["columns"] |= {str(c): load_no for c in columns}
        self._write(now.withColumn("load_no", F.lit(load_no).cast("long")).unionByName(rest), m, touched)
        return True

    def changes(self, loads: list[int]) -> DataFrame:
        """column_id, load_no, prev_load, cell_value, n, n_before of each of these loads: what its version wrote. Versions that ``vacuum`` removed have none."""
        m = self.manifest()
        there = {f for f in shared.listed(self.spark, self.path) if f.startswith("v=")}
        kept = [load for load in loads if str(load) in m["loads"] and f"v={m['loads'][str(load)]['version']}" in there]
        order = [(int(c), load, before, m["loads"][str(load)]["version"]) for load in kept for c, before in m["loads"][str(load)]["before"].items()]  # a row per column and load
        order = self.spark.createDataFrame(order, "column_id long, load_no long, prev_load long, v int")
        # rows of other columns in a rewritten bucket carry an earlier load's number in a later version
        return self._rows([f"{self.path}/v={m['loads'][str(load)]['version']}" for load in kept], "v").join(F.broadcast(order), ["column_id", "load_no", "v"]).drop("v")

    def vacuum(self) -> list[str]:
        """Deletes the versions that hold no bucket of the newest state, and the manifests before the newest; returns the deleted versions."""
        m = self.manifest()
        used = {f"v={v}" for v in m["buckets"].values()}
        gone = [f for f in shared.listed(self.spark, self.path) if f.startswith("v=") and f not in used]
        for f in gone:
            shared.removed(self.spark, f"{self.path}/{f}")
        for f in shared.listed(self.spark, f"{self.path}/manifest"):
            if f.isdigit() and int(f) < m["version"]:
                shared.removed(self.spark, f"{self.path}/manifest/{f}")
        return sorted(gone)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("column_id"), F.lit(BUCKETS)).cast("string").alias("bucket")


def load_counts(cells: DataFrame) -> DataFrame:
    """column_id, load_no, cell_value, n: exact repeats of a row count once; rows without column or load are ignored."""
    once = cells.where("column_id is not null and load_no is not null").select("column_id", "load_no", "row_no", "cell_value", "extracted_at").distinct()
    return once.groupBy("column_id", F.col("load_no").cast("long").alias("load_no"), "cell_value").agg(F.count("*").alias("n"))


@F.pandas_udf(T.BooleanType())
def _strict_json(values: pd.Series) -> pd.Series:
    def refuse(_: str) -> None:
        raise ValueError

    def ok(text: str | None) -> bool | None:
        if text is None:
            return None
        try:
            json.loads(text, parse_constant=refuse, parse_int=str)
        except (ValueError, RecursionError):
            return False
        return True

    return values.map(ok)


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _is_day(text: Column) -> Column:
    return text.rlike(rf"^{DAY}$") & text.substr(1, 4).between("0001", "9999") & text.try_cast("date").isNotNull()


def measure(c: Column, data_type: Column) -> Column:
    """The value of a trimmed, valid text as a decimal that orders as data_type does; null for other types.

    Dates as days, timestamps as microseconds since 1970 in UTC (no offset: UTC), numbers as they are.
    """
    wide = "decimal(38,6)"
    number = c.try_cast(wide)
    day = F.unix_date(c.try_cast("date")).cast(wide)
    at = F.regexp_extract(c, STAMP, 1)
    clock, frac, zone = (F.regexp_extract(c, STAMP, i) for i in (2, 4, 5))
    part = lambda i: F.split_part(clock, F.lit(":"), F.lit(i)).try_cast("int")
    micros = F.rpad(F.concat(F.substring(frac, 2, 6), F.lit("")), 6, "0").try_cast("int")
    shift = F.when(zone.rlike("^[+-]"), F.when(zone.startswith("-"), -1).otherwise(1) * (zone.substr(2, 2).try_cast("int") * 60 + F.coalesce(zone.substr(5, 2).try_cast("int"), F.lit(0)))).otherwise(0)
    seconds = F.unix_date(at.try_cast("date")).cast("long") * 86400 + part(1) * 3600 + part(2) * 60 + part(3) - shift * 60
    stamp = (seconds * 1_000_000 + micros).cast(wide)
    return F.when(data_type.isin("integer", "bigint", "numeric"), number).when(data_type == "date", day).when(data_type == "timestamp with time zone", stamp)


def is_valid(c: Column, data_type: Column, max_length: Column, is_json: Column) -> Column:
    """Whether a trimmed text is valid for data_type; unknown types take anything."""
    digits = F.regexp_replace(c, r"^[+-]?0*", "")
    whole = c.rlike(r"^[+-]?[0-9]+$")
    value = F.when(whole & (F.length(digits) <= 19), c.try_cast("decimal(38,0)"))
    rules = [(name, F.coalesce(value.between(F.lit(-(2 ** (b - 1))).cast("decimal(38,0)"), F.lit(2 ** (b - 1) - 1).cast("decimal(38,0)")), F.lit(False))) for name, b in INTEGER_BITS.items()]
    rules += [
        ("numeric", c.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$")),
        ("boolean", F.lower(c).isin("true", "false", "t", "f")),
        ("date", _is_day(c)),
        ("timestamp with time zone", c.rlike(STAMP) & _is_day(F.regexp_extract(c, STAMP, 1))),
        ("uuid", c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
        ("jsonb", is_json),
        ("character varying", max_length.isNull() | (F.length(c) <= max_length)),
    ]
    out = F.lit(True)
    for name, rule in rules:
        out = F.when(data_type == name, rule).otherwise(out)
    return out


def _below(a: Column, b: Column) -> Column:
    """Whether the number written as a is less than that written as b, to the last digit of both, whatever their length."""
    def parts(c: Column) -> tuple[Column, Column]:
        whole = F.regexp_replace(F.regexp_extract(c, r"^[+-]?([0-9]+)", 1), "^0+", "")
        size = F.concat(F.lpad(F.length(whole).cast("string"), 9, "0"), whole, F.lit("."), F.regexp_replace(F.regexp_extract(c, r"\.([0-9]+)$", 1), "0+$", ""))
        return F.when(size == "000000000.", 0).when(c.startswith("-"), -1).otherwise(1), size

    (sa, ma), (sb, mb) = parts(a), parts(b)
    return F.when(sa != sb, sa < sb).when(sa > 0, ma < mb).when(sa < 0, ma > mb).otherwise(False)


def judged(counts: DataFrame, columns: DataFrame) -> DataFrame:
    """counts with each value's column facts, validity, measure and whether it lies outside the recorded range.

    Columns that the inventory doesn't have are ignored. A numeric beyond 32 digits before the
    point is valid but has no measure: it takes part in ranges, which compare numerics digit by
    digit where six decimals don't tell them apart, and not in medians.
    """
    facts = columns.select("column_id", "data_type", "is_nullable", "max_length", "min_val", "max_val")
    facts = facts.withColumns({"lo": measure(_trimmed(F.col("min_val")), F.col("data_type")), "hi": measure(_trimmed(F.col("max_val")), F.col("data_type"))})
    out = counts.join(facts, "column_id").withColumn("t", _trimmed(F.col("cell_value")))
    plain = out.where("data_type is null or data_type <> 'jsonb'").withColumn("json_ok", F.lit(None).cast("boolean"))
    out = plain.unionByName(out.where("data_type = 'jsonb'").withColumn("json_ok", _strict_json(F.col("t"))))
    t, kind = F.col("t"), F.col("data_type")
    out = out.withColumn("valid", F.when(F.col("cell_value").isNotNull(), is_valid(t, kind, F.col("max_length"), F.col("json_ok"))))
    out = out.withColumn("m", F.when(F.col("valid"), measure(t, kind)))
    text = kind.isin("character varying", "text", "uuid") & F.col("valid")
    low_text, high_text = _trimmed(F.col("min_val")), _trimmed(F.col("max_val"))
    near = lambda bound: (kind == "numeric") & F.col("valid") & (F.col("m").isNull() | (F.abs(F.col("m") - F.col(bound)) <= F.lit(1e-6).cast("decimal(38,6)")))
    number = r"^[+-]?[0-9]+(\.[0-9]+)?$"
    low = F.when(near("lo") & low_text.rlike(number), _below(t, low_text)).when(F.col("m").isNotNull(), F.col("m") < F.col("lo")).when(text, t < F.col("min_val"))
    high = F.when(near("hi") & high_text.rlike(number), _below(high_text, t)).when(F.col("m").isNotNull(), F.col("m") > F.col("hi")).when(text, t > F.col("max_val"))
    return out.withColumn("outside", F.coalesce(low, F.lit(False)) | F.coalesce(high, F.lit(False)))


def weighted_quantiles(values: DataFrame, keys: list[str], value: str, weight: str, shares: list[float]) -> DataFrame:
    """keys, q (map-free: one row per share): interpolated quantiles of weighted values, whatever the size of a group.

    The quantile of share p lies at position p*(N-1) of the sorted values, between its two
    neighbours in proportion. Values are range-sorted over the cluster; only the partitions that
    hold a wanted position are looked into. Columns: keys, share, quantile (double).
    """
    summed = values.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    parts = staged(summed.repartitionByRange(*keys, value).select(*keys, F.col(value).alias("v"), "w", F.spark_partition_id().alias("pid")), "sorted")
    blocks = parts.groupBy(*keys, "pid").agg(F.sum("w").alias("held"))  # at most groups + partitions rows
    over = Window.partitionBy(*keys).orderBy("pid")
    blocks = blocks.withColumn("upto", F.sum("held").over(over)).withColumn("total", F.sum("held").over(Window.partitionBy(*keys)))
    aims = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("share"), (F.lit(float(p)) * (F.col("total") - 1)).alias("pos")) for p in shares])).alias("aim")
    aims = blocks.select(*keys, "pid", "held", "upto", aims).select(*keys, "pid", (F.col("upto") - F.col("held")).alias("start"), "upto", "aim.share", "aim.pos")
    aims = aims.withColumns({"i": F.floor("pos"), "j": F.ceil("pos")}).where("(i >= start and i < upto) or (j >= start and j < upto)")
    inside = parts.join(aims.select(*keys, "pid", "start").distinct(), [*keys, "pid"])
    running = Window.partitionBy(*keys, "pid").orderBy("v")
    inside = inside.select(*keys, "pid", "v", "w", (F.col("start") + F.sum("w").over(running)).alias("last"))
    hit = inside.join(aims.select(*keys, "pid", "share", "pos", "i", "j"), [*keys, "pid"])
    has = lambda at: (F.col(at) < F.col("last")) & (F.col(at) >= F.col("last") - F.col("w"))
    ends = hit.groupBy(*keys, "share", "pos").agg(F.max(F.when(has("i"), F.col("v"))).alias("a"), F.max(F.when(has("j"), F.col("v"))).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    return ends.select(*keys, "share", (a + (b - a) * (F.col("pos") - F.floor("pos"))).alias("quantile"))


def profiled_loads(cells: DataFrame, columns: DataFrame, store: ValueCounts | None = None) -> DataFrame:
    """The judged value counts of every load that the store doesn't hold yet, each as its signed deltas left the kept counts.

    Loads are applied in the order of load_no, so that each meets the latest earlier load of each
    of its columns. A load is applied once: cells of one that the store has are not looked at.
    Columns: load_no, prev_load, n, n_before and those of ``judged``.
    """
    spark = cells.sparkSession
    store = store or ValueCounts(spark)
    known = [int(x) for x in store.manifest()["loads"]]
    counts = staged(load_counts(cells.where(~F.col("load_no").isin(known)) if known else cells), "loads", by="load_no")
    loads = [r[0] for r in counts.select("load_no").distinct().orderBy("load_no").collect()]
    for load in loads:  # one step per load, not per row
        store.add_load(counts.where(F.col("load_no") == load).drop("load_no"), load)
    return staged(judged(store.changes(loads), columns), "judged")


def profile(judged_loads: DataFrame) -> DataFrame:
    """One row per column and load: cells, nulls, null_share, distinct_values, entropy (bits), invalid, out_of_range, min and max value.

    min_value and max_value are valid texts that are least and greatest as data_type; for types
    without measure in text order.
    """
    judged_loads = judged_loads.where("n > 0")
    n = F.col("n")
    totals = judged_loads.groupBy("column_id", "load_no").agg(
        F.sum("n").alias("cells"),
        F.sum(F.when(F.col("cell_value").isNull(), n).otherwise(0)).alias("nulls"),
        F.count("cell_value").alias("distinct_values"),
        F.sum(F.when(F.col("cell_value").isNotNull(), n * F.log2(n.cast("double"))).otherwise(0.0)).alias("_nlogn"),
        F.sum(F.when(~F.col("valid"), n).otherwise(0)).alias("invalid"),
        F.sum(F.when(F.col("outside"), n).otherwise(0)).alias("out_of_range"),
        F.min(F.when(F.col("valid"), F.struct("m", "t"))).alias("_lo"),
        F.max(F.when(F.col("valid"), F.struct("m", "t"))).alias("_hi"),
    )
    filled = F.col("cells") - F.col("nulls")
    entropy = F.when(filled > 0, F.greatest(F.lit(0.0), F.log2(filled.cast("double")) - F.col("_nlogn") / filled)).otherwise(0.0)
    return totals.select(
        "column_id", "load_no", "cells", "nulls", F.round(F.col("nulls") / F.col("cells"), 6).alias("null_share"), "distinct_values", F.round(entropy, 6).alias("entropy"), "invalid", "out_of_range",
        F.col("_lo.t").alias("min_value"), F.col("_hi.t").alias("max_value"),
    )


def findings(judged_loads: DataFrame) -> DataFrame:
    """column_id, load_no, finding (``null``, ``type``, ``range``, ``shift``), each once."""
    j = judged_loads
    key = ["column_id", "load_no"]
    is_null = F.col("cell_value").isNull()
    direct = j.where("n > 0").select(*key, F.explode(F.array_compact(F.array(F.when(is_null & ~F.col("is_nullable"), "null"), F.when(~F.col("valid"), "type"), F.when(F.col("outside"), "range")))).alias("finding"))
    changed = j.where("prev_load is not null")
    total = lambda c, when=None: F.sum(F.col(c) if when is None else F.when(when, F.col(c)).otherwise(0))
    pair = changed.groupBy(*key).agg(total("n").alias("cells"), total("n", is_null).alias("nulls"), total("n_before").alias("cells_b"), total("n_before", is_null).alias("nulls_b"))
    pair = F.broadcast(staged(pair, "totals"))  # a row per column and load: an inventory
    apart = F.abs(F.col("nulls") * F.col("cells_b") - F.col("nulls_b") * F.col("cells")).cast("decimal(38,0)")
    nulls = pair.where(apart * 5 >= (F.col("cells") * F.col("cells_b")).cast("decimal(38,0)")).select(*key)

    measured = changed.where("m is not null")
    sides = measured.where("n > 0").select(*key, "m", F.col("n").alias("w"), F.lit("now").alias("side")).unionByName(measured.where("n_before > 0").select(*key, "m", F.col("n_before").alias("w"), F.lit("before").alias("side")))
    q = weighted_quantiles(sides, [*key, "side"], "m", "w", [0.1, 0.5, 0.9])
    at = lambda side, p: F.max(F.when((F.col("side") == side) & (F.col("share") == p), F.col("quantile")))
    medians = q.groupBy(*key).agg(at("now", 0.5).alias("p50"), at("before", 0.1).alias("p10"), at("before", 0.9).alias("p90")).where("p50 < p10 or p50 > p90").select(*key)

    sized = pair.where("cells > nulls and cells_b > nulls_b").select(*key, (F.col("cells") - F.col("nulls")).alias("f"), (F.col("cells_b") - F.col("nulls_b")).alias("f_b"))
    moved = F.abs(F.col("n") * F.col("f_b") - F.col("n_before") * F.col("f")).cast("decimal(38,0)") * 4 >= (F.col("f") * F.col("f_b")).cast("decimal(38,0)")
    values = changed.where(F.col("data_type").isin(*CATEGORICAL) & ~is_null).join(sized, key).where(moved).select(*key)

    shift = nulls.unionByName(medians).unionByName(values).withColumn("finding", F.lit("shift"))
    return direct.unionByName(shift).distinct()
