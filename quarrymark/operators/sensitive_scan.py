"""Sensitive-data findings of columns, how they spread along relationships, and where their values leak.

Cells are scanned in Arrow batches where they lie and counted per task, so that what leaves it
are counts and masked examples by column and kind and never cells.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quarrymark.functions import sensitive
from quarrymark.functions.types import CREDENTIAL_NAME, FREE_TEXT_NAME, POINTER_NAME
from quarrymark.sources.shared import staged

#: Kinds that identify a person and are handed on to referring tables. IDENTITY_BUNDLE is accepted and never produced.
DIRECT = (
    "EMAIL", "PHONE", "SSN_US", "SSN", "PASSPORT_GB", "PASSPORT_US", "PASSPORT", "IBAN", "CC_NUMBER", "PESEL_PL", "BSN_NL", "NIR_FR", "AADHAAR_IN", "MRN", "NPI_US", "MEDICARE_MBI", "PERSONNUMMER_SE", "TAX_ID_DE", "CODICE_FISCALE_IT", "IDENTITY_BUNDLE",
)
KEEP_RATE = 0.05


def text_cells(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """table_name, column_name, value: the cells of text columns, every row of them."""
    out = None
    for name, (df, cols) in tables.items():
        part = df.select(F.inline(F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value")) for c in cols])))
        out = part if out is None else out.unionByName(part)
    return out


#: Bytes of a table as it is stored that are worth a task.
SPREAD = 1 << 20
COUNTS = "table_name string, column_name string, kind string, ok boolean, n long, example string"


def match_counts(tables: dict[str, tuple[DataFrame, list[str]]], strict: bool = False) -> DataFrame:
    """table_name, column_name, kind, matched, valid, example: per column and kind, cells with such a match, with one that its check accepts, and the least of the masked matches. kind null: cells scanned.

    tables: name -> (table, text columns). Each is read once, where it lies: no text is shuffled,
    and values that a task meets again soon are scanned once. Only a table of fewer parts than
    its size is worth and there are cores for is spread first, as the work is in the scan.
    """
    cores = next(iter(tables.values()))[0].sparkSession.sparkContext.defaultParallelism
    counted = None
    for name, (df, cols) in tables.items():
        texts = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
        parts = min(cores, 1 + int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // SPREAD)
        if parts > 1 and texts.rdd.getNumPartitions() < parts:
            texts = texts.repartition(parts)
        part = texts.mapInArrow(_scanner(name, cols, strict), COUNTS)
        counted = part if counted is None else counted.unionByName(part)
    counts = counted.groupBy("table_name", "column_name", "kind").agg(F.sum("n").alias("matched"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("valid"), F.min("example").alias("example"))
    return staged(counts, "counts")  # what is made of them reads them several times


#: Cells and bytes that a task gathers before it scans them.
GATHERED = 200_000, 1 << 24


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, cells, size = [], 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        cells, size = cells + b.num_rows * b.num_columns, size + b.nbytes
        if cells >= GATHERED[0] or size >= GATHERED[1]:
            yield pa.Table.from_batches(held)
            held, cells, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _scanner(table: str, cols: list[str], strict: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        least: dict[tuple, str] = {}
        for part in _gathered(batches):
            for column, cells in zip(cols, part.columns):
                total[column, None, False] += len(cells)
                held = pc.value_counts(pc.cast(cells.combine_chunks(), pa.binary()).drop_null())
                times = held.field("counts").to_numpy()
                for cell, kind, valid, values in sensitive.first_matches(held.field("values").to_pylist(), strict):
                    seen: dict[str, set[str]] = {}
                    for k, v in zip(kind.tolist(), values):
                        name = sensitive.KINDS[k]
                        seen.setdefault(name, set()).add(sensitive.telling_part(v, name))
                    for k, n in enumerate(np.bincount(2 * kind + valid, times[cell]).astype(np.int64).tolist()):
                        if n:
                            total[column, sensitive.KINDS[k // 2], k % 2 == 1] += n
                    for name, parts in seen.items():
                        mask = min(sensitive.masked(v, name) for v in parts)
                        least[column, name] = min(least.get((column, name), mask), mask)
        rows = [(table, *k, n, least.get(k[:2])) for k, n in total.items()]
        types = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=["table_name", "column_name", "kind", "ok", "n", "example"])

    return run


def prior_columns(column: Column) -> tuple[Column, Column]:
    """The kind that a column name implies and its strength, as expressions."""
    name = F.regexp_replace(F.lower(column), "_", " ")
    rules = F.array(*[F.struct(F.lit("(?i)" + regex).alias("regex"), F.lit(kind).alias("kind")) for regex, kind in sensitive.PRIORS])
    first = F.get(F.filter(rules, lambda r: F.rlike(name, r["regex"])), F.lit(0))
    whole = F.call_function("regexp_extract", name, first["regex"], F.lit(0)) == name
    return first["kind"], F.when(first.isNull(), 0.0).when(whole, 0.85).otherwise(0.5)


def findings(counts: DataFrame, keep_rate: float = KEEP_RATE) -> DataFrame:
    """table_name, column_name, pii_type, detector, match_rate, score, validated, name_prior, example: what a column's counts and name say; example is a masked match.

    A kind without positive prior is dropped on pointer and credential names, and always for
    kinds that need one. A prior without matches is a finding of its own (``name_prior``).
    """
    scanned = counts.where("kind is null").select("table_name", "column_name", F.col("matched").alias("rows"))
    kind, strength = prior_columns(F.col("column_name"))
    named = scanned.withColumns({"prior": kind, "strength": strength, "is_pointer": F.col("column_name").rlike(POINTER_NAME), "is_credential": F.col("column_name").rlike(CREDENTIAL_NAME), "is_prose": F.col("column_name").rlike(FREE_TEXT_NAME)})
    seen = named.join(counts.where("kind is not null"), ["table_name", "column_name"])
    s = F.when(F.col("kind") == F.col("prior"), F.col("strength")).otherwise(0.0)
    seen = seen.withColumn("s", s).where(~((F.col("s") == 0) & (F.col("is_pointer") | F.col("is_credential") | F.col("kind").isin(*sensitive.NAME_REQUIRED))))
    score = 1 - (1 - F.col("s")) * (1 - F.least(F.lit(1.0), F.col("matched") / F.col("rows") / 0.30)) * (1 - F.col("valid") / F.col("matched"))
    score = score * F.when(F.col("is_prose") & (F.col("s") == 0), 0.4).otherwise(1.0)
    regex = seen.select("table_name", "column_name", F.col("kind").alias("pii_type"), F.lit("regex").alias("detector"), (F.col("valid") / F.col("rows")).alias("match_rate"), score.alias("score"), (F.col("valid") > 0).alias("validated"), (F.col("s") > 0).alias("name_prior"), "example")
    only = named.where("prior is not null").join(seen.select("table_name", "column_name", F.col("kind").alias("prior")), ["table_name", "column_name", "prior"], "left_anti")
    by_name = only.select("table_name", "column_name", F.col("prior").alias("pii_type"), F.lit("name_prior").alias("detector"), F.lit(0.0).alias("match_rate"), F.col("strength").alias("score"), F.lit(False).alias("validated"), F.lit(True).alias("name_prior"), F.lit(None).cast("string").alias("example"))
    kept = regex.where((F.col("match_rate") >= keep_rate) | F.col("validated") | F.col("name_prior"))
    return kept.unionByName(by_name).withColumns({"match_rate": F.round("match_rate", 4), "score": F.round("score", 4)})


def regulations(spark) -> DataFrame:
    """pii_type, regulation: which regulations name which kinds."""
    return spark.createDataFrame([(p.name, r) for p in sensitive.PATTERNS for r in p.regulations], "pii_type string, regulation string")


def propagated(found: DataFrame, edges: DataFrame, score_floor: float = 0.85, confidence_floor: float = 0.8) -> DataFrame:
    """table_name, kind, distance: kinds of personal data of each table and of the tables that refer to it, over any number of steps; the least distance of each.

    edges: child_table, parent_table, confidence. Rounds of joins on the frontier, which is a set
    of (table, kind), until nothing new is reached; cycles end by themselves.
    """
    steps = staged(edges.where((F.col("confidence") >= confidence_floor) & (F.col("child_table") != F.col("parent_table"))).select("child_table", "parent_table").distinct(), "steps")
    reached = staged(found.where(F.col("pii_type").isin(*DIRECT) & (F.col("score") >= score_floor)).select("table_name", F.col("pii_type").alias("kind"), F.lit(0).alias("distance")).distinct(), "reached")
    frontier, distance = reached, 0
    while True:
        distance += 1
        nxt = frontier.join(steps, F.col("table_name") == F.col("parent_table")).select(F.col("child_table").alias("table_name"), "kind").distinct()
        frontier = staged(nxt.join(reached, ["table_name", "kind"], "left_anti").withColumn("distance", F.lit(distance)), "frontier")
        if not frontier.limit(1).count():
            return reached
        reached = reached.unionByName(frontier)


def leaks(found: DataFrame, pairs: DataFrame, classes: DataFrame, score_floor: float = 0.85, containment_floor: float = 0.5) -> DataFrame:
    """source, target, pii_type, containment: columns without finding, of another table and of the same class, whose values lie to that share in a column with one.

    pairs: child, parent (``table.column``), containment; classes: name, type_class.
    """
    name = F.concat_ws(".", "table_name", "column_name")
    source = found.where(F.col("score") >= score_floor).select(name.alias("parent"), "pii_type", F.col("table_name").alias("source_table"))
    marked = found.select(name.alias("child")).distinct()
    of = lambda side: classes.select(F.col("name").alias(side), F.col("type_class").alias(f"{side}_class"))
    out = pairs.where(F.col("containment") >= containment_floor).join(source, "parent").join(marked, "child", "left_anti").join(of("child"), "child").join(of("parent"), "parent")
    other = F.substring_index("child", ".", 1) != F.col("source_table")
    return out.where(other & (F.col("child_class") == F.col("parent_class"))).select(F.col("parent").alias("source"), F.col("child").alias("target"), "pii_type", "containment")


def luhn_valid(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


def card_brand(c: Column) -> Column:
    """Brand of a card number by its leading digits; null if none fits."""
    digits = F.regexp_replace(c, r"\D", "")
    out = F.lit(None).cast("string")
    for brand, n, low, high in reversed(sensitive.card_ranges()):
        lead = F.when(F.length(digits) >= n, digits.substr(1, n).try_cast("int"))
        out = F.when(lead.between(low, high), brand).otherwise(out)
    return out
