"""Mixing sources to target shares of the total size.

Method: iterative proportional fitting. The token sums of the cells (source, language, topic)
are raked to three marginals: the target shares of the sources, and the shares that languages and
topics have in the corpus. A cell's fitted over its present size is what each of its documents
should be used; documents are then drawn by these calibrated figures, with the whole part for
sure and the rest by systematic sampling in order of size, so that the sums come out nearly as
fitted. Sources have priority over the other marginals, and the repeats' caps over all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from quarrymark.sources.shared import staged

#: Raking ends when no cell moves by more than this share of the total any more, or after so many rounds.
TOLERANCE, ROUNDS = 1e-9, 1000
#: Bits after the point of the rests that are summed up, in whole numbers so that their order doesn't matter.
POINT = 30


def fit_cells(size: np.ndarray, source: np.ndarray, others: list[np.ndarray], share: np.ndarray, cap: np.ndarray, total: float | None = None) -> np.ndarray:
    """Uses per document of each cell.

    size: tokens of each cell; source: its source's number; others: its number in each further
    marginal; share and cap: target share and greatest number of uses of each source. total: size
    of the mixture, by default the largest at which every source with documents reaches its
    share. A source without documents gets nothing and the others keep their proportions.
    """
    have = np.bincount(source, weights=size, minlength=len(share))
    want = np.where(have > 0, share, 0.0)
    if not want.sum():
        return np.zeros(len(size))
    want = want / want.sum()
    most = have * cap
    if total is None:
        total = float(np.min(most[want > 0] / want[want > 0]))
    aim = np.minimum(want * total, most)
    others = [(m, np.bincount(m, weights=size) / size.sum() * aim.sum()) for m in others]
    x = size.astype(float)

    def rake(marginal: np.ndarray, target: np.ndarray) -> None:
        now = np.bincount(marginal, weights=x, minlength=len(target))
        x[:] = x * np.divide(target, now, out=np.zeros_like(now), where=now > 0)[marginal]

    limit = size * cap[source]
    for _ in range(ROUNDS):
        before = x.copy()
        for m, target in others:
            rake(m, target)
            np.minimum(x, limit, out=x)
        # the sources last: what the cap cuts off goes to the source's other cells
        rake(source, aim)
        while (x > limit * (1 + 1e-12)).any():
            np.minimum(x, limit, out=x)
            free = x < limit * (1 - 1e-12)
            fixed = np.bincount(source, weights=np.where(free, 0, x), minlength=len(aim))
            loose = np.bincount(source, weights=np.where(free, x, 0), minlength=len(aim))
            factor = np.divide(aim - fixed, loose, out=np.ones_like(loose), where=loose > 0)
            x[free] *= np.maximum(factor, 1.0)[source][free]
        if np.abs(x - before).max() <= TOLERANCE * aim.sum():
            break
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def drawn(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs (key, source, tokens, uses) with copies: the whole part of uses, and one more where the running sum of the rests passes a whole number.

    Within a source the documents are taken in order of their tokens, equal ones in an order
    given by the seed. The running sum is made of sums per range-sorted partition, so that a
    source may hold any part of all rows; it is a sum of whole numbers, so that the draw does not
    depend on how the rows are partitioned.
    """
    keyed = docs.withColumns({"rest": F.floor((F.col("uses") - F.floor("uses")) * 2**POINT), "mix": F.xxhash64("key", F.lit(seed))})
    parts = staged(keyed.repartitionByRange("source", "tokens", "mix").withColumn("pid", F.spark_partition_id()), "by-size")
    held = parts.groupBy("source", "pid").agg(F.sum("rest").alias("held"))  # at most sources + partitions rows
    before = held.withColumn("before", F.sum("held").over(Window.partitionBy("source").orderBy("pid")) - F.col("held")).drop("held")
    inside = Window.partitionBy("source", "pid").orderBy("tokens", "mix", "key").rowsBetween(Window.unboundedPreceding, 0)
    run = parts.join(F.broadcast(before), ["source", "pid"]).withColumn("upto", F.col("before") + F.sum("rest").over(inside) + 2 ** (POINT - 1))
    whole = lambda c: F.shiftright(c, POINT)
    return run.withColumn("copies", (F.floor("uses") + whole(F.col("upto")) - whole(F.col("upto") - F.col("rest"))).cast("long")).drop("rest", "mix", "pid", "before", "upto")


def mixture(docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """key, source, lang, topic, tokens, copies of the documents of a mixture; those not used have 0 copies.

    docs: key, source, lang, topic, tokens; a null source, or one without target, belongs to no
    target and has no row. Null language and topic are a class of their own. Documents of 0
    tokens count for nothing and have 0 copies. targets: source, target_share, max_repeats;
    repeated rows of a source: the greatest share. An empty table of either kind gives no rows.
    """
    wanted = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*").orderBy("source").collect()
    spark = docs.sparkSession
    number = {r["source"]: i for i, r in enumerate(wanted)}
    sized = staged(docs.where(F.col("source").isin([*number]) if number else F.lit(False)).fillna("?", ["lang", "topic"]), "sized")
    # cells of few sources, languages and topics: a table of metadata
    cells = sized.where("tokens > 0").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("size")).orderBy("source", "lang", "topic").collect()
    code = lambda c: np.unique([r[c] for r in cells], return_inverse=True)[1].ravel().astype(int)
    rows = []
    if cells:
        uses = fit_cells(
            np.array([r["size"] for r in cells], float), np.array([number[r["source"]] for r in cells]), [code("lang"), code("topic")],
            np.array([r["target_share"] for r in wanted], float), np.array([r["max_repeats"] if r["max_repeats"] is not None else 1 for r in wanted], float), total,
        )
        rows = [(r["source"], r["lang"], r["topic"], float(u)) for r, u in zip(cells, uses)]
    fitted = spark.createDataFrame(rows, "source string, lang string, topic string, uses double")
    joined = sized.join(F.broadcast(fitted), ["source", "lang", "topic"], "left").withColumn("uses", F.when(F.col("tokens") > 0, F.coalesce("uses", F.lit(0.0))).otherwise(0.0))
    return drawn(joined.select("key", "source", "lang", "topic", "tokens", "uses")).select("key", "source", "lang", "topic", "tokens", "copies")


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, documents, tokens, used_tokens, most_copies, actual_share, fitted_share, reached for every target.

    fitted_share: the target, with the shares of sources without any tokens spread over the
    others in proportion. reached: whether the actual share lies within 0.01 of that.
    """
    sums = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    out = targets.select("source", "target_share", "max_repeats").join(sums, "source", "left").fillna(0, ["documents", "tokens", "used_tokens", "most_copies"])
    all_sources = Window.partitionBy(F.lit(1))  # one row per source
    whole, held = F.sum("used_tokens").over(all_sources), F.sum(F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0.0)).over(all_sources)
    out = out.withColumn("actual_share", F.when(whole > 0, F.col("used_tokens") / whole).otherwise(0.0)).withColumn("fitted_share", F.when((held > 0) & (F.col("tokens") > 0), F.col("target_share") / held).otherwise(0.0))
    return out.withColumn("reached", F.abs(F.col("actual_share") - F.col("fitted_share")) <= 0.01)


def marginals(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """marginal (``source``, ``language``, ``topic``), value, target_share, actual_share, error: what the mixture was fitted to and what it really holds, in tokens.

    Of languages and topics the target is the share that they have in the documents of all target
    sources. The cap on repeats and the sources' shares come first, so that these may miss theirs.
    """
    mixed = mixed.where("tokens > 0")
    sums = mixed.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("used"))  # cells: metadata
    sums = staged(sums, "cells")
    total = sums.agg(F.sum("tokens").alias("all_tokens"), F.sum("used").alias("all_used"))
    by = lambda c, name: sums.groupBy(F.col(c).alias("value")).agg(F.sum("tokens").alias("tokens"), F.sum("used").alias("used")).select(F.lit(name).alias("marginal"), "value", "tokens", "used")
    shares = by("lang", "language").unionByName(by("topic", "topic")).crossJoin(F.broadcast(total))  # one row
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)
    rest = shares.select("marginal", "value", share("tokens", "all_tokens").alias("target_share"), share("used", "all_used").alias("actual_share"))
    sources = reached(mixed, targets).select(F.lit("source").alias("marginal"), F.col("source").alias("value"), F.col("fitted_share").alias("target_share"), "actual_share")
    return sources.unionByName(rest).withColumn("error", F.col("actual_share") - F.col("target_share"))
