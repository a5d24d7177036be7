"""One topic for every document, from hand labels of some: what the topic marginal of a mixture is raked to.

A naive Bayes classifier over the tokens that a document holds. It is fitted on a bounded sample
of labelled documents (LABELLED rows, in an order given by a hash) and judges every document in
the pass that counts its tokens. A token's weight for a subject compares the share of the subject's
labelled documents that hold it with the share that would if, within each language, subjects held
it alike. Only evidence for a subject counts: weights below TELLING and of single documents are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrymark.llm import bpe
from quarrymark.sources.shared import staged

#: The greatest number of labelled rows that the classifier is fitted on.
LABELLED = 20_000
#: A token speaks for a subject if so many times as large a share of its documents hold it as expected, two of them at least.
TELLING = 2.5


def _held(n: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and token of every different token of each document, in order of both."""
    pair = np.unique(np.repeat(np.arange(len(n), dtype=np.int64), n) * width + ids)
    return pair // width, pair % width


def token_weights(labelled: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """Subjects, and weights (token, subject), from labelled documents (key, lang, text, subject); both empty without any.

    A document with several subjects counts for each. Null languages are a group of their own.
    """
    rows = staged(labelled.where("subject is not null and text is not null").orderBy(F.xxhash64("key", "subject")).limit(LABELLED).select(F.struct(F.coalesce("lang", F.lit("?")).alias("lang"), "subject").alias("of"), "text"), "labelled")
    groups = [(r["of"]["lang"], r["of"]["subject"], r["count"]) for r in rows.groupBy("of").count().collect()]  # languages times subjects
    names, langs = sorted({s for _, s, _ in groups}), sorted({g for g, _, _ in groups})
    at_lang, at_name = {g: i for i, g in enumerate(langs)}, {s: i for i, s in enumerate(names)}
    vocabulary = bpe.Vocabulary(path)
    width = vocabulary.size
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary, at_lang, at_name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, lang, name = shared.value
        encoder = bpe.Encoder(vocab)
        held = np.zeros((len(lang), len(name), width), np.int32)
        for b in batches:
            of = b.column(0).to_pylist()
            n, ids = encoder.encode(b.column(1).to_pylist())
            doc, token = _held(n, ids, width)
            np.add.at(held, (np.array([lang[x["lang"]] for x in of], int)[doc], np.array([name[x["subject"]] for x in of], int)[doc], token), 1)
        g, s, t = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(s), pa.array(t), pa.array(held[g, s, t].astype(np.int64))], names=["g", "s", "t", "n"])

    docs, held = np.zeros((len(langs), len(names))), np.zeros((len(langs), len(names), width))
    for g, s, n in groups:
        docs[at_lang[g], at_name[s]] = n
    if names:
        sums = rows.mapInArrow(run, "g long, s long, t long, n long").groupBy("g", "s", "t").agg(F.sum("n").alias("n")).toArrow()  # of at most LABELLED rows
        g, s, t, n = (c.to_numpy() for c in sums.columns)
        held[g, s, t] = n
    expected = (held.sum(1, keepdims=True) * (docs / np.maximum(docs.sum(1, keepdims=True), 1))[:, :, None]).sum(0)
    held, size = held.sum(0), docs.sum(0)[:, None]
    usual = (expected + 0.1) / (size + 1)
    weights = np.log((held + usual) / (size + 1) / usual)
    weights[(weights < np.log(TELLING)) | (held < 2)] = 0
    return names, np.ascontiguousarray(weights.T, np.float32)


def sized(df: DataFrame, key: str, text: str, names: list[str], weights: np.ndarray, path: str) -> DataFrame:
    """key, tokens, topic of every row: its size in tokens, and the subject that its tokens speak for most.

    Null and empty texts have 0 tokens and no topic; nor has any row if there are no subjects.
    """
    vocabulary = bpe.Vocabulary(path)
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, weights))
    width = vocabulary.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, weigh = shared.value
        encoder = bpe.Encoder(vocab)
        label = pa.array(names, pa.string())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in bpe.slices(texts):
                n, ids = encoder.encode(texts[a:b])
                n = np.asarray(n)
                best = np.zeros(len(n), np.int64)
                if names and len(ids):
                    doc, token = _held(n, np.asarray(ids), width)
                    starts = np.flatnonzero(np.diff(doc, prepend=-1))
                    best[doc[starts]] = np.add.reduceat(weigh[token], starts, axis=0).argmax(1)
                topic = label.take(pa.array(best, mask=n == 0)) if names else pa.nulls(len(n), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), topic], names=["key", "tokens", "topic"])

    return df.select(key, text).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, tokens long, topic string").withColumnRenamed("key", key)
