"""Subject areas of documents, several per document.

Method: normalised document vectors (tf-idf over all documents) are clustered by bisecting
k-means. Each leaf is labelled by its discriminative terms, together with the hand-labelled
documents that fall into it. The leaves' mixtures of subjects, carried to the terms by how often
each leaf uses them, score every typeset sentence by the terms that tell subjects apart, with the
document's leaf mixture as prior. A document has each subject that a given share of its
subject-bearing sentences is about.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from quarrymark.llm import latex
from quarrymark.sources.shared import staged

#: Leaves of each language's tree.
LEAVES = 64
#: Rounds of k-means at each level of a tree.
TREE_ROUNDS = 6
#: A term occurs in at least 4 documents and this share of them on top, which bounds the vocabulary by documents' mean length over the share.
MIN_DF = 1e-4
#: Discriminative terms that name a leaf.
LEAF_TERMS = 15
#: A term tells subjects apart if the subject that uses it most does so in so many times as large a share of its documents as the median subject.
TELLING = 2.5
#: Documents scored at once.
SLICE = 1000
#: Frequent function words, which tell a text's language.
FUNCTION_WORDS = {
    "en": "the and for our all with from each was this that not are but its when how both between once were their these there after".split(),
    "de": "der die das und für mit von wir wie sich ein eine einen keinen nicht zwischen ohne wurde auf den dem des zu lässt fanden".split(),
    "es": "los las del que con por para una entre sobre sin luego más este como tienen cuenta relación caso casos valores examinamos".split(),
}
LANGUAGES = [*FUNCTION_WORDS]
#: Rows of ``bodies`` with any words.
FILLED = "size(own) > 0"


def bodies(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, lang, own, times, places, sizes: the words of each row's typeset sentences; all lists empty for null, empty and unfinished texts without any.

    lang is the number in LANGUAGES of the language most of whose function words occur, the first
    of equals. own: the different words of the row; times: how often each occurs; places: the
    words in order, as places in own; sizes: the words of each sentence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, own, times, places, sizes, per_doc = [], [], [], [], [], [[0], [0], [0]]
            for t in b.column(1):
                lines = latex.sentence_words(t.as_py())
                held = Counter(chain.from_iterable(lines))
                langs.append(max(range(len(LANGUAGES)), key=lambda i: sum(held.get(w, 0) for w in FUNCTION_WORDS[LANGUAGES[i]])))
                at = dict(zip(held, range(len(held))))
                own += held
                times += held.values()
                places += map(at.__getitem__, chain.from_iterable(lines))
                sizes += map(len, lines)
                per_doc[0].append(len(own)), per_doc[1].append(len(places)), per_doc[2].append(len(sizes))
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, k)) for o, v, k in zip((per_doc[0], *per_doc), (own, times, places, sizes), (pa.string(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.int32()), *lists], names=["key", "lang", "own", "times", "places", "sizes"])

    return staged(df.select(key, text).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, lang int, own array<string>, times array<int>, places array<int>, sizes array<int>"), "bodies")


def vocabulary(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Terms, their document frequencies (language, term) over all documents, and the documents with any words of each language.

    A term is kept from 4 + MIN_DF * documents on, by one rule at every size.
    """
    filled = docs.where(FILLED)
    sizes = np.zeros(len(LANGUAGES))
    for r in filled.groupBy("lang").count().collect():
        sizes[r["lang"]] = r["count"]
    words = docs.select("lang", F.explode("own").alias("term")).groupBy("term", "lang").agg(F.count("*").alias("df"))
    per_term = words.groupBy("term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("lang", "df")).alias("by")).where(F.col("df") >= 4 + MIN_DF * sizes.sum())
    rows = sorted((r["term"], [(x["lang"], x["df"]) for x in r["by"]]) for r in per_term.collect())
    df = np.zeros((len(LANGUAGES), len(rows)))
    for i, (_, by) in enumerate(rows):
        for lang, n in by:
            df[lang, i] = n
    return [t for t, _ in rows], df, sizes


def coded(docs: DataFrame, terms: list[str]) -> DataFrame:
    """key, lang, ids, sizes, tf of ``bodies`` with any words: each sentence as the numbers of its terms, and how many those are; sentences without any are left out. tf: a vector of the terms' counts."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    width = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in batches:
            rows = np.arange(b.num_rows)
            words = b.column(2)
            coding = words.flatten().dictionary_encode()  # each different word of the batch is looked up once
            number = np.array([get(w, -1) for w in coding.dictionary.to_pylist()], np.int32)[coding.indices.to_numpy()]
            held = np.diff(words.offsets.to_numpy())
            begin = np.cumsum(held) - held
            places, sizes = b.column(4), b.column(5)
            length = np.diff(places.offsets.to_numpy())
            ids = number[places.flatten().to_numpy() + np.repeat(begin, length)]
            lines = np.diff(sizes.offsets.to_numpy())
            line = np.repeat(np.arange(lines.sum()), sizes.flatten().to_numpy())
            known = ids >= 0
            per_line = np.bincount(line[known], minlength=lines.sum())
            of_line = np.repeat(rows, lines)
            counts = b.column(3).flatten().to_numpy()
            doc, mine = np.repeat(rows, held), number >= 0
            order = np.lexsort((number[mine], doc[mine]))

            def listed(values: np.ndarray, owner: np.ndarray, kind: pa.DataType) -> pa.ListArray:
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b.num_rows))])  # noqa: B023
                return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))

            own = listed(number[mine][order], doc[mine], pa.int32())
            sparse = [pa.array(np.full(b.num_rows, v), k) for v, k in ((0, pa.int8()), (width, pa.int32()))]
            tf = pa.StructArray.from_arrays([*sparse, own, listed(counts[mine][order], doc[mine], pa.float64())], names=["type", "size", "indices", "values"])
            lists = listed(ids[known], np.repeat(rows, length)[known], pa.int32()), listed(per_line[per_line > 0], of_line[per_line > 0], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists, tf], names=["key", "lang", "ids", "sizes", "tf"])

    schema = T.StructType([docs.schema["key"], docs.schema["lang"], *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "sizes")), T.StructField("tf", VectorUDT())])
    return staged(docs.where(FILLED).mapInArrow(run, schema), "coded", by="lang")


def clustered(docs: DataFrame, df: np.ndarray, sizes: np.ndarray, seed: int = 7) -> DataFrame:
    """docs (coded) with the leaf of each row.

    The leaves are those of bisecting k-means of the normalised vectors, a tree for each language.
    Counts are weighted by the square of the inverse document frequency within the language, so
    that what all its documents say weighs next to nothing.
    """
    out = None
    for lang in np.flatnonzero(sizes):
        idf = np.maximum(np.log((sizes[lang] + 1) / (df[lang] + 1)), 0) ** 2
        weighted = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="tfidf")
        unit = Normalizer(inputCol="tfidf", outputCol="unit")
        mine = unit.transform(weighted.transform(docs.where(F.col("lang") == int(lang)))).drop("tfidf")
        model = BisectingKMeans(k=LEAVES, maxIter=TREE_ROUNDS, seed=seed, featuresCol="unit", predictionCol="leaf").fit(mine.select("unit"))
        part = model.transform(mine).drop("unit").withColumn("leaf", F.col("leaf") + int(lang) * LEAVES)
        out = part if out is None else out.unionByName(part)
    return staged(out, "leaves")


def leaf_subjects(used: np.ndarray, tagged: np.ndarray, by_subject: np.ndarray) -> np.ndarray:
    """P(subject | leaf) from the leaves' term counts, counts of hand labels (leaf, subject) and the labelled documents' term counts (subject, term)."""
    share = (used + 1e-9) / (used.sum(1, keepdims=True) + 1e-9)
    overall = (used.sum(0) + 1e-9) / (used.sum() + 1e-9)
    lift = np.log(share / overall)
    seen = by_subject.sum(1) > 0
    prob = (by_subject + 0.5) / (by_subject.sum(1, keepdims=True) + 0.5 * by_subject.shape[1])
    evidence = np.log(prob / np.maximum(prob[seen].mean(0), 1e-12)) if seen.any() else np.zeros_like(prob)
    evidence[:, by_subject.sum(0) < 2] = 0  # terms of no labelled document tell nothing
    out = np.zeros((len(used), len(by_subject)))
    for leaf in range(len(used)):
        top = np.argsort(-(lift[leaf] * share[leaf]))[:LEAF_TERMS]
        named = (evidence[:, top] * share[leaf, top] / share[leaf, top].sum()).sum(1)
        named[~seen] = -np.inf
        by_terms = np.exp(4 * (named - named.max())) if seen.any() else np.ones(len(named))
        mix = tagged[leaf] + by_terms / by_terms.sum()
        out[leaf] = mix / mix.sum()
    return out


def term_weights(counts: np.ndarray) -> np.ndarray:
    """(language, term, subject): how much more often a subject uses a term than the subjects together do, smoothed; from counts (language, subject, term)."""
    share = (counts + 0.05) / (counts.sum(2, keepdims=True) + 0.05 * counts.shape[2])
    return (share / share.mean(1, keepdims=True)).transpose(0, 2, 1)


def telling(held: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """(language, term): whether a term tells subjects apart, from documents holding it (language, subject, term) and all documents (language, subject)."""
    share = (held + 0.02) / (docs[:, :, None] + 1)
    return share.max(1) >= TELLING * np.median(share, 1)


def _softmax(score: np.ndarray) -> np.ndarray:
    score = np.exp(score - score.max(1, keepdims=True))
    return score / score.sum(1, keepdims=True)


class Scorer:
    """Scores the sentences of many documents at once by the weights of the terms that tell subjects apart."""

    def __init__(self, weights: np.ndarray, tells: np.ndarray, mixes: np.ndarray):
        self.vocab = weights.shape[1]
        self.logs = np.log(np.maximum(weights, 1e-6)).astype(np.float32).reshape(-1, weights.shape[2])
        self.tells = tells.ravel()
        self.priors = np.log(mixes + 0.05).astype(np.float32)

    def score(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """Of slices of (lang, leaf, ids, sizes): first row of the slice, document of each subject-bearing sentence, its posteriors.

        A sentence's prior is its leaf's mixture of subjects at first, then the document's own.
        """
        for at in range(0, batch.num_rows, SLICE):
            b = batch.slice(at, SLICE)
            lang, leaf, ids, sizes = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), b.column(3)
            doc = np.repeat(np.arange(b.num_rows), np.diff(sizes.offsets.to_numpy()))
            held = sizes.flatten().to_numpy()
            line = np.repeat(np.arange(len(held)), held)
            term = ids.flatten().to_numpy() + lang[doc][line].astype(np.int64) * self.vocab
            keep = self.tells[term]
            term, line = term[keep], line[keep]
            if not len(term):
                continue
            starts = np.flatnonzero(np.diff(line, prepend=-1))
            doc = doc[line[starts]]
            score = np.add.reduceat(self.logs[term], starts, axis=0)
            post = _softmax(score + self.priors[leaf[doc]])
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            own = np.add.reduceat(post, first, axis=0) / np.diff(first, append=len(doc))[:, None]
            own = np.repeat(np.log(own + 0.02), np.diff(first, append=len(doc)), axis=0)
            yield at, doc, _softmax(score + own)


def subject_shares(docs: DataFrame, weights: np.ndarray, tells: np.ndarray, mixes: np.ndarray, names: list[str]) -> DataFrame:
    """key, subject, share, sentences: of each document's subject-bearing sentences, the share about each subject."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, tells, mixes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        label = pa.array(names, pa.string())
        for b in batches:
            for at, doc, post in scorer.score(pa.RecordBatch.from_arrays(b.columns[1:], names=["lang", "leaf", "ids", "sizes"])):
                held = np.bincount(doc * len(names) + post.argmax(1), minlength=(doc[-1] + 1) * len(names)).reshape(-1, len(names))
                row, subject = np.nonzero(held)
                total = held.sum(1)[row]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + row)), label.take(pa.array(subject)), pa.array(held[row, subject] / total), pa.array(total.astype(np.int64))], names=["key", "subject", "share", "sentences"])

    return docs.select("key", "lang", "leaf", "ids", "sizes").mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, subject string, share double, sentences long")


def fitted(df: DataFrame, key: str, text: str, labels: DataFrame, areas: DataFrame) -> tuple[DataFrame, list[str], np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """What ``subject_shares`` takes, or one without terms if no text has words or no label fits.

    labels: (key, subject), any repeats and errors; areas: (subject), the possible subjects. A
    subject without any labelled document can't be told from the others and is never assigned.
    """
    areas = [r[0] for r in areas.select("subject").where("subject is not null").distinct().collect()]  # a list of subjects
    marks = labels.select(F.col(key).alias("key"), "subject").where(F.col("subject").isin(areas)).distinct()
    names = sorted(r[0] for r in marks.select("subject").distinct().collect())
    docs = bodies(df, key, text)
    terms, freq, sizes = vocabulary(docs)
    if not terms or not names:
        return docs, [], np.zeros(0), np.zeros(0), np.zeros(0), names
    leaves = clustered(coded(docs, terms), freq, sizes)
    at = {s: i for i, s in enumerate(names)}
    groups, width, vocab = len(LANGUAGES) * LEAVES, len(names), len(terms)
    used, tagged, by_subject = np.zeros((groups, vocab)), np.zeros((groups, width)), np.zeros((len(LANGUAGES), width, vocab))
    held, size = np.zeros((groups, vocab)), np.zeros(groups)
    for r in leaves.groupBy("leaf").agg(Summarizer.metrics("sum", "numNonZeros", "count").summary(F.col("tf")).alias("tf")).collect():
        used[r["leaf"]], held[r["leaf"]], size[r["leaf"]] = r["tf"]["sum"].toArray(), r["tf"]["numNonZeros"].toArray(), r["tf"]["count"]
    marked = staged(leaves.select("key", "lang", "leaf", "tf").join(marks, "key"), "marked")
    for r in marked.groupBy("leaf", "subject").count().collect():
        tagged[r["leaf"], at[r["subject"]]] = r["count"]
    for r in marked.groupBy("lang", "subject").agg(Summarizer.sum(F.col("tf")).alias("tf")).collect():
        by_subject[r["lang"], at[r["subject"]]] = r["tf"].toArray()
    mixes = np.concatenate([leaf_subjects(*(x[g * LEAVES : (g + 1) * LEAVES] for x in (used, tagged)), by_subject[g]) for g in range(len(LANGUAGES))])
    of_leaves = lambda x: np.stack([mixes[g * LEAVES : (g + 1) * LEAVES].T @ x[g * LEAVES : (g + 1) * LEAVES] for g in range(len(LANGUAGES))])
    weights, tells = term_weights(of_leaves(used)), telling(of_leaves(held), of_leaves(size))
    return leaves, terms, weights, tells, mixes, names


def assigned(df: DataFrame, key: str, text: str, labels: DataFrame, areas: DataFrame, least: float = 0.25) -> DataFrame:
    """key, subject, share, sentences: the subjects that at least that share of a document's subject-bearing sentences are about.

    Documents without such sentences (null, empty, stubs) have no row. Rows of one key are
    judged each; repeated rows of a key and subject are given once, with the largest share.
    """
    docs, terms, weights, tells, mixes, names = fitted(df, key, text, labels, areas)
    kind = df.schema[key].dataType.simpleString()
    found = subject_shares(docs, weights, tells, mixes, names) if terms else df.sparkSession.createDataFrame([], f"key {kind}, subject string, share double, sentences long")
    return found.where(F.col("share") >= least).groupBy("key", "subject").agg(F.max("share").alias("share"), F.max("sentences").alias("sentences")).withColumnRenamed("key", key)
