"""Personal information in free text: found and replaced with typed placeholders.

Method: a semi-Markov conditional random field. Candidate segments of bounded length are scored
as wholes by features of the span, its parts and its surroundings; everything else is text of
score 0. A forward pass over the segment lattice sums over all sets of segments that don't
overlap, for training; its maximising twin chooses boundaries and types jointly.

The weights are trained here, on texts that ``practice`` composes (a bounded number of labelled
rows, PRACTICE). What the features know of the data at hand are three gazetteers gathered from
all rows: given and family names of name columns, and towns that stand before a postcode. A name
need not be in them: titles, cues, verbs and an e-mail address of the same text speak for it too.
"""

from __future__ import annotations

import functools
import math
import random
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrymark.llm.pii_practice import practice
from quarrymark.llm.pii_spans import Candidate, Gazetteer, candidates, lookups
from quarrymark.sources.shared import staged

#: Composed texts on which the model is trained.
PRACTICE = 1800
EPOCHS = 14
#: The greatest number of names and towns that is broadcast, some 30 MB; of more, each text gets its own by a join.
GAZETTEER_ROWS = 500_000


# ---- the model -------------------------------------------------------------


def _lattice(cands: list[Candidate]) -> tuple[list[int], dict[int, int]]:
    points = sorted({p for c in cands for p in c[:2]})
    return points, {p: i for i, p in enumerate(points)}


def decode(cands: list[Candidate], weights: dict[str, float]) -> list[Candidate]:
    """The set of segments without overlap that has the greatest score; earlier and longer ones win ties."""
    if not cands:
        return []
    get = weights.get
    points, at = _lattice(cands)
    ending = defaultdict(list)
    for c in sorted(cands, key=lambda c: (c[0], -c[1], c[2])):
        score = sum(get(f, 0.0) for f in c[3])
        if score > 0:
            ending[c[1]].append((score, c))
    best, back = [0.0] * len(points), [None] * len(points)
    for i, p in enumerate(points):
        if i:
            best[i] = best[i - 1]
        for score, c in ending.get(p, ()):
            total = best[at[c[0]]] + score
            if total > best[i] + 1e-9:
                best[i], back[i] = total, c
    out, i = [], len(points) - 1
    while i >= 0:
        if back[i]:
            out.append(back[i])
            i = at[back[i][0]]
        else:
            i -= 1
    return out[::-1]


def _expected(cands: list[Candidate], scores: list[float]) -> list[float]:
    """Probability of each candidate under the model: forward and backward sums over the lattice, in logs."""
    points, at = _lattice(cands)
    n = len(points)
    ends, starts = defaultdict(list), defaultdict(list)
    for k, c in enumerate(cands):
        ends[at[c[1]]].append(k)
        starts[at[c[0]]].append(k)

    def add(xs: list[float]) -> float:
        top = max(xs)
        return top + math.log(sum(math.exp(x - top) for x in xs))

    fore, rear = [0.0] * n, [0.0] * n
    for i in range(1, n):
        fore[i] = add([fore[i - 1], *(fore[at[cands[k][0]]] + scores[k] for k in ends[i])])
    for i in range(n - 2, -1, -1):
        rear[i] = add([rear[i + 1], *(rear[at[cands[k][1]]] + scores[k] for k in starts[i])])
    return [math.exp(fore[at[c[0]]] + scores[k] + rear[at[c[1]]] - fore[n - 1]) for k, c in enumerate(cands)]


def train(rows: list[tuple[list[Candidate], set[tuple[int, int, str]]]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Weights of greatest conditional likelihood, by gradient steps (AdaGrad) with an L2 penalty."""
    w: dict[str, float] = defaultdict(float)
    power: dict[str, float] = defaultdict(lambda: 1e-6)
    order = random.Random(5)
    rows = [r for r in rows if r[0]]
    for _ in range(epochs):
        order.shuffle(rows)
        for cands, gold in rows:
            probs = _expected(cands, [sum(w[f] for f in c[3]) for c in cands])
            slope: dict[str, float] = defaultdict(float)
            for c, p in zip(cands, probs):
                d = (c[:3] in gold) - p
                if abs(d) > 1e-4:
                    for f in c[3]:
                        slope[f] += d
            for f, d in slope.items():
                d -= decay * w[f]
                power[f] += d * d
                w[f] += rate * d / math.sqrt(power[f])
    return dict(w)


# ---- the operator -------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def model(count: int = PRACTICE) -> dict[str, float]:
    """The trained weights; the same in every process."""
    return train([(candidates(text, gaz), gold) for text, gold, gaz in practice(count)])


def gazetteer(texts: DataFrame, text: str, people: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """v, kind (``given``, ``family``, ``town``), each once: every word of the name columns of people (table, given-name column, family-name column), and the towns of all texts: what stands between a comma or line break and a postcode.

    Nothing is left out for being rare. Words of a single letter are no names.
    """
    parts = [
        p[0].select(F.explode(F.split(F.lower(F.trim(F.col(f"`{p[of]}`"))), " +")).alias("v"), F.lit(kind).alias("kind")).where("length(v) > 1").distinct()
        for p in people for of, kind in ((1, "given"), (2, "family"))
    ]
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?:,[ ]?|\n)(\p{L}[\p{L}'-]+(?: \p{L}[\p{L}'-]+){0,3}) (?:\d{5}|[A-Z]{1,2}\d[0-9A-Z]? \d[A-Z]{2})(?!\w| \d)"), F.lit(1))
    towns = texts.where(F.col(text).rlike(r"\d{5}|\d[A-Z]{2}")).select(F.explode(found).alias("v")).select(F.lower("v").alias("v"), F.lit("town").alias("kind"))
    return functools.reduce(DataFrame.unionByName, parts, towns).distinct()


def _gathered(rows: list[tuple[str, str]]) -> Gazetteer:
    return Gazetteer(*(frozenset(v for v, k in rows if k == kind) for kind in ("given", "family", "town")))


FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("mention", pa.string())]))


def mentions(df: DataFrame, text: str, gaz: Gazetteer | DataFrame, weights: dict[str, float] | None = None, most: int = GAZETTEER_ROWS) -> DataFrame:
    """df's rows with ``found`` (array of struct start, end, kind, mention; characters from 0) and ``masked``, the text with [KIND] in place of each mention.

    Null texts have a null ``masked`` and nothing found; empty texts stay empty. All of a text
    outside the mentions is kept as it is. Rows may repeat; other columns pass through, and a
    column already named found or masked is replaced. A gazetteer of up to ``most`` rows is
    broadcast; of a greater one each text gets the entries it can use by a join, with the same result.
    """
    known = None
    if isinstance(gaz, DataFrame):
        gaz = staged(gaz, "gazetteer")
        if gaz.limit(most + 1).count() <= most:
            gaz = _gathered([tuple(r) for r in gaz.select("v", "kind").collect()])
        else:
            known, gaz = gaz, None
    shared = df.sparkSession.sparkContext.broadcast((gaz, weights or model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, w = shared.value
        for batch in batches:
            found, masked = [], []
            own = batch.column(2).to_pylist() if g is None else None
            for i, t in enumerate(batch.column(0).to_pylist()):
                mine = g or _gathered([(x["v"], x["kind"]) for x in own[i] or ()])
                spans = decode(candidates(t, mine), w) if t else []
                found.append([{"start": a, "end": b, "kind": k, "mention": t[a:b]} for a, b, k, _ in spans])
                masked.append(_masked(t, spans))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, FOUND), pa.array(masked, pa.string())], names=["row", "found", "masked"])

    rest = [c for c in df.columns if c not in ("found", "masked")]
    packed = df.select(F.col(f"`{text}`").alias("t"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, found array<struct<start:int,end:int,kind:string,mention:string>>, masked string"
    if known is not None:
        packed = _with_known(packed, known)
    return packed.mapInArrow(run, schema).select(*[F.col(f"row.`{c}`") for c in rest], "found", "masked")


def _with_known(packed: DataFrame, gaz: DataFrame) -> DataFrame:
    """t, row, known: the gazetteer's entries that each text can use."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = sorted(lookups(t)) if t else []
                yield pa.RecordBatch.from_arrays([pa.array([rid] * len(words), pa.int64()), pa.array(words, pa.string())], names=["rid", "v"])

    rows = staged(packed.withColumn("rid", F.monotonically_increasing_id()), "texts")
    hits = rows.select("rid", "t").mapInArrow(run, "rid long, v string").join(gaz, "v").groupBy("rid").agg(F.collect_list(F.struct("v", "kind")).alias("known"))  # as many as a text has words at most
    return rows.join(hits, "rid", "left").select("t", "row", "known")


def _masked(text: str | None, spans: list[Candidate]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind, _ in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def agreement(count: int = 200, seed: int = 977) -> Counter:
    """Counts of right, missed and false mentions by kind on composed texts not trained on, which hold other names and towns in the same sentences."""
    out: Counter = Counter()
    for text, gold, gaz in practice(count, seed):
        got = {c[:3] for c in decode(candidates(text, gaz), model())}
        out.update(("right", k) for _, _, k in got & gold)
        out.update(("false", k) for _, _, k in got - gold)
        out.update(("missed", k) for _, _, k in gold - got)
    return out
