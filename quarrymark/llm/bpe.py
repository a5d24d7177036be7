"""Byte-level BPE encoding of a whole corpus with a public tokenizer's vocabulary.

Method: each batch of texts is split into pieces; the pieces not met before are sorted by length
into buckets and put as padded rows of a numpy matrix of token ids. In every round each row
merges its leftmost pair of least rank, looked up in a hash table of pairs, and the matrix is
compacted by the one column that every row has lost; rows without mergeable pair leave it. Texts
are then put together from their pieces by array indexing.

Empty and null texts have no tokens: their ids are an empty list.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the public tokenizers' files; a parameter of every function that reads them.
TOKENIZERS = "/opt/tokenizers"
_EMPTY = np.int64(-1)
_NONE = np.int32(2**31 - 1)
#: Rows of a bucket times its width stay under this many cells.
MAX_CELLS = 4_000_000
#: Longer pieces (bytes) are merged one at a time with a heap, as rows of a matrix they would take quadratic time.
LONG_PIECE = 256
#: Known pieces are forgotten beyond this many, so that the memory of a worker has a bound.
MAX_KNOWN = 400_000
#: Texts of one output batch: so many characters at least.
SLICE_CHARS = 4_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=3)
def _classes(upto: int) -> tuple[str, str]:
    """Bodies of character classes for the letters and the numbers below a code point, as ranges."""
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(upto)])

    def ranges(kind: str) -> str:
        cuts = np.flatnonzero(np.diff(np.concatenate([[False], kinds == kind, [False]]).astype(np.int8)))
        return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(cuts[::2], cuts[1::2]))

    return ranges("L"), ranges("N")


#: The characters with the Unicode property White_Space, within ASCII and in all.
ASCII_SPACE = r"\t-\r "
WHITE_SPACE = ASCII_SPACE + "".join(f"\\u{c:04x}" for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: Texts are split by a pattern that knows no code points from here on, if they have none; ``re`` is fastest so.
PLANES = (0x80, 0x10000, 0x110000)


def split_pattern(upto: int) -> str:
    """The pattern of the public byte-level tokenizers, its classes written out for ``re``, for texts below a code point."""
    letters, numbers = _classes(upto)
    space = ASCII_SPACE if upto <= 0x80 else WHITE_SPACE
    return rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"


def plane(text: str) -> int:
    """Which of PLANES a text stays below."""
    return 0 if text.isascii() else 1 if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else 2


class MergeTable:
    """Hash table (open addressing) from a pair of token ids to the rank and id of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, vocab: int):
        self.vocab = np.int64(vocab)
        keys = left.astype(np.int64) * self.vocab + right
        self.bits = max(8, int(2 * len(keys)).bit_length() + 1)
        size = 1 << self.bits
        self.keys = np.full(size, _EMPTY)
        self.rank = np.full(size, _NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            free = self.keys[at[todo]] == _EMPTY
            slots, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[slots], self.rank[slots], self.merged[slots] = keys[put], put, merged[put]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE without a merge) and merged id of each pair; a negative id is padding."""
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left.astype(np.int64) * self.vocab + right)
        at = self._slot(keys)
        for _ in range(self.probes):
            miss = (self.keys[at] != keys) & (self.keys[at] != _EMPTY)
            if not miss.any():
                break
            at = np.where(miss, (at + 1) & (len(self.keys) - 1), at)
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], _NONE), self.merged[at]


class Vocabulary:
    """What the encoder needs of a byte-level BPE file; small enough to be sent to every worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.of_byte = np.zeros(256, np.int32)
        for letter, byte in byte_letters().items():
            self.of_byte[byte] = vocab[letter]
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.size = max(vocab.values()) + 1
        self.patterns = [split_pattern(p) for p in PLANES]


class Encoder:
    """Encodes texts; remembers the pieces it has met."""

    def __init__(self, v: Vocabulary):
        self.of_byte = v.of_byte
        self.table = MergeTable(v.left, v.right, v.merged, v.size)
        self.splits = [re.compile(p).findall for p in v.patterns]
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each text, and all their ids one after the other."""
        if len(self.known) > MAX_KNOWN:
            self._forget()
        known, splits = self.known, self.splits
        old = len(known)
        number = functools.partial(_numbered, known)
        lists = [number(splits[plane(t)](t)) if t else _NO_PIECES for t in texts]
        if len(known) > old:
            self._learn([x.encode("utf-8", "surrogatepass") for x in list(known)[old:]])
        pieces = np.concatenate(lists) if lists else _NO_PIECES
        sizes = self.sizes[pieces]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[pieces] - (ends - sizes), sizes)]
        upto = np.concatenate([[0], ends])
        bounds = upto[np.concatenate([[0], np.cumsum([len(x) for x in lists])])] if lists else np.zeros(1, np.int64)
        return np.diff(bounds), ids

    def _learn(self, pieces: list[bytes]) -> None:
        sizes, flat = encode_pieces(pieces, self.of_byte, self.table)
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.starts, self.sizes, self.flat = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])


_NO_PIECES = np.zeros(0, np.int64)


class _Numbers(dict):
    """Gives each new piece the next number."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def _numbered(known: dict[str, int], pieces: list[str]) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))


def encode_pieces(pieces: list[bytes], of_byte: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens of each piece, and all their ids one after the other, in the order given."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    data = of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    starts = np.cumsum(lengths) - lengths
    sizes = np.zeros(len(pieces), np.int64)
    rows, values = [], []  # of tokens: the piece, the id; tokens of a piece in order

    def put(owner: np.ndarray, ids: np.ndarray) -> None:
        rows.append(owner)
        values.append(ids)

    for i in np.flatnonzero(lengths > LONG_PIECE):
        ids = np.array(_merge_long(data[starts[i] : starts[i] + lengths[i]].tolist(), table), np.int32)
        put(np.full(len(ids), i), ids)
    short = np.flatnonzero(lengths <= LONG_PIECE)
    order = short[np.argsort(lengths[short], kind="stable")]
    at = 0
    while at < len(order):
        width = int(lengths[order[at]])
        width = width if width <= 8 else -(-width // 4) * 4  # buckets of exact length up to 8, then of four lengths
        upto = min(int(np.searchsorted(lengths[order], width, "right")), at + max(1, MAX_CELLS // max(width, 1)))
        bucket = order[at:upto]
        at = upto
        if width:
            column = np.arange(width)
            inside = column < lengths[bucket][:, None]
            matrix = np.where(inside, data[np.where(inside, starts[bucket][:, None] + column, 0)], np.int32(-1)).astype(np.int32)
            for owner, tokens in merge_rows(bucket, matrix, table):
                full = tokens >= 0
                put(np.repeat(owner, full.sum(1)), tokens[full])
    if rows:
        owner, ids = np.concatenate(rows), np.concatenate(values)
        order = np.argsort(owner, kind="stable")
        return np.bincount(owner, minlength=len(pieces)).astype(np.int64), ids[order]
    return sizes, np.zeros(0, np.int32)


def merge_rows(owner: np.ndarray, matrix: np.ndarray, table: MergeTable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merges every row of a padded matrix to the end; yields (owners, finished rows) as rows finish."""
    rank, merged = table.ranks(matrix[:, :-1], matrix[:, 1:])
    while True:
        width = matrix.shape[1]
        if width == 1:
            yield owner, matrix
            return
        at = rank.argmin(1)  # the leftmost of the least
        row = np.arange(len(matrix))
        done = rank[row, at] == _NONE
        if done.any():
            yield owner[done], matrix[done]
            keep = ~done
            owner, matrix, rank, merged, at = owner[keep], matrix[keep], rank[keep], merged[keep], at[keep]
            if not len(owner):
                return
            row = np.arange(len(matrix))
        matrix[row, at] = merged[row, at]
        stays = np.ones(matrix.shape, bool)
        stays[row, at + 1] = False
        matrix = matrix[stays].reshape(len(row), width - 1)
        if width == 2:
            continue
        # of the pairs, the merged one goes; its neighbours are looked up anew
        stays = np.ones(rank.shape, bool)
        stays[row, at] = False
        rank, merged = rank[stays].reshape(len(row), width - 2), merged[stays].reshape(len(row), width - 2)
        for pair in (at - 1, at):
            ok = (pair >= 0) & (pair < width - 2)
            r, p = row[ok], pair[ok]
            rank[r, p], merged[r, p] = table.ranks(matrix[r, p], matrix[r, p + 1])


def _merge_long(ids: list[int], table: MergeTable) -> list[int]:
    """The same merges on one long piece, by a heap of pairs over a linked list."""
    n = len(ids)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    rank, merged = (x.tolist() for x in table.ranks(np.array(ids[:-1]), np.array(ids[1:])))
    heap = [(r, i, ids[i], ids[i + 1], m) for i, (r, m) in enumerate(zip(rank, merged)) if r != _NONE]
    heapq.heapify(heap)
    seen: dict[tuple[int, int], tuple[int, int]] = {}

    def push(i: int, j: int) -> None:
        pair = ids[i], ids[j]
        if pair not in seen:
            r, m = table.ranks(np.array(pair[:1]), np.array(pair[1:]))
            seen[pair] = int(r[0]), int(m[0])
        r, m = seen[pair]
        if r != _NONE:
            heapq.heappush(heap, (r, i, *pair, m))

    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = nxt[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = m, -1
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
            push(i, nxt[i])
        if prv[i] >= 0:
            push(prv[i], i)
    return [x for x in ids if x >= 0]


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t) if t else 0
        if chars >= SLICE_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encoded(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/byte_bpe_50k.json", counts_only: bool = False) -> DataFrame:
    """key, ids (array<int>) of every row of df, or key, tokens (long) with counts_only.

    path names a byte-level BPE file with an ordinary merge list. No special tokens are added,
    and their strings in a text are ordinary text. Null and empty texts have an empty list (0
    tokens). Repeated keys stay repeated; an empty table gives no rows; a null key stays null.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(path))  # about 1 MB, of fixed size
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                n, ids = encoder.encode(texts[a:b])
                if counts_only:
                    out = pa.array(n, pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), out], names=["key", "out"])

    schema = f"key {kind}, out {'long' if counts_only else 'array<int>'}"
    return df.select(key, text).mapInArrow(run, schema).toDF(key, "tokens" if counts_only else "ids")
