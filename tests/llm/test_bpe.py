import os
import random

import numpy as np
import pytest

from quarrymark.llm import bpe

PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")
TEXTS = [
    "", None, "a", "Hello world, don't we'll!", " \n\t  x", "ab1²½ ٣ \x1c\x85x　 ​ é ñ 你好 🙂👍🏽", "<|endoftext|>hi", "a" * 5000, " " * 3000, "abc" * 300 + "-" * 700,
    "".join(map(chr, range(0x3000))), " ".join(chr(c) for c in range(0x3000, 0x11000) if not 0xD800 <= c < 0xE000), "\\begin{equation} x_1^2 \\end{equation}\r\n" * 9,
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def encode(texts, **settings):
    n, ids = bpe.Encoder(bpe.Vocabulary(PATH)).encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_same_as_library(reference):
    r = random.Random(4)
    noise = ["".join(r.choice("ab cd'stéñ漢🙂\n1²-_. ") for _ in range(r.randrange(400))) for _ in range(200)]
    for text, got in zip(TEXTS + noise, encode(TEXTS + noise)):
        assert got == reference(text), repr(text)[:80]


def test_long_pieces_and_small_buckets(reference, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_PIECE", 6)
    monkeypatch.setattr(bpe, "MAX_CELLS", 40)
    texts = ["internationalization of aaaaaaaaaaaaaaaa misunderstandings", "x" * 50]
    assert encode(texts) == [reference(t) for t in texts]


def test_forgetting(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_KNOWN", 2)
    e = bpe.Encoder(bpe.Vocabulary(PATH))
    for text in ("one two three", "four five six", "one two three"):
        assert e.encode([text])[1].tolist() == reference(text)


def test_rows(spark, reference, monkeypatch):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS[:9])] + [(0, "again", ""), (None, "x y", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((str(r["doc_id"]), r["ids"]) for r in bpe.encoded(df, "doc_id", "text").collect())
    assert got == sorted((str(i), reference(t)) for i, t, _ in rows)
    counts = {(r["doc_id"], r["tokens"]) for r in bpe.encoded(df, "doc_id", "text", counts_only=True).collect()}
    assert counts == {(i, len(reference(t))) for i, t, _ in rows}
    assert bpe.encoded(df.limit(0), "doc_id", "text").count() == 0
