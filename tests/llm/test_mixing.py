import random

import numpy as np

from quarrymark.llm import bpe, mixing, topics

PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"


def test_marginals_are_met():
    r = np.random.default_rng(0)
    size = r.integers(50, 500, 24).astype(float)
    source, lang, topic = np.repeat([0, 1, 2], 8), np.tile([0, 1], 12), np.tile([0, 0, 1, 1], 6)
    uses = mixing.fit_cells(size, source, [lang, topic], np.array([0.5, 0.3, 0.2, 0.1]), np.array([9.0, 9, 9, 9]), total=size.sum())
    x = uses * size
    assert np.allclose(np.bincount(source, weights=x) / x.sum(), [0.5, 0.3, 0.2])
    assert np.allclose(np.bincount(lang, weights=x) / x.sum(), np.bincount(lang, weights=size) / size.sum(), atol=0.01)


def test_caps_hold_and_the_largest_total_is_used():
    uses = mixing.fit_cells(np.array([900.0, 100.0]), np.array([0, 1]), [], np.array([0.5, 0.5]), np.array([1.0, 3.0]))
    assert np.allclose(uses, [300 / 900, 3.0])
    assert mixing.fit_cells(np.array([5.0]), np.array([0]), [], np.array([0.0]), np.array([1.0])).tolist() == [0.0]


def test_documents(spark):
    rows = [(i, ["a", "a", "b", None, "other"][i % 5], [None, "en", "de"][i % 3], None, i % 90) for i in range(3000)]
    docs = spark.createDataFrame(rows, "key long, source string, lang string, topic string, tokens long")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 3), ("missing", 0.2, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(docs, targets)
    out = {r["source"]: r for r in mixing.reached(mixed, targets.where("source is not null")).collect()}
    assert mixed.where("source is null or source = 'other'").count() == 0 and mixed.count() == 1800
    assert out["a"]["reached"] and out["b"]["reached"] and out["missing"]["reached"] and out["a"]["fitted_share"] == 0.5
    rows = mixing.marginals(mixed, targets.where("source is not null")).collect()
    for m in ("source", "language", "topic"):
        assert abs(sum(r["actual_share"] for r in rows if r["marginal"] == m) - 1) < 1e-9 and all(abs(r["error"]) < 0.01 for r in rows if r["marginal"] == m)
    assert abs(out["a"]["actual_share"] - 0.5) < 0.005 and out["a"]["most_copies"] <= 1 and out["b"]["most_copies"] <= 3 and out["missing"]["used_tokens"] == 0
    assert mixed.where("tokens = 0 and copies > 0").count() == 0
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mixture(docs.repartition(7), targets).collect()))


def test_empty(spark):
    docs = spark.createDataFrame([], "key long, source string, lang string, topic string, tokens long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mixture(docs, targets).count() == 0 and mixing.mixture(docs, targets.limit(0)).count() == 0
    assert mixing.reached(mixing.mixture(docs, targets), targets).first()["actual_share"] == 0


def test_topics_of_all_documents(spark):
    r = random.Random(4)
    field = {"law": "court appeal statute clause".split(), "sport": "league penalty sprint coach".split(), "software": "compiler cache branch merge".split()}
    plain = {"en": "the and with from".split(), "de": "der und mit von".split()}
    rows, truth = [], {}
    for i in range(240):
        truth[i], lang = r.choice(sorted(field)), "en" if i % 3 else "de"
        rows.append((i, lang, " ".join(r.choices(field[truth[i]], k=6) + r.choices(plain[lang], k=20)), truth[i]))
    labelled = spark.createDataFrame([x for x in rows if x[0] % 6 == 0] + [(900, None, "court", "law"), (901, "en", None, "law"), (902, "en", "x", None)], "key long, lang string, text string, subject string")
    names, weights = topics.token_weights(labelled, PATH)
    docs = spark.createDataFrame([(i, t) for i, _, t, _ in rows] + [(900, None), (901, "")], "key long, text string")
    got = {x["key"]: (x["tokens"], x["topic"]) for x in topics.sized(docs, "key", "text", names, weights, PATH).collect()}
    assert got[900] == got[901] == (0, None) and sum(got[i][1] == truth[i] for i in truth) > 0.97 * len(truth)
    names, weights = topics.token_weights(labelled.limit(0), PATH)
    assert names == [] and topics.sized(docs, "key", "text", names, weights, PATH).where("topic is not null").count() == 0
