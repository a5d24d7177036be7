import glob
import os
import re

import pytest

from quarrymark.llm import pii, pii_practice
from quarrymark.llm.pii_spans import Gazetteer, candidates, lookups

GAZ = Gazetteer(frozenset(("zelda", "ildoran")), frozenset(("osterby", "vellovic")), frozenset(("gant quay", "brenstadt")))
CASES = [
    ("Yesterday Zelda Osterby wrote to the board.", {("name", "Zelda Osterby")}), ("Dear OSTERBY, ZELDA,\n", {("name", "OSTERBY, ZELDA")}), ("They talked about the Osterby tunnel", set()), ("Editor: Z. Vellovic-Osterby.", {("name", "Z. Vellovic-Osterby")}),
    ("answer to <zelda (at) post (dot) net (dot) example> today", {("email", "zelda (at) post (dot) net (dot) example")}), ("zelda[at]post[dot]org", {("email", "zelda[at]post[dot]org")}), ("the info@ inbox, 3 pens @ 1.10", set()), ("zelda at post dot org", {("email", "zelda at post dot org")}),
    ("Our phone: +49 (0)30 23125-115, mornings", {("phone", "+49 (0)30 23125-115")}), ("Dial (988) 555-0137 now", {("phone", "(988) 555-0137")}), ("Voucher no. 968-24-0478 expired; pallet nr. 657-72-087.", set()), ("Docket 47-118-20 dates from 2024-03-18. It cost 8,474,050", set()),
    ("Social security number: 876385641", {("id_number", "876385641")}), ("her passport KB5417321 expired", {("id_number", "KB5417321")}), ("Steuernummer 66/812/56516.", {("id_number", "66/812/56516")}),
    ("We live at 134 tollgate way apt 14b, gant quay these days.", {("address", "134 tollgate way apt 14b, gant quay")}), ("Forward it to 17 Harrow Lane\nBrenstadt 51145, thanks.", {("address", "17 Harrow Lane\nBrenstadt 51145")}),
    ("Address: Flat 3, 12 Mill Brook Road, Gant Quay GA4 7ZX. Bring keys", {("address", "Flat 3, 12 Mill Brook Road, Gant Quay GA4 7ZX")}), ("Anschrift: Gerberzeile 12, 98165 Brenstadt.", {("address", "Gerberzeile 12, 98165 Brenstadt")}),
    ("Invoices go to P.O. Box 114, Brenstadt 82502", {("address", "P.O. Box 114, Brenstadt 82502")}), ("", set()), ("zelda.osterby@corvane.example | Zelda Osterby", {("email", "zelda.osterby@corvane.example"), ("name", "Zelda Osterby")}),
    ("Address: Calle Mayor 12, 28013 Madrid.", {("address", "Calle Mayor 12, 28013 Madrid")}), ("He lives at 12 rue de la Paix, 75002 Paris", {("address", "12 rue de la Paix, 75002 Paris")}),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_mentions(text, want):
    found = pii.decode(candidates(text, GAZ), pii.model())
    assert {(k, text[a:b]) for a, b, k, _ in found} == want


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Ms Priya Raghunathan will chair the panel.", "Priya Raghunathan"), ("We thank Dr. Tobias Wendelstein for the loan.", "Tobias Wendelstein"), ("That spring Bogdan Kowalski joined the board.", "Bogdan Kowalski"),
        ("Mr Ana Maria de la Cruz wrote it.", "Ana Maria de la Cruz"), ("priya.raghunathan@corvane.example | Priya Raghunathan", "Priya Raghunathan"), ("Supervisor: Tobias Wendelstein\n", "Tobias Wendelstein"), ("Dr. Zelda Wendelstein agreed.", "Zelda Wendelstein"),
    ],
)
def test_names_outside_the_gazetteer(text, name):
    for gaz in (GAZ, Gazetteer()):
        found = pii.decode(candidates(text, gaz), pii.model())
        assert ("name", name) in {(k, text[a:b]) for a, b, k, _ in found}


def test_headings_are_no_names():
    for text in ("Work History\nQuality Control\n", "Old Harbour Museum opens at nine.", "The Grand Canal was frozen.", "Skills: Data Modelling, Technical Writing"):
        assert not pii.decode(candidates(text, GAZ), pii.model())


def test_held_out_accuracy():
    n = pii.agreement(200)
    for kind in ("email", "phone", "id_number", "address", "name"):
        assert n["right", kind] / (n["right", kind] + n["missed", kind]) > 0.95 and n["right", kind] / (n["right", kind] + n["false", kind]) > 0.95


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_practice_shares_no_sentence_with_the_tables():
    import pyarrow.parquet as pq

    texts = []
    for path in glob.glob("/root/testdata/sf0.01/*.parquet"):
        held = [f.name for f in pq.read_schema(path) if str(f.type) in ("string", "large_string")]
        if held and os.path.basename(path) in ("candidates.parquet", "posts.parquet", "articles.parquet"):
            texts += [x for c in pq.read_table(path, columns=held).columns for x in c.to_pylist() if x]
    whole = "\n".join(set(texts)).lower()
    parts = {p.strip(" .,;:\n").lower() for s in (*pii_practice.PLAIN, *pii_practice.PLAIN_GERMAN, *(x for xs in pii_practice.AROUND.values() for x in xs)) for p in re.split(r"\{\w*\}", s)}
    shared = [p for p in parts if len(p.split()) >= 3 and p in whole]
    assert not shared


def test_a_gazetteer_too_great_for_a_broadcast_gives_the_same(spark):
    texts = spark.createDataFrame([(1, "zelda osterby called; we live at 134 tollgate way, gant quay"), (2, None), (3, ""), (4, "ildoran vellovic"), (4, "ildoran vellovic")], "id long, t string")
    gaz = spark.createDataFrame([("zelda", "given"), ("ildoran", "given"), ("osterby", "family"), ("vellovic", "family"), ("gant quay", "town")], "v string, kind string")
    few, many = (sorted((r["id"], r["masked"] or "", len(r["found"])) for r in pii.mentions(texts, "t", gaz, most=n).collect()) for n in (100, 2))
    assert few == many and (4, "[NAME]", 1) in few and (1, "[NAME] called; we live at [ADDRESS]", 2) in few


def test_lookups_hold_every_string_looked_up():
    assert {"zelda", "vellovic", "osterby", "port asper quay", "asper"} <= lookups("Zelda Vellovic-Osterby, Port Asper Quay")


def test_decoding_is_the_best_set():
    from itertools import combinations

    cands = [(0, 4, "a", ["w1"]), (2, 6, "b", ["w2"]), (5, 9, "a", ["w1"]), (4, 9, "b", ["w3"]), (0, 9, "c", ["w4"])]
    w = {"w1": 1.0, "w2": 2.5, "w3": 1.4, "w4": 2.0}
    def apart(s):
        return all(x[1] <= y[0] or y[1] <= x[0] for x, y in combinations(s, 2))
    best = max(sum(w[c[3][0]] for c in s) for n in range(4) for s in combinations(cands, n) if apart(s))
    got = pii.decode(cands, w)
    assert apart(got) and sum(w[c[3][0]] for c in got) == best
    assert abs(sum(pii._expected(cands[:1], [0.0])) - 0.5) < 1e-9


def test_rows_and_placeholders(spark):
    rows = [(1, "Mail a@b.org; call +1-621-555-0191", "x"), (2, None, "y"), (3, "", None), (1, "Mail a@b.org; call +1-621-555-0191", "x"), (4, "word " * 20000 + "a@b.org", "z")]
    out = pii.mentions(spark.createDataFrame(rows, "id long, text string, masked string"), "text", Gazetteer()).collect()
    by = {r["id"]: r for r in out}
    assert len(out) == 5 and by[1]["masked"] == "Mail [EMAIL]; call [PHONE]" and by[2]["masked"] is None and by[3]["masked"] == "" and by[4]["masked"].endswith("[EMAIL]")
    assert by[4]["found"][0]["start"] == 100000 and by[2]["found"] == []


def test_gazetteer_keeps_the_rare(spark):
    texts = spark.createDataFrame([("1 A Row, Newtown 12345",), ("1 A Row\nNewtown 12345 x",), ("2 B Row, Once 12345",), ("\nCall 07700 900",), (None,)], "t string")
    people = spark.createDataFrame([("Ann", "Lee"), ("ann ", "Lee"), ("Bob", None), ("X", "O Hara")], "f string, l string")
    g = {tuple(r) for r in pii.gazetteer(texts, "t", [(people, "f", "l")]).collect()}
    assert g == {("ann", "given"), ("bob", "given"), ("lee", "family"), ("hara", "family"), ("newtown", "town"), ("once", "town")}
    assert pii.gazetteer(texts.limit(0), "t", []).count() == 0


@pytest.mark.parametrize("address", ["Lindenweg 12, Brenstadt", "Lindenweg 12\nBrenstadt", "Lindenweg 12 10115 Brenstadt", "Lindenweg 12, Brenstadt 10115", f"{'Linden' * 12}weg 12, 10115 Brenstadt"])
def test_german_streets_without_a_postcode_before_the_town(address):
    found = pii.decode(candidates(f"Anschrift: {address}.", GAZ), pii.model())
    assert {(k, f"Anschrift: {address}."[a:b]) for a, b, k, _ in found} == {("address", address)}


def test_german_numbers_that_are_no_streets():
    for text in ("Im Winter 2020, als der Strom fehlte.", "Am Dienstag 3, danach nie.", "Auf Blatt 9, Spalte 2."):
        assert not pii.decode(candidates(text, GAZ), pii.model())
