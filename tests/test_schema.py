import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymark.functions import sensitive
from quarrymark.operators import graph, metadata_match, sensitive_scan, views
from quarrymark.sources import exports


def test_checks():
    ok = {"luhn": "4111 1111 1111 1111", "iban": "GB82 WEST 1234 5698 7654 32", "nhs_gb": "943 476 5919", "cpf_br": "529.982.247-25", "dni_es": "12345678Z", "pesel_pl": "44051401359", "bsn_nl": "111222333", "aba_us": "021000021", "npi_us": "1234567893", "nric_sg": "S1234567D", "codice_it": "RSSMRA85T10A562S", "idnr_de": "86095742719"}
    for name, value in ok.items():
        assert sensitive.CHECKS[name](value), name
        changed = value[:-1] + ("1" if value[-1] != "1" else "2") if value[-1].isdigit() else value[:-1] + ("A" if value[-1] != "A" else "B")
        assert not sensitive.CHECKS[name](changed), name
    assert not sensitive.luhn("4111") and not sensitive.entropy("a" * 40) and sensitive.date("31/12/1999")


def test_scan_resolves_overlaps():
    assert [(m.kind, m.value) for m in sensitive.scan("write to a.b@c.org") if m.kind == "EMAIL"] == [("EMAIL", "a.b@c.org")]
    assert "SSN_US" in [m.kind for m in sensitive.scan("ssn 123-45-6789")] and "SSN_US" not in [m.kind for m in sensitive.scan("ssn 000-45-6789")]
    assert sensitive.scan("") == []


@pytest.mark.parametrize(("value", "kind", "want"), [("john@acme.com", "EMAIL", "j***@a***.com"), ("jo@acme.com", "EMAIL", "***@***.com"), ("123-45-6789", "SSN_US", "***6789"), ("555 12", "PHONE_US", "***5512"), ("1999-01-02", "DOB", "1999-**-**"), ("x", "API_KEY", "***"), ("", "ORG", "***"), ("x@y", "EMAIL", "***@***"), ("nothing", "EMAIL", "***"), ("a.b@mail.acme.co.uk", "EMAIL", "a***@m***.uk"), ("12.5, 7.1", "GEO_COORD", "lat***,lon***"), ("+49 30", "PHONE_E164", "***4930"), ("1.1.99", "DOB", "****-**-**"), ("Ann", "PERSON_NAME", "A***")])
def test_masks(value, kind, want):
    assert sensitive.masked(value, kind) == want


def test_priors(spark):
    for column, want in (("email", ("EMAIL", 0.85)), ("employee_ssn", ("SSN_US", 0.5)), ("card_holder_name", ("CARD_HOLDER_NAME", 0.5)), ("amount", (None, 0.0))):
        kind, strength = sensitive_scan.prior_columns(F.lit(column))
        assert tuple(spark.range(1).select(kind, strength).first()) == want


def test_findings(spark):
    t = spark.createDataFrame([("a@b.org", "c@d.org", "plain")] * 10 + [(None, "", None)], "email string, notes string, phone string")
    cells = {"t": (t, ["email", "notes", "phone"])}
    got = {(r["column_name"], r["pii_type"]): (r["detector"], r["score"]) for r in sensitive_scan.findings(sensitive_scan.match_counts(cells)).collect()}
    assert got == {("email", "EMAIL"): ("regex", 1.0), ("notes", "EMAIL"): ("regex", 0.4), ("phone", "PHONE"): ("name_prior", 0.85)}
    assert sensitive_scan.findings(sensitive_scan.match_counts({"t": (t.limit(0), ["email"])})).count() == 0


def test_propagation_with_cycle(spark):
    found = spark.createDataFrame([("people", "EMAIL", 0.9), ("notes", "ICD10", 0.9)], "table_name string, pii_type string, score double")
    edges = spark.createDataFrame([("orders", "people", 0.9), ("items", "orders", 0.9), ("people", "items", 0.9), ("far", "items", 0.1)], "child_table string, parent_table string, confidence double")
    assert {tuple(r) for r in sensitive_scan.propagated(found, edges).collect()} == {("people", "EMAIL", 0), ("orders", "EMAIL", 1), ("items", "EMAIL", 2)}


def test_louvain_finds_two_cliques():
    clique = lambda ns: [(a, b, 1.0) for i, a in enumerate(ns) for b in ns[i + 1 :]]
    found = graph.louvain(clique("abcd") + clique("wxyz") + [("a", "w", 0.1)], list("abcdwxyz") + ["lone"])
    assert len({found[n] for n in "abcd"}) == len({found[n] for n in "wxyz"}) == 1 and len(set(found.values())) == 3
    assert graph.louvain([], []) == {}


def test_clusters_and_junction(spark):
    tables = spark.createDataFrame([("films", 1000), ("actors", 200), ("film_actor", 5000), ("void", 0)], "table_name string, row_count long")
    edges = spark.createDataFrame([("films", "film_actor", 1.0, "MANY_TO_ONE"), ("actors", "film_actor", 0.9, "MANY_TO_ONE")], "parent string, child string, weight double, cardinality string")
    columns = spark.createDataFrame([("film_actor", "film_id", True, True), ("film_actor", "actor_id", True, True), ("films", "id", True, False), ("actors", "id", True, False)], "table_name string, column_name string, is_key boolean, is_fk boolean")
    kinds = graph.archetypes(tables, columns, edges)
    assert {r[0]: r[1] for r in kinds.collect()}["film_actor"] == "JUNCTION"
    assert [tuple(r) for r in graph.collapsed(edges, kinds.where("archetype = 'JUNCTION'")).collect()] == [("actors", "films", 0.9, "MANY_TO_MANY")]
    got = {r["table_name"]: (r["cluster_id"], r["cluster_name"]) for r in graph.clusters(tables, edges, kinds, "s").collect()}
    assert got["films"] == got["film_actor"] == got["actors"] and got["void"][1] == "s_empty_tables"


def test_views(spark):
    key = "child_table string, child_column string, parent_table string, parent_column string"
    found, gold = spark.createDataFrame([("A", "b", "c", "d"), ("x", "b", "c", "d")], key), spark.createDataFrame([("a", "b", "c", "d")], key)
    assert tuple(views.recall_precision(found, gold).first()) == (1, 2, 1, 1.0, 0.5)
    assert tuple(views.recall_precision(found.limit(0), gold.limit(0)).first()) == (0, 0, 0, 0.0, 0.0)
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, views.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_entity_types(spark):
    tables = spark.createDataFrame([("app_config", 3), ("order_item", 9), ("color", 2), ("thing", 20)], "table_name string, n_cols long")
    edges = spark.createDataFrame([("thing", "color"), ("order_item", "thing")], "child string, parent string")
    assert {r[0]: r[1] for r in metadata_match.entity_type(tables, edges).collect()} == {"app_config": "Config", "order_item": "Transaction (Item)", "color": "Master Lookup", "thing": "Standard Entity"}


@pytest.mark.parametrize(("query", "ok"), [("SELECT a, b FROM t WHERE c = 'join; x'", True), ("select a from t;", True), ("SELECT count(*) FROM t", False), ("SELECT a FROM t JOIN u ON 1=1", False), ("SELECT a FROM t, u", False), ("SELECT a FROM (SELECT 1)", False), ("DELETE FROM t", False), ("SELECT 1; DROP TABLE t", False), ("WITH x AS (SELECT 1) SELECT * FROM x", False)])
def test_whitelist(query, ok):
    assert (exports.whitelisted(query) is None) == ok


def test_exports(spark, tmp_path):
    rel = spark.createDataFrame([("orders", "customer_id", "customers", "id", "MANY_TO_ONE", 0.9)], "child_table string, child_column string, parent_table string, parent_column string, cardinality string, confidence double")
    cols = spark.createDataFrame([("customers", 1, "id", "bigint", True), ("orders", 1, "customer_id", "bigint", False)], "table_name string, ordinal int, column_name string, data_type string, is_pk boolean")
    assert "Ref: orders.customer_id > customers.id" in exports.to_dbml(cols, rel) and "orders }o--|| customers : customer_id" in exports.to_mermaid(rel) and '"parent_column": "id"' in exports.to_json(rel)
    exports.csv_report(rel, str(tmp_path / "r"), ["child_table"])
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 1
    with pytest.raises(ValueError):
        exports.extracted(rel, str(tmp_path / "x"), percent=0)
    (tmp_path / "a.parquet").write_text("x")
    assert exports.removed(["a.parquet", "../etc", "none"], str(tmp_path), dry_run=False) == [str(tmp_path / "a.parquet")] and not (tmp_path / "a.parquet").exists()


def test_pii_findings_of_every_table(spark):
    from quarrymark.plans import schema_queries

    found = {(r["table_name"], r["column_name"], r["pii_type"]) for r in schema_queries.pii_findings(spark, "/root/testdata/sf0.001").collect()}
    assert {("articles", "body", "EMAIL"), ("employees", "work_email", "EMAIL")} <= found, sorted(x for x in found if x[2] == "EMAIL" or x[0] in ("articles", "documents"))
    assert ("documents", "text") in {x[:2] for x in found}


def test_findings_scan_each_cell_once(spark):
    scans = spark.sparkContext.accumulator(0)

    def seen(value):
        scans.add(1)
        return value

    t = spark.createDataFrame([(f"a{i}@b.org",) for i in range(50)], "email string").select(F.udf(seen, "string")("email").alias("email"))
    assert [tuple(r)[:3] for r in sensitive_scan.findings(sensitive_scan.match_counts({"t": (t, ["email"])})).collect()] == [("t", "email", "EMAIL")]
    assert scans.value == 50
    strict = views.with_regulations(sensitive_scan.findings(sensitive_scan.match_counts({"t": (t, ["email"])}, strict=True)), sensitive_scan.regulations(spark))
    assert [tuple(r) for r in strict.select("table_name", "column_name", "pii_type").collect()] == [("t", "email", "EMAIL")]
    assert scans.value == 100


ODD = ("4111 1111 1111 1111 ", "a@b.org", " ", "\n", "\0", "é", "John Smith", "Mary-Ann O'Neil", "XJ766207305432163925", "DE89370400440532013000", "+1 (555) 123 4567", "123-45-6789", "1999-01-02", "fe80::1:2", "aa-bb-cc-dd-ee-ff", "12.5,  -7.25", "SW1A 1AA", "-----BEGIN A B PRIVATE KEY-----", "xeyJa.b-c.d", "A12.3", "DEUTDEFF", "word", "F", "Foo", "0x" + "a" * 40, "9" * 9, "123 456 7890", "123456-7890", "192.168.1.1", "ghp_" + "a" * 36, ",", "-", "_")


@pytest.mark.parametrize(("strict", "at_once"), [(False, 1000), (True, 1000), (False, 1 << 20)])
def test_cells_at_once_are_scanned_as_one_by_one(strict, at_once, monkeypatch):
    monkeypatch.setattr(sensitive, "AT_ONCE", at_once)
    pick = random.Random(7)
    texts = ["", *ODD, *(pick.choice(("", " ")).join(pick.choices(ODD, k=pick.randint(2, 20))) for _ in range(1500))]
    got = [set() for _ in texts]
    for cell, kind, valid, value in sensitive.first_matches([x.encode() for x in texts], strict):
        for i, k, ok, v in zip(cell.tolist(), kind.tolist(), valid.tolist(), value):
            got[i].add((sensitive.KINDS[k], ok, v))
    for text, found in zip(texts, got):
        first = {}
        for m in sensitive.scan(text, strict):
            first.setdefault(m.kind, m)
        assert found == {(m.kind, m.valid, m.value) for m in first.values()}, text
    assert list(sensitive.first_matches([])) == []


def test_kinds_scanned_in_words_with_digits_need_one():
    no_digit = np.ones(256, bool)
    no_digit[48:58] = False
    assert [k for k in sensitive.KINDS if k not in sensitive._WORDS and sensitive._can_match(list(re._parser.parse(sensitive.BY_NAME[k].regex)), no_digit)] == []


def test_telling_parts_have_the_mask_of_the_whole():
    for kind in sensitive.KINDS:
        for v in (*ODD, "ab", "555 12", "12-34", "né12", "１２３４"):
            assert sensitive.masked(sensitive.telling_part(v, kind), kind) == sensitive.masked(v, kind), (kind, v)
