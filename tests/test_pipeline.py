import pytest
from pyspark.sql import functions as F

from quarrymark import pipeline
from quarrymark.operators import inventory
from quarrymark.sources import exports, shared


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.range(1000, 1300).select("id", F.concat(F.lit("u"), "id", F.lit("@post.org")).alias("email"), F.lit(None).cast("string").alias("gone")).write.parquet(f"{at}/users.parquet")
    spark.range(5000, 5600).select("id", (F.col("id") % 280 + 1000).alias("user_id"), F.lit("open").alias("status"), F.when(F.col("id") % 2 == 0, "users").otherwise("orders").alias("owner_type"), F.when(F.col("id") % 2 == 0, F.col("id") % 200 + 1000).otherwise(F.col("id")).alias("owner_id")).write.parquet(f"{at}/orders.parquet")
    spark.range(3).write.parquet(f"{at}/audit_log.parquet")
    return str(at)


def test_all_phases_and_the_ledger(spark, folder, tmp_path):
    config = pipeline.Config(declared_keys=(("users", "id"), ("orders", "id")))
    run = pipeline.discover(spark, folder, f"{tmp_path}/out", config)
    rel = {(r["child_table"], r["child_column"], r["parent_table"], r["cardinality"]) for r in run.result("relationships").collect()}
    assert ("orders", "user_id", "users", "MANY_TO_ONE") in rel
    assert {(r["table_name"], r["pii_type"], r["example"]) for r in run.result("pii").collect()} >= {("users", "EMAIL", "u***@p***.org")}
    assert "ALL_NULL" in {r["finding"] for r in run.result("quality").collect()}
    assert {(r["kind"], r["parent"]) for r in run.result("polymorphic").collect()} == {("users", "users.id"), ("orders", "orders.id")}
    assert run.result("inventory").where("table_name = 'audit_log' and exclusion_reason = 'log_pattern'").count() == 1
    assert {r["table_name"] for r in run.result("clusters").collect()} == {"users", "orders"}
    ledger = run.ledger()
    assert set(ledger) == set(pipeline.PHASES) and all(e["status"] == "done" for e in ledger.values())
    assert pipeline.Run(spark, folder, f"{tmp_path}/out", config).go() == ledger  # nothing is run again
    assert "# Run summary" in shared.read_text(spark, f"{tmp_path}/out/reports/summary.md")
    assert pipeline.Config.read('{"per_child": 3, "declared_keys": [["a", "b"]]}').declared_keys == (("a", "b"),)
    with pytest.raises(ValueError):
        pipeline.Config.read('{"colour": 1}')


def test_extraction(spark, tmp_path):
    spark.range(10).select("id", F.lit("x").alias("note"), F.lit(1.5).alias("price")).createOrReplaceTempView("things")

    def read(query):
        if query == "SELECT price FROM things" or query.startswith("SELECT id, note, price "):
            raise ValueError("a type nobody knows")
        return spark.sql(query.replace("varchar(4000)", "string"))

    columns = {"things": [("id", True, True, False), ("note", False, False, True), ("price", False, False, False)]}
    assert exports.extract_schema(read, columns, str(tmp_path / "a"))[0]["columns"] == ["id", "note"]
    whole = exports.extract_schema(read, columns, str(tmp_path / "b"), project=False)
    assert whole[0]["demoted"] == ["price"] and whole[0]["rows"] == 10 and '"sha256"' in shared.read_text(spark, whole[0]["path"] + ".manifest")
    assert exports.extract_schema(read, columns, str(tmp_path / "c"), only=["other"]) == []
    assert exports.csv_tables({"t": spark.range(2)}, str(tmp_path / "csv")) and spark.read.option("header", True).csv(str(tmp_path / "csv/t")).count() == 2


def test_probe_and_names(spark):
    def run(query):
        return spark.sql("SELECT 'v1' AS v" if "version" in query else "SELECT 3 AS n")

    assert inventory.connection_probe(run, "postgresql", "app") == {"ok": True, "version": "v1", "schema_exists": True, "tables": 3}
    assert not inventory.connection_probe(run, "postgresql", "app; drop")["ok"] and not inventory.connection_probe(lambda q: 1 / 0, "oracle", "app")["ok"]
    assert set(inventory.catalog_of(run, "app")) == set(inventory.CATALOG)
    assert [inventory.name_cardinality(*x) for x in (("id", "id"), ("user_id", "id"), ("x", "y_id"), ("a", "b"))] == ["1:1", "N:1", "1:N", "M:N"]
