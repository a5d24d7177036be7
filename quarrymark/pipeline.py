"""All phases over a folder of tables, with a ledger: inventory, quality, sensitive data, relationships, soft keys, clusters, reports.

    python -m quarrymark.pipeline FOLDER RESULTS [--phases inventory,quality]

Each phase writes its result below RESULTS/<phase> and then a line to the ledger; a run that is
started again goes on after the phases that are done. Results are small: columns, edges, findings.
"""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymark.operators import candidates, discovery, graph, inventory, profile, sensitive_scan, soft_keys, views
from quarrymark.operators.inclusion import Side
from quarrymark.sources import exports, shared
from quarrymark.sources.tables import names, table

PHASES = ("inventory", "quality", "pii", "facts", "shared", "candidates", "relationships", "composite", "polymorphic", "json", "pii_spread", "edges", "archetypes", "clusters")


@dataclass(frozen=True)
class Config:
    """What a run may be told; all else follows the tables."""

    schema: str = "tables"
    tables: tuple[str, ...] = ()  # only these, all if empty
    declared_keys: tuple[tuple[str, str], ...] = ()
    strict_checks: bool = False
    keep_rate: float = sensitive_scan.KEEP_RATE
    pii_gate_score: float = 0.7
    per_child: int = 10
    most_candidates: int | None = None
    containment: float = 0.95
    refine_cardinality: bool = False
    refine_floor: float = 0.85
    json_columns: tuple[tuple[str, str], ...] = ()
    phases: tuple[str, ...] = field(default=PHASES)

    @classmethod
    def read(cls, text: str) -> Config:
        """From JSON; unknown names are refused."""
        values = json.loads(text)
        if unknown := set(values) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        pairs = lambda v: tuple(tuple(x) if isinstance(x, list) else x for x in v)
        return cls(**{k: pairs(v) if isinstance(v, list) else v for k, v in values.items()})


class Run:
    """One run: its tables, its results and its ledger."""

    def __init__(self, spark: SparkSession, folder: str, results: str, config: Config = Config()):
        self.spark, self.folder, self.results, self.config = spark, folder, results.rstrip("/"), config
        wanted = [t for t in names(spark, folder) if not config.tables or t in config.tables]
        self.tables: dict[str, DataFrame] = {t: table(spark, folder, t) for t in wanted}
        left_out = {r["table_name"] for r in inventory.of_tables(spark, self.tables).where("status = 'excluded'").select("table_name").distinct().collect()} if wanted else set()  # a list of tables
        self.live = {t: df for t, df in self.tables.items() if t not in left_out}

    def ledger(self) -> dict[str, dict]:
        """phase -> its last entry: status, seconds, rows, settings."""
        out: dict[str, dict] = {}
        for name in shared.listed(self.spark, f"{self.results}/ledger"):
            if not name.startswith(".") and not name.endswith(".part"):
                entry = json.loads(shared.read_text(self.spark, f"{self.results}/ledger/{name}"))
                if entry["at"] >= out.get(entry["phase"], {"at": 0})["at"]:
                    out[entry["phase"]] = entry
        return out

    def result(self, phase: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.results}/{phase}")

    def go(self) -> dict[str, dict]:
        """Runs the phases that aren't done with these settings; returns the ledger. A failing phase is written down and ends the run."""
        settings = json.dumps(asdict(self.config), sort_keys=True)
        redo = False
        for phase in [p for p in PHASES if p in self.config.phases]:
            last = self.ledger().get(phase)
            if not redo and last and last["status"] == "done" and last["settings"] == settings:
                continue
            redo, start, status, rows = True, time.time(), "done", 0
            try:
                getattr(self, f"_{phase}")().write.mode("overwrite").option("compression", "zstd").parquet(f"{self.results}/{phase}")
                rows = self.result(phase).count()
            except Exception as e:
                status = f"failed: {type(e).__name__}"
                raise
            finally:
                entry = {"phase": phase, "status": status, "at": time.time(), "seconds": round(time.time() - start, 3), "rows": rows, "settings": settings}
                shared.write_text(self.spark, f"{self.results}/ledger/{phase}-{time.time_ns()}", json.dumps(entry))
        return self.ledger()

    # ---- phases ------------------------------------------------------------

    def _inventory(self) -> DataFrame:
        return inventory.of_tables(self.spark, self.tables, list(self.config.declared_keys))

    def _quality(self) -> DataFrame:
        metrics = profile.union_all([profile.fingerprints(df, t) for t, df in self.live.items()])
        pk = F.concat_ws(".", "table_name", "column_name").isin([f"{t}.{c}" for t, c in self.config.declared_keys]) if self.config.declared_keys else F.lit(False)
        return views.quality_view(profile.quality_findings(metrics.withColumn("is_pk", pk)))

    def _pii(self) -> DataFrame:
        texts = {t: (df, [c for c, kind in df.dtypes if kind == "string"]) for t, df in self.live.items()}
        texts = {t: x for t, x in texts.items() if x[1]}
        if not texts:
            return self.spark.createDataFrame([], "table_name string, column_name string, pii_type string, detector string, match_rate double, score double, validated boolean, name_prior boolean, example string, regulations string")
        found = sensitive_scan.findings(sensitive_scan.match_counts(texts, self.config.strict_checks), self.config.keep_rate)
        return views.with_regulations(found, sensitive_scan.regulations(self.spark))

    def _measured(self) -> tuple[DataFrame, DataFrame]:
        if not hasattr(self, "_both"):
            self._both = discovery.measured(self.spark, self.live, list(self.config.declared_keys))
        return self._both

    def _facts(self) -> DataFrame:
        found = self.result("pii").select("table_name", "column_name", "validated", "score") if "pii" in self.config.phases else self.spark.createDataFrame([], "table_name string, column_name string, validated boolean, score double")
        return discovery.pii_gate(self._measured()[0], found, self.config.pii_gate_score)

    def _shared(self) -> DataFrame:
        return self._measured()[1]

    def _candidates(self) -> DataFrame:
        return candidates.discovered(self.result("facts").drop("is_pii"), self.result("shared"), self.config.per_child, self.config.most_candidates).drop("g")

    def _relationships(self) -> DataFrame:
        out = candidates.inherited(candidates.validated(self.result("candidates"), self.result("shared"), self.config.containment), self.result("facts"))
        named = out.select("*", F.col("child_table_name").alias("child_table"), F.col("child_column_name").alias("child_column"), F.col("parent_table_name").alias("parent_table"), F.col("parent_column_name").alias("parent_column")).drop("child_table_name", "child_column_name", "parent_table_name", "parent_column_name")
        if not self.config.refine_cardinality:
            return named
        pairs = [(r[0], r[1]) for r in named.select("child_table", "child_column").distinct().collect()]  # edges
        if not pairs:
            return named
        counts = discovery.probed(self.live, pairs).withColumnsRenamed({"table_name": "child_table", "column_name": "child_column"})
        return discovery.refined_cardinality(named, counts, self.config.refine_floor).drop("cardinality").withColumnRenamed("refined", "cardinality")

    def _composite(self) -> DataFrame:
        ids = self.result("facts").select("column_id", "table_name", "column_name", "distinct_count", "is_pii").where("not is_pii")
        of = lambda s: ids.select(F.col("column_id").alias(f"{s}_id"), F.col("table_name").alias(f"{s}_table"), F.col("column_name").alias(f"{s}_column"), F.col("distinct_count").alias(f"{s}_n"))
        singles = self.result("shared").join(of("child"), "child_id").join(of("parent"), "parent_id").withColumn("containment", F.col("shared") / F.col("child_n"))
        return soft_keys.composite_keys(self.spark, self.live, soft_keys.composite_proposals(singles), self.config.containment)

    def _parents(self) -> list[Side]:
        keys = self.result("facts").where("(is_pk or is_unique or is_implicit_pk) and type_class like 'INT%'").select("table_name", "column_name").collect()  # keys of tables
        return [Side(f"{t}.{c}", self.live[t].select(c), c) for t, c in sorted(map(tuple, keys))]

    def _polymorphic(self) -> DataFrame:
        return soft_keys.discovered_polymorphic(self.live, self.result("facts"), self._parents(), self.config.containment)

    def _json(self) -> DataFrame:
        out = None
        for t, c in self.config.json_columns:
            one = soft_keys.json_keys(t, self.live[t].select(c), c, {"int": self._parents()}, self.config.containment).select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "*")
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], "table_name string, column_name string, path string, parent string, containment double, confidence double") if out is None else out

    def _pii_spread(self) -> DataFrame:
        return sensitive_scan.propagated(self.result("pii"), self.result("relationships"))

    def _edges(self) -> DataFrame:
        return graph.table_edges(self.result("relationships"), self.result("pii").select("table_name", "pii_type"))

    def _sizes(self) -> DataFrame:
        return profile.union_all([df.agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t, df in self.live.items()])

    def _archetypes(self) -> DataFrame:
        keys = self.result("facts").select("table_name", "column_name", (F.col("is_pk") | F.col("is_implicit_pk")).alias("is_key"))
        columns = views.foreign_columns(self.result("inventory").select("table_name", "column_name"), self.result("relationships"))
        return graph.archetypes(self._sizes(), columns.join(keys, ["table_name", "column_name"], "left").fillna(False, ["is_key"]), self.result("edges"))

    def _clusters(self) -> DataFrame:
        return graph.clusters(self._sizes(), self.result("edges"), self.result("archetypes"), self.config.schema)

    def reports(self) -> None:
        """CSV of relationships, advisory candidates, findings and tables left out, and summary.md."""
        primary = F.col("tier") == candidates.PRIMARY
        pairs = ["child_table_name", "child_column_name", "parent_table_name", "parent_column_name"]
        for name, df, order in (
            ("relationships", self.result("relationships"), ["child_table", "child_column", "parent_table", "parent_column"]), ("advisory", self.result("candidates").where(~primary).select(*pairs, "confidence", "note"), pairs),
            ("pii", self.result("pii"), ["table_name", "column_name", "pii_type"]), ("excluded", self.result("inventory").where("status = 'excluded'").select("table_name", "exclusion_reason").distinct(), ["table_name"]),
        ):
            exports.csv_report(df, f"{self.results}/reports/{name}", order)
        counts = {p: e["rows"] for p, e in self.ledger().items()}
        figures = {f"seconds of {p}": e["seconds"] for p, e in self.ledger().items()}
        shared.removed(self.spark, f"{self.results}/reports/summary.md")
        shared.write_text(self.spark, f"{self.results}/reports/summary.md", exports.summary_report(counts, figures))


def discover(spark: SparkSession, folder: str, results: str, config: Config = Config()) -> Run:
    """Runs all phases over the tables of a folder and writes the reports."""
    run = Run(spark, folder, results, config)
    run.go()
    if set(config.phases) == set(PHASES):
        run.reports()
    return run


def main() -> None:
    args = argparse.ArgumentParser(description="Discovers keys, sensitive data, quality and structure of a folder of Parquet tables.")
    args.add_argument("folder")
    args.add_argument("results")
    args.add_argument("--config", help="a JSON file of settings")
    args.add_argument("--phases", help="only these, with commas between")
    given = args.parse_args()
    spark = SparkSession.builder.appName("quarrymark").getOrCreate()
    config = Config.read(shared.read_text(spark, given.config)) if given.config else Config()
    if given.phases:
        config = Config(**{**{k: getattr(config, k) for k in Config.__dataclass_fields__}, "phases": tuple(given.phases.split(","))})
    for phase, entry in discover(spark, given.folder, given.results, config).ledger().items():
        print(phase, entry["status"], entry["rows"], entry["seconds"])


if __name__ == "__main__":
    main()
