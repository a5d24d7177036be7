"""Sinks and sources around results: graph exports, reports, extraction, query whitelist, clean-up."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrymark.sources import shared

#: Relation marks of the exports by cardinality.
DBML_MARKS = {"ONE_TO_ONE": "-", "MANY_TO_ONE": ">", "ONE_TO_MANY": "<", "MANY_TO_MANY": "<>"}
MERMAID_MARKS = {"ONE_TO_ONE": "||--||", "MANY_TO_ONE": "}o--||", "ONE_TO_MANY": "||--o{", "MANY_TO_MANY": "}o--o{"}
#: Words that a whitelisted query must not hold.
FORBIDDEN = ("with", "union", "intersect", "except", "distinct", "join", "group", "having", "window", "exists", "over", "insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "copy", "into")
AGGREGATES = ("count", "sum", "avg", "min", "max", "array_agg", "string_agg", "bool_or", "bool_and", "stddev", "variance")


def whitelisted(query: str) -> str | None:
    """None if a query is a plain SELECT from one table; else why not. Text in quotes doesn't count."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", re.sub(r"--[^\n]*|/\*.*?\*/", " ", query, flags=re.S))
    low = re.sub(r"\s+", " ", re.sub(r'"[^"]*"', "x", bare)).strip().lower()
    if ";" in low.rstrip("; "):
        return "several statements"
    if not low.startswith("select ") or low.count("select") != 1:
        return "not one plain SELECT"
    words = re.findall(r"[a-z_]+", low)
    for w in FORBIDDEN:
        if w in words:
            return f"holds {w.upper()}"
    if re.search(rf"\b({'|'.join(AGGREGATES)})\s*\(", low):
        return "holds an aggregate"
    source = re.search(r"\bfrom (.+?)(?: where | order | limit | offset | fetch |$)", low.rstrip("; "))
    if not source:
        return "no table"
    return "more than one table" if "," in source[1] or "(" in source[1] else None


def projection(columns: list[tuple[str, bool, bool, bool]]) -> list[str]:
    """Columns worth extracting of (name, is_pk, is_eligible, is_text): keys, key candidates and text; all if that keeps none or all."""
    kept = [n for n, pk, key, text in columns if pk or key or text]
    return kept if 0 < len(kept) < len(columns) else ["*"]


def extracted(df: DataFrame, path: str, columns: list[str] | None = None, percent: float | None = None, seed: int = 42, mode: str = "overwrite") -> None:
    """Writes a table (or a Bernoulli sample of percent in (0, 100]) as zstd Parquet."""
    if percent is not None and not 0 < percent <= 100:
        raise ValueError("percent must lie in (0, 100]")
    out = df if not columns or columns == ["*"] else df.select(*[f"`{c}`" for c in columns])
    (out if percent is None else out.sample(False, percent / 100, seed)).write.mode(mode).option("compression", "zstd").parquet(path)


def from_jdbc(spark: SparkSession, url: str, query_or_table: str, *, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table by JDBC, in ``parts`` ranges of a numeric column read at once; the driver's jar must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", query_or_table).options(**options)
    if column and parts > 1:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def extract_schema(read: Callable[[str], DataFrame], tables: dict[str, list[tuple[str, bool, bool, bool]]], folder: str, *, only: list[str] | None = None, percent: float | None = None, project: bool = True) -> list[dict]:
    """Writes tables of a source as Parquet below folder and returns their manifest, which is also written: table, columns, rows, path, demoted.

    read turns a query into a DataFrame (``from_jdbc``); tables: name -> (column, is_pk,
    is_eligible, is_text), by which ``projection`` leaves columns out. only: a subset of them. A
    column whose type can't be read is tried again as text, by itself, and listed as demoted.
    """
    manifest = []
    for name in sorted(tables) if only is None else [t for t in only if t in tables]:
        kept = projection(tables[name]) if project else ["*"]
        columns = [c for c, *_ in tables[name]] if kept == ["*"] else kept
        path, demoted = f"{folder.rstrip('/')}/{name}.parquet", []
        try:
            df = read(f"SELECT {', '.join(columns)} FROM {name}")
            extracted(df, path, percent=percent)
        except Exception:  # a type that the reader or the writer doesn't know
            parts = []
            for c in columns:
                try:
                    read(f"SELECT {c} FROM {name}").limit(1).collect()
                    parts.append(c)
                except Exception:
                    parts.append(f"CAST({c} AS varchar(4000)) AS {c}")
                    demoted.append(c)
            df = read(f"SELECT {', '.join(parts)} FROM {name}")
            extracted(df, path, percent=percent)
        spark = df.sparkSession
        manifest.append({"table": name, "columns": columns, "rows": spark.read.parquet(path).count(), "path": path, "demoted": demoted})
        digest = hashlib.sha256(json.dumps(manifest[-1], sort_keys=True).encode()).hexdigest()
        shared.removed(spark, f"{path}.manifest")
        shared.write_text(spark, f"{path}.manifest", json.dumps(manifest[-1] | {"sha256": digest}))
    return manifest


def csv_tables(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """One folder of CSV files with header and all fields quoted for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(f"{folder.rstrip('/')}/{name}")
    return [f"{folder.rstrip('/')}/{name}" for name in tables]


def csv_report(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with header, all fields quoted, in the order given; for reports of metadata size."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def summary_report(counts: dict[str, int], figures: dict[str, float]) -> str:
    """summary.md of a run."""
    return "\n".join(["# Run summary", "", "| what | count |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in counts.items()], "", *[f"- {k}: {v:.4f}" for k, v in figures.items()], ""])


def _edges(relationships: DataFrame) -> list:
    cols = ["child_table", "child_column", "parent_table", "parent_column", "cardinality", "confidence"]
    return relationships.select(*cols).orderBy(*cols[:4]).collect()  # metadata


def to_dbml(columns: DataFrame, relationships: DataFrame) -> str:
    """DBML of tables (table_name, column_name, data_type, is_pk) and relationships."""
    out: list[str] = []
    last = None
    for r in columns.orderBy("table_name", "ordinal").collect():
        if r["table_name"] != last:
            out += (["}", ""] if last else []) + [f"Table {r['table_name']} {{"]
            last = r["table_name"]
        out.append(f"  {r['column_name']} {r['data_type'].replace(' ', '_')}{' [pk]' if r['is_pk'] else ''}")
    out += ["}", ""] if last else []
    return "\n".join(out + [f"Ref: {r['child_table']}.{r['child_column']} {DBML_MARKS.get(r['cardinality'], '>')} {r['parent_table']}.{r['parent_column']}" for r in _edges(relationships)])


def to_mermaid(relationships: DataFrame) -> str:
    return "\n".join(["erDiagram", *[f"  {r['child_table']} {MERMAID_MARKS.get(r['cardinality'], '}o--||')} {r['parent_table']} : {r['child_column']}" for r in _edges(relationships)]])


def to_json(relationships: DataFrame) -> str:
    return json.dumps([r.asDict() for r in _edges(relationships)], indent=1)


def orphaned_files(tables: DataFrame, used: DataFrame) -> DataFrame:
    """table_id, parquet_path of extracts of tables that no candidate uses; used: table_id."""
    return tables.where(F.col("parquet_path").isNotNull()).join(used.select("table_id").distinct(), "table_id", "left_anti").select("table_id", "parquet_path")


def removed(files: list[str], root: str, dry_run: bool = True) -> list[str]:
    """Files below root that are (or, without dry_run, have been) removed; paths that leave root are refused."""
    base, out = Path(root).resolve(), []
    for f in files:
        path = (base / f).resolve()
        if base in path.parents and path.is_file():
            out.append(str(path))
            if not dry_run:
                os.remove(path)
    return out
