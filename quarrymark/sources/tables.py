"""Readers for a folder of Parquet tables, and the export sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder; columns are pruned and filters pushed down by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def names(spark: SparkSession, folder: str) -> list[str]:
    """The tables of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().getName().removesuffix(".parquet") for f in files if f.getPath().getName().endswith(".parquet"))
