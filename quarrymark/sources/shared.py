"""Where jobs of several passes leave what the next pass reads.

Everything goes to the folder that the cluster names in ``spark.checkpoint.dir``, which all
executors share, so a lost executor loses nothing. Only where that setting is absent and the
master is local (tests, a laptop) a temporary folder is made and set. What was written is deleted
when the session ends; ``cleared`` deletes it before.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; also makes it the folder of ``checkpoint()``."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    set_to = sc.getCheckpointDir()
    if named:
        if set_to is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if set_to is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quarrymark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir("file://" + folder)
        set_to = sc.getCheckpointDir()
    return set_to.rstrip("/")


_MADE: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def cleared(spark: SparkSession) -> int:
    """Deletes what this session's jobs have left in the shared folder so far; for a driver that is done with its results. Returns the number of folders."""
    count = len(_MADE)
    while _MADE:
        removed(spark, _MADE.pop())
    return count


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, at = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def removed(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all."""
    fs, at = _file_system(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(part, at):
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _file_system(spark, path)
    data = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(data)).decode()
    finally:
        data.close()


def staged(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """df, written to the shared folder and read back: cuts lineage and computes df once.

    by: a column of few values, whose rows are kept apart so that a filter on it reads only them.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def pinned(df: DataFrame) -> DataFrame:
    """df by ``checkpoint()``: unlike ``staged``, keeps which row lies in which partition."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
