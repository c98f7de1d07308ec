"""Intermediate tables in the cluster's shared folder, which cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a new one in local mode; on a cluster an error, as executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _there(spark: SparkSession, path: str):
    """A path and the file system that holds it, whichever that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    where, fs = _there(spark, path)
    fs.delete(where, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if there is no folder."""
    where, fs = _there(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """A small file, which appears whole: it is written beside its place and renamed."""
    where, fs = _there(spark, path)
    beside, _ = _there(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"could not rename to {path}")


def read_note(spark: SparkSession, path: str) -> str:
    where, fs = _there(spark, path)
    held = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    finally:
        held.close()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when its job ends; else they stay on the executors' disks until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written table.

    The table has no lineage, so a lost executor costs a read, not a recomputation, and its size is known to the planner.
    A caller that gives the ``path`` can drop the table once nothing lazy reads it.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    with short_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table."""
    return materialise(df, "cut")
