"""Cutting lineage through the shared folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="lumenframe-"))
    return _local_folder[0]


def scratch_path(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/lumenframe/{uuid.uuid4().hex}"


def materialize(df: DataFrame, filed: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives the loss of executors,
    freezes anything that depends on task placement, and is read column by column.

    ``filed``: rows in a file at most, for rows so large that a reader's batch of them would not fit; 0 for no bound."""
    path = scratch_path(df.sparkSession)
    (df.write.option("maxRecordsPerFile", filed) if filed else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` has written for ``df``, which is not read again."""
    jvm, files = df.sparkSession._jvm, df.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def give_back() -> None:
    """At the end of a Python task: freed memory goes back to the system, for Spark's workers go on with other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)
