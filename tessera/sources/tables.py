"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, read anew each time; a local one only where none is set and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'tessera-shared')}"


def table(df: DataFrame, name: str, where: bool = False) -> DataFrame | tuple[DataFrame, str]:
    """``df`` written as Parquet and read again: computed once, with no lineage that a lost executor could force anew.

    ``where``: with its path, for ``removed``.
    """
    path = f"{shared_dir(df.sparkSession)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    return (made, path) if where else made


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def renamed(spark: SparkSession, source: str, target: str) -> bool:
    fs, where = _at(spark, source)
    return fs.rename(where, _at(spark, target)[1])


def removed(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def said(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in any store that Hadoop knows."""
    fs, where = _at(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def freed(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that nothing refers to any more; else they stay until the driver's memory is short."""
    gc.collect()
    spark._jvm.System.gc()
