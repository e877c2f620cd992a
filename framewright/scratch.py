"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder serves a local master, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = getattr(spark.sparkContext, "_framewright_scratch", None)
    if made is None:
        made = spark.sparkContext._framewright_scratch = tempfile.mkdtemp(prefix="framewright-")
    return made


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def path_for(spark: SparkSession, name: str) -> str:
    """A new path; what is written there goes when the session ends."""
    path = f"{folder(spark)}/framewright/{name}-{uuid.uuid4().hex}"
    system, at = _hadoop(spark, path)
    system.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows and read them back: the lineage ends there, and a lost executor costs no recomputation."""
    path = path_for(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def drop(df: DataFrame) -> None:
    """Free a table of `written` that no later step reads."""
    system, at = _hadoop(df.sparkSession, df._written_at)
    system.delete(at, True)
