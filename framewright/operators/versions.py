"""Tables and their manifest published together, as numbered versions of a folder.

A version's tables are written by Spark to a new folder beside the older ones; nothing refers to it until they are whole. Then one file, whose
number is one above the last, is moved into `_commits`: it names the folder and holds the manifest. A reader takes the highest number, so
that it sees data and manifest of one version, the old one until that move and the new one from then on. A writer that dies on the
way leaves a folder that nothing names. Of two writers that began from one version the second fails: the move never replaces a file.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

COMMITS, DIGITS = "_commits", 12


class Conflict(RuntimeError):
    """Another writer published first."""


def _store(spark: SparkSession, path: str):
    """(the JVM, Hadoop's file context for the path, a maker of its paths)."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(path).toUri() if make(path).toUri().getScheme() else jvm.java.io.File(path).toURI(), spark.sparkContext._jsc.hadoopConfiguration())
    return jvm, context, make


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Published versions, ascending."""
    jvm, context, make = _store(spark, path)
    at = make(f"{path}/{COMMITS}")
    if not context.util().exists(at):
        return []
    return sorted(int(s.getPath().getName()) for s in context.util().listStatus(at) if s.getPath().getName().isdigit())


class Version:
    """One published version: its number, manifest and tables."""

    def __init__(self, spark: SparkSession, path: str, number: int):
        self.spark, self.path, self.number = spark, path, number
        said = json.loads(spark.read.text(f"{path}/{COMMITS}/{number:0{DIGITS}d}", wholetext=True).first()["value"])
        self.folder, self.manifest, self.names = said["folder"], said["manifest"], said["tables"]

    def table(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(f"version {self.number} of {self.path} has the tables {', '.join(self.names)}")
        return self.spark.read.parquet(f"{self.path}/{self.folder}/{name}")


def current(spark: SparkSession, path: str) -> Version:
    found = numbers(spark, path)
    if not found:
        raise FileNotFoundError(f"nothing was published at {path}")
    return Version(spark, path, found[-1])


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], manifest: dict, after: int | None = None) -> Version:
    """Write the tables and publish them with their manifest. `after`: the version that this one follows, the latest when the call began
    if not given; a `Conflict` if another has been published since."""
    before = numbers(spark, path)
    after = (before[-1] if before else 0) if after is None else after
    if before and before[-1] > after:
        raise Conflict(f"{path} has gone on to version {before[-1]}")
    folder = f"v-{uuid.uuid4().hex}"
    jvm, context, make = _store(spark, path)
    try:
        for name, table in tables.items():
            table.write.parquet(f"{path}/{folder}/{name}")
    except Exception:
        context.delete(make(f"{path}/{folder}"), True)
        raise
    line = json.dumps({"folder": folder, "manifest": manifest, "tables": sorted(tables)}, sort_keys=True)
    number, draft = after + 1, make(f"{path}/{folder}/commit")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0)
    out = context.create(draft, flags, options)
    out.write(bytearray(line.encode("utf-8")))
    out.close()
    context.mkdir(make(f"{path}/{COMMITS}"), jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
    try:
        # without the option to overwrite, a file that is there stays
        context.rename(draft, make(f"{path}/{COMMITS}/{number:0{DIGITS}d}"), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        context.delete(make(f"{path}/{folder}"), True)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"another writer published version {number} of {path}") from None
        raise
    return Version(spark, path, number)


def clean(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the last `keep` versions, and folders that none names; returns how many folders went. Not to be called while
    another writer is at work or an older version is read."""
    if keep < 1:
        raise ValueError("at least one version stays")
    jvm, context, make = _store(spark, path)
    every = numbers(spark, path)
    held = {Version(spark, path, n).folder for n in every[-keep:]}
    for n in every[:-keep]:
        context.delete(make(f"{path}/{COMMITS}/{n:0{DIGITS}d}"), False)
    gone = [s.getPath() for s in context.util().listStatus(make(path)) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in held]
    for one in gone:
        context.delete(one, True)
    return len(gone)
