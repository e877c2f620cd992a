"""Helpers that several operators share: reading texts, shared tables, bounded memos."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.shipping import ship

#: Documents a Python worker gets at once; with Arrow's own bound on bytes this bounds its memory.
BATCH_ROWS = 1000


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary file lies; every operator takes another path too."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Before any Python runs on executors: the package is there, and batches of long texts stay small. Spark reads the size of batches
    when a returned frame runs, so it can't be put back before; a session that set a size of its own keeps it."""
    ship(spark)
    if spark.conf.get(ARROW_ROWS) == "10000":  # Spark's default
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


def slices(batches, rows: int = BATCH_ROWS):
    """Arrow batches in slices of few rows, whatever the session's setting. At a task's end its freed memory goes back to the
    system: a worker is kept for other tasks, and what it once needed would stay with it."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
        trim(0)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts as empty ones. Other columns, of whatever name, are not read."""
    prepare(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def id_remainder(modulus: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(modulus)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one serves a local master, as in
    tests; executors on other machines could not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framewright-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get()
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session ends."""
    path = f"{shared_dir(spark)}/framewright/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_shared(spark: SparkSession, path: str) -> None:
    """Free a shared table that no later step reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Spark's own switch: the shuffle files of a finished write are deleted at once, not when the driver's memory is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a step's rows to the shared folder and read them back: the lineage ends there, and a lost
    executor costs no recomputation. The session's settings are as before afterwards."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct numbers, ascending: by sorting, which takes a tenth of the time of numpy's hashing or less."""
    ordered = np.sort(values)
    keep = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=keep[1:])
    return ordered[keep]


class Memo(dict):
    """A bounded memo of a pure function: emptied when full, so that it never grows with the input."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def lower_ascii_words(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8, A-Z lowered and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower().split()
