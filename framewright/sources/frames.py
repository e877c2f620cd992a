"""Frames from storage: Parquet is canonical; IDX images and npz banks are decoded by executors; HDF5 needs h5py."""

from __future__ import annotations

import gzip
import io
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import vec
from framewright.operators import split as splits
from framewright.schema import BANK, FRAME
from framewright.shipping import ship

#: The environment variable that may name the signal file; an empty one counts as unset.
SIGNAL_VARIABLE = "FRAMEWRIGHT_SIGNALS"


def signal_path(data_dir: str, filename: str, explicit: str | None = None) -> str:
    return explicit or os.environ.get(SIGNAL_VARIABLE) or f"{data_dir.rstrip('/')}/signals/{filename}"


def from_embeddings(vectors: DataFrame) -> DataFrame:
    """Vectors as frames; their id is the order key. Null or non-finite vectors and null keys are left out."""
    x = vec.doubles("embedding")
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vec.finite(F.col("embedding"))).select(
        F.col("vec_id").alias("row_id"), x.alias("x"), F.col("label").cast("int").alias("label")
    )


def labels_of(vectors: DataFrame) -> DataFrame:
    """(row_id, label) alone: the vectors aren't read."""
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    return rows.select(F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("label"))


def from_signals(rows: DataFrame) -> DataFrame:
    """Signal rows (row_id, re, im, and the seven label fields) as frames with their metadata, renamed and cast."""
    return rows.select(
        F.col("row_id").cast("long").alias("row_id"),
        vec.stacked(vec.doubles("re"), vec.doubles("im")).alias("x"),
        F.col("signal_type").cast("int").alias("label"),
        F.col("signal_to_noise_ratio").cast("int").alias("snr_db"),
        F.col("number_of_pulses").cast("int").alias("number_of_pulses"),
        *(F.col(c).cast("double").alias(c) for c in ("pulse_width", "time_delay", "pulse_repetition_interval")),
        F.col("index").cast("long").alias("index"),
    )


def numeric_meta(frames: DataFrame) -> DataFrame:
    """The numeric columns only."""
    return frames.select([c for c, t in frames.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint")])


def idx_array(content: bytes) -> np.ndarray:
    """The array of an IDX file, gzipped or not: two zero bytes, a type, a number of dimensions, their sizes, the data."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    if raw[:2] != b"\0\0" or raw[2] != 8:
        raise ValueError("not an IDX file of unsigned bytes")
    shape = np.frombuffer(raw, ">u4", raw[3], 4).astype(int)
    return np.frombuffer(raw, np.uint8, int(shape.prod()), 4 + 4 * raw[3]).reshape(shape)


def read_idx(spark: SparkSession, images: str, labels: str) -> DataFrame:
    """Image frames, pixels in 0..1, from an IDX image file and its label file. A file is read by one task, in slices."""
    ship(spark)

    def pixels(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                a = idx_array(content).astype(np.float64)
                a = a.reshape(len(a), -1) / 255.0
                for at in range(0, len(a), 2000):
                    part = a[at : at + 2000]
                    rows = pa.FixedSizeListArray.from_arrays(pa.array(part.reshape(-1)), part.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), rows], names=["row_id", "x"])

    def classes(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                a = idx_array(content)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(a))), pa.array(a.astype(np.int32))], names=["row_id", "label"])

    def content(path):
        return spark.read.format("binaryFile").load(path).select("content")

    x = content(images).mapInArrow(pixels, "row_id long, x array<double>")
    return x.join(content(labels).mapInArrow(classes, "row_id long, label int"), "row_id").select("row_id", "x", "label")


def read_npz_bank(spark: SparkSession, path: str) -> DataFrame:
    """A bank from an npz file with arrays z and label."""
    ship(spark)

    def rows(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with np.load(io.BytesIO(content)) as f:
                    z, label = f["z"].astype(np.float64), f["label"]
                if z.ndim != 2 or label.shape != (len(z),):
                    raise ValueError("z must be two-dimensional and label have a value per row")
                for at in range(0, len(z), 2000):
                    part = z[at : at + 2000]
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(part.reshape(-1)), part.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), lists, pa.array(label[at : at + 2000].astype(np.int32))], names=["ref_index", "z", "label"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, BANK)


def _open_hdf5(path: str):
    import h5py

    return h5py.File(path, "r")


def read_hdf5(spark: SparkSession, source: str, rows_per_slice: int = 5000, opener=_open_hdf5) -> DataFrame:
    """Signal rows (row_id, re, im and the label fields) of a file that all executors can reach: each task opens it and reads its
    slices. Needs h5py on driver and executors, unless another opener with the same interface is given."""
    ship(spark)
    with opener(source) as f:
        n, fields = len(f["iq"]), f["labels"].dtype
    kinds = {name: "double" if np.issubdtype(fields[name], np.floating) else "long" for name in fields.names}

    def rows(batches):
        with opener(source) as f:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    at = slice(k * rows_per_slice, (k + 1) * rows_per_slice)
                    x, y = f["iq"][at], f["labels"][at]
                    halves = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(p, np.float64).reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64())) for p in (x.real, x.imag)]
                    more = [pa.array(y[name].astype(np.float64 if t == "double" else np.int64)) for name, t in kinds.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at.start, at.start + len(x))), *halves, *more], names=["row_id", "re", "im", *kinds])

    slices = max(1, -(-n // rows_per_slice))
    schema = "row_id long, re array<double>, im array<double>, " + ", ".join(f"`{name}` {t}" for name, t in kinds.items())
    return spark.range(0, -(-n // rows_per_slice), 1, slices).mapInArrow(rows, schema)


def hdf5_to_parquet(spark: SparkSession, source: str, out: str, rows_per_slice: int = 5000, opener=_open_hdf5) -> None:
    """Convert a signal file once; everything else reads the Parquet table."""
    read_hdf5(spark, source, rows_per_slice, opener).write.parquet(out)


def load_frames(spark: SparkSession, name: str, split: str = "train", *, data_dir: str = "data", filename: str = "signals.h5",
                path: str | None = None, train_fraction: float = 0.9, seed: int = 42, max_samples: int | None = None) -> DataFrame:
    """Frames of a named kind of data. `max_samples` takes a prefix before the split. Missing paths fail in the reader."""
    if name == "signals":
        at = path or signal_path(data_dir, filename)
        frames = from_signals(spark.read.parquet(at.removesuffix(".h5") + ".parquet" if at.endswith(".h5") else at))
        rounding = "half_even"
    elif name == "images":
        kind = "t10k" if splits.checked(split) == "test" else "train"
        base = path or f"{data_dir.rstrip('/')}/images"
        frames = read_idx(spark, f"{base}/{kind}-images-idx3-ubyte*", f"{base}/{kind}-labels-idx1-ubyte*")
        if kind == "t10k":
            return splits.prefix(frames, max_samples)
        rounding = "floor"
    elif name == "embeddings":
        frames, rounding = from_embeddings(spark.read.parquet(path or f"{data_dir}/embeddings.parquet")), "half_even"
    else:
        raise ValueError(f"unknown data {name!r}")
    frames = splits.prefix(frames, max_samples)
    if splits.checked(split) == "all":
        return frames
    return splits.seeded(frames, split, frames.count(), fraction=train_fraction, seed=seed, rounding=rounding)


__all__ = ["BANK", "FRAME", "from_embeddings", "from_signals", "hdf5_to_parquet", "idx_array", "labels_of", "load_frames", "numeric_meta", "read_hdf5", "read_idx", "read_npz_bank", "signal_path"]
