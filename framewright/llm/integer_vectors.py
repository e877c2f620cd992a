"""Vectors as whole numbers, packed into bytes, for operators whose every distance is exact.

A component x becomes floor(scale * x). Of a vector of length L components of up to `bound(L)` in magnitude take part, so that any
squared distance, and the sum over its parts, fits 64 bits; rows beyond it couldn't have a distance in a long column and take no
part. With scale 4096 and 64 components that is 16,384 for x, with scale 256 it is 262,144.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.shipping import ship

from .common import prepare, slices


def bound(length: int) -> int:
    """The largest magnitude of components: length * (2 * bound)^2 is at most 2^60, so that four times a distance fits too."""
    return min(math.isqrt((1 << 58) // max(length, 1)), (1 << 31) - 1)


def packed(vectors: DataFrame, scale: int, keep: list[str], vector_col: str = "embedding", length: int | None = None) -> DataFrame:
    """Columns of `keep`, `length` int and `v`: the floors as little-endian 32-bit integers. Vectors that are null, hold null or
    non-finite components, are of another length than the one asked for, or beyond the bound, are left out."""
    ship(vectors.sparkSession)
    prepare(vectors.sparkSession)
    rows = vectors.select(*keep, F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    if length is not None:
        rows = rows.where(F.size("v") == length)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def scan(batches):
        for batch in slices(batches, 10_000):
            lists = batch.column(batch.num_columns - 1)
            n = np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(n)
            values = lists.flatten()
            x = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # null components are NaN
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(x * scale)
            limits = {k: bound(k) for k in np.unique(n).tolist()}
            limit = np.repeat(np.array([limits[k] for k in n.tolist()], np.float64), n)
            bad = np.concatenate([[0], np.cumsum(~(np.abs(whole) <= limit))])  # NaN is not within it
            good = np.flatnonzero(bad[ends] == bad[ends - n])
            data = np.where(np.abs(whole) <= limit, whole, 0).astype("<i4").tobytes()
            blobs = [data[4 * (e - k) : 4 * e] for e, k in zip(ends[good].tolist(), n[good].tolist())]
            others = [batch.column(i).take(pa.array(good)) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*others, pa.array(n[good], pa.int32()), pa.array(blobs, pa.binary())], names=[*keep, "length", "v"])

    return rows.mapInArrow(scan, f"{kinds}, length int, v binary")


def unpacked(column, length: int) -> np.ndarray:
    """Rows of equal length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), length)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = x.astype(np.int64) - y
    return np.einsum("ij,ij->i", d, d)
