"""Clusters of whole-number vectors by Lloyd's rounds whose every assignment is exact.

Screening: scores |c|^2 - 2 x.c of all centroids come from one product of float32 matrices. Every one of them lies within a
radius that the rounding of its operands, of each product and sum in whatever order, and of the last subtraction can't exceed
(`radius`). Centroids whose interval begins above the smallest upper end can't be nearest. Where one is left, it is the
nearest; where intervals overlap, just these centroids' distances are computed again as 64-bit integers, and of equal ones the
smallest number wins. So the result is that of exact arithmetic throughout, whatever the matrix library does.

A round is one scan of packed vectors. Tasks send sums and counts per centroid, which are added up before they come to the driver:
k x `dim` numbers, whatever the number of vectors. New centroids are floor(sum / count) in unbounded integers; a centroid
without vectors stays.

Null, short, long and non-finite vectors, and those beyond `integer_vectors.bound`, are left out. Repeated rows count each; rows that
repeat an id have one hash and follow by their packed bytes. A null id takes part and comes last among first centroids. Fewer
vectors than k give as many centroids; an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .integer_vectors import packed, squared, unpacked

#: Half a unit in the last place of float32.
ROUNDING = 2.0**-24
BATCH = 4096


def radius(x_norm: np.ndarray, c_norm: np.ndarray, dim: int) -> np.ndarray:
    """How far a float32 score |c|^2 - 2 x.c can be from the true one.

    With u = 2^-24 both operands carry a relative error of u, each product one more, and each of the additions, in any order and
    fused or not, one more: |computed - x.c| <= ((1 + u)^(dim + 3) - 1) sum |x_i c_i|, and that sum is at most |x| |c|. Rounding
    |c|^2 and the difference adds u |c|^2 and u of the result. The factor 1.01 covers the rounding of the radius itself, which
    is computed in double precision."""
    of_product = np.expm1((dim + 4) * np.log1p(ROUNDING))
    product = x_norm[:, None] * c_norm[None, :]
    square = (c_norm * c_norm)[None, :]
    return 1.01 * (2 * of_product * product + 2 * ROUNDING * (square + 2 * (1 + of_product) * product))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, exact squared distance) of each row, and how many rows needed exact integers to decide."""
    c64 = centroids.astype(np.float64)
    c_norm = np.sqrt((c64 * c64).sum(1))
    scores = np.square(c_norm).astype(np.float32)[None, :] - np.float32(2) * (x.astype(np.float32) @ centroids.astype(np.float32).T)
    x64 = x.astype(np.float64)
    width = radius(np.sqrt(np.einsum("ij,ij->i", x64, x64)), c_norm, x.shape[1])
    lower, upper = scores - width, (scores + width).min(1)
    possible = lower <= upper[:, None]
    best = np.argmax(possible, 1)  # the only one, where one is left
    open_rows = np.flatnonzero(possible.sum(1) > 1)
    if len(open_rows):
        at, c = np.nonzero(possible[open_rows])
        d = squared(x[open_rows[at]], centroids[c])
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        least = np.minimum.reduceat(d, first)
        is_least = np.flatnonzero(d == least[at])  # by row, then by number: a row's first is its smallest number
        rows, where = np.unique(at[is_least], return_index=True)
        best[open_rows[rows]] = c[is_least[where]]
    return best, squared(x, centroids[best]), len(open_rows)


def first_centroids(rows: DataFrame, k: int, seed: int, id_col: str) -> np.ndarray:
    """The vectors of the k smallest hashes of `seed:id`."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    top = rows.select("v", "length", mark.alias("mark")).orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()
    return np.array([np.frombuffer(r["v"], "<i4") for r in top], np.int64)


def sums(rows: DataFrame, centroids: np.ndarray) -> list:
    """(number, vectors, sums by position) of the centroids that have vectors: k rows at most."""
    dim = centroids.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def scan(batches):
        c = shared.value
        n, total = np.zeros(len(c), np.int64), np.zeros((len(c), dim), np.int64)
        for batch in slices(batches, BATCH):
            x = unpacked(batch.column(0), dim)
            best = nearest(x, c)[0]
            n += np.bincount(best, minlength=len(c))
            order = np.argsort(best, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], np.diff(best[order]) > 0])) if len(order) else order
            if len(start):
                total[best[order][start]] += np.add.reduceat(x[order].astype(np.int64), start, axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used], pa.int64()), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = rows.select("v").mapInArrow(scan, "cluster int, n long, total array<long>")
    each = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect()


def fit(rows: DataFrame, k: int, rounds: int, seed: int, id_col: str) -> np.ndarray:
    """Centroids after `rounds` rounds over packed rows."""
    centroids = first_centroids(rows, k, seed, id_col)
    for _ in range(rounds if len(centroids) else 0):
        for r in sums(rows, centroids):
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(centroids.shape[1])]
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray, id_col: str) -> DataFrame:
    """(id, cluster, distance) of packed rows."""
    dim, kind = centroids.shape[1], rows.schema[id_col].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def scan(batches):
        for batch in slices(batches, BATCH):
            best, d, _ = nearest(unpacked(batch.column(1), dim), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(d, pa.int64())], names=[id_col, "cluster", "distance"])

    return rows.select(id_col, "v").mapInArrow(scan, f"`{id_col}` {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, seed: int = 2,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256. An inertia that a long
    can't hold is null."""
    ids = vectors.withColumn(id_col, F.col(id_col).cast("long"))
    rows = stored(packed(ids, scale, [id_col], vector_col, dim), "whole-vectors")
    centroids = fit(rows, k, rounds, seed, id_col)
    spark = vectors.sparkSession
    schema = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    assigned = stored(assign(rows, centroids, id_col), "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    whole = fits(sum(inertia.values()))
    # a row for each of the k centroids
    about = [(c, fits(s), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    of = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
