"""Exact nearest references and the vote over them.

A bank of up to `BROADCAST_BYTES` goes to every task. A larger one meets the queries by cells (`knn_join`), of which bounds leave out
most where the vectors have structure; under measures that aren't distances it meets them block by block, with the best k of each
block going on. In all ways the distances of the survivors are exact; ties go to the smaller ref_index.
Queries that repeat an id are answered each: `query` tells them apart.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions import vec
from framewright.operators.knn_join import best, nearest_by_cells
from framewright.operators.score import as_rows, complex_rows
from framewright.shipping import ship

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 20_000
RESULT = "query long, qid long, y int, rank int, ref_index long, label int, distance double"


def _unit(v: np.ndarray, floor: float = vec.LENGTH_FLOOR) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), floor)


#: Pairs whose exact distances are computed at once; bytes of rough distances that a task holds at once.
PAIRS, TILE_BYTES = 1 << 15, 4 << 20


class Euclidean:
    """Rough distances come from one product; those that may be among the best are computed exactly."""

    def __init__(self, z: np.ndarray):
        self.z, self.square = z, (z * z).sum(1)
        self.queries, self.rows = 256, TILE_BYTES // (8 * 256)

    def ask(self, q: np.ndarray) -> None:
        self.q, self.norm = q, (q * q).sum(1)

    def rough(self, a: slice, b: slice, cut: np.ndarray) -> np.ndarray:
        d = self.q[a] @ self.z[b].T
        d *= -2
        d += self.square[b]
        d += self.norm[a][:, None]
        return d

    def loose(self, a: slice, b: slice) -> np.ndarray:
        """How far `rough` can be off."""
        return 1e-9 * (1 + self.norm[a] + self.square[b].max(initial=0))

    def exact(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.z[c] - self.q[r]) ** 2).sum(1))

    def level(self, d: np.ndarray) -> np.ndarray:
        """What `rough` would be at an exact distance."""
        return d * d


class Cosine(Euclidean):
    """Rough scores come from one product, which may tell equal references apart in the last digit."""

    def ask(self, q):
        self.q = _unit(q)

    def rough(self, a, b, cut):
        return -(self.q[a] @ self.z[b].T)

    def loose(self, a, b):
        return np.full(len(self.q[a]), 1e-12)

    def exact(self, r, c):
        return -(self.z[c] * self.q[r]).sum(1)

    def level(self, d):
        return d


class Hermitian(Cosine):
    """The magnitude of the complex product at lag 0."""

    def ask(self, q):
        self.q = _unit(q, vec.ENERGY_FLOOR)
        re, im = np.split(self.q, 2, axis=1)
        self.turned = np.concatenate([im, -re], 1)

    def rough(self, a, b, cut):
        re, im = self.q[a] @ self.z[b].T, self.turned[a] @ self.z[b].T
        re *= re
        im *= im
        re += im
        np.sqrt(re, out=re)
        return np.negative(re, out=re)

    def exact(self, r, c):
        return -np.abs((np.conj(complex_rows(self.z[c])) * complex_rows(self.q[r])).sum(1))


class Circular(Cosine):
    """The peak of the circular correlation. It is at most the sum of |X_n| |M_n| over frequencies, divided by their number: one product of
    small real matrices bounds all pairs. For what that leaves open all lags come from one product in single precision with the query
    turned by each lag, or, of frames longer than `LAGS` samples, from inverse FFTs; those that may be among the best are computed
    exactly by an inverse FFT each."""

    LAGS = 64

    def __init__(self, z):
        self.z, n, self.lags = z, len(z), z.shape[1] // 2
        length = np.sqrt((z * z).sum(1))
        self.size = np.where(length > 0, length, 1.0)
        self.single, self.magnitude = np.empty((n, 2 * self.lags), np.float32), np.empty((n, self.lags), np.float32)
        for at in range(0, n, 4096):
            part = slice(at, at + 4096)
            self.single[part] = z[part] / self.size[part, None]
            self.magnitude[part] = np.abs(np.fft.fft(complex_rows(self.single[part].astype(np.float64)), axis=1)) / max(self.lags, 1)
        self.queries = 16 if self.lags <= self.LAGS else 1
        self.rows = max(1, TILE_BYTES // (4 * 2 * max(self.lags, 1) * self.queries))

    def ask(self, q):
        self.q = _unit(q, vec.ENERGY_FLOOR)
        self.spectrum = np.fft.fft(complex_rows(self.q), axis=1)

    def turned(self, q: np.ndarray) -> np.ndarray:
        """(real and imaginary parts, queries, lags): vectors whose products with a reference are its correlation at each lag."""
        at = (np.arange(self.lags)[None] + np.arange(self.lags)[:, None]) % self.lags
        re, im = q[:, : self.lags][:, at], q[:, self.lags :][:, at]
        return np.stack([np.concatenate([re, im], 2), np.concatenate([im, -re], 2)]).astype(np.float32)

    def rough(self, a, b, cut):
        size = self.size[b]
        bound = np.abs(self.spectrum[a]).astype(np.float32) @ self.magnitude[b].T
        free = np.flatnonzero(((bound + 1e-5) * size >= -cut[:, None]).any(0))
        out = np.full(bound.shape, np.inf)
        if not len(free):
            return out
        z = self.single[b] if len(free) == bound.shape[1] else self.single[b][free]
        if self.lags <= self.LAGS:
            if self.of != a:
                self.of, self.by_lag = a, self.turned(self.q[a]).reshape(-1, z.shape[1])
            g = (self.by_lag @ z.T).reshape(2, -1, self.lags, len(z))
            g *= g
            g[0] += g[1]
            out[:, free] = -np.sqrt(g[0].max(1)) * size[free]
        else:
            s = np.conj(np.fft.fft(complex_rows(z.astype(np.float64)), axis=1))
            for row, f in zip(out, self.spectrum[a]):
                row[free] = -np.abs(np.fft.ifft(f * s, axis=1)).max(1) * size[free]
        return out

    of, by_lag = None, None

    def loose(self, a, b):
        """Single precision is off by less than 1e-7 for each component of unit vectors."""
        return np.full(len(self.q[a]), 1e-7 * (100 + 2 * self.lags) * self.size[b].max(initial=0))

    def exact(self, r, c):
        s = np.conj(np.fft.fft(complex_rows(self.z[c]), axis=1))
        return -np.abs(np.fft.ifft(self.spectrum[r] * s, axis=1)).max(1)


#: References whose peaks are computed at once; a query stops after the first such run that leaves no other possible.
VERIFY = 32


def best_circular(q: np.ndarray, z: np.ndarray, ref: np.ndarray, k: int):
    """For each query (positions, negated scores, pairs verified) of the k references with the highest peaks of the circular
    correlation. A peak is at most the sum of |X_n| |M_n| over frequencies, divided by their number: one product of real matrices
    bounds all pairs. References are verified, by an inverse FFT each, in the order of their bounds, until the next bound is below
    the k-th best peak."""
    f, s = np.fft.fft(complex_rows(_unit(q, vec.ENERGY_FLOOR)), axis=1), np.conj(np.fft.fft(complex_rows(z), axis=1))
    bounds = np.abs(f) @ np.abs(s).T / f.shape[1] + 1e-12
    for one, bound in enumerate(bounds):
        order = np.argsort(-bound, kind="stable")
        peak, seen = np.empty(0), 0
        while seen < len(order) and (seen < k or bound[order[seen]] >= np.partition(peak, seen - k)[seen - k] - 1e-12):
            run = order[seen : seen + max(VERIFY, k)]
            peak = np.concatenate([peak, np.abs(np.fft.ifft(f[one] * s[run], axis=1)).max(1)])
            seen += len(run)
        near = order[:seen]
        best = np.lexsort((ref[near], -peak))[:k]
        yield near[best], -peak[best], seen


#: Smaller is nearer; scores are negated. References must be scaled already.
MEASURES = {"euclidean": Euclidean, "cosine": Cosine, "hermitian": Hermitian, "circular": Circular}


def best_of_block(q: np.ndarray, known, ref: np.ndarray, k: int):
    """(row of q, position, rank, distance) of each query's k nearest of the references of the measure `known`, nearest first. Queries
    meet references tile by tile and keep their k best, so that what is held grows with neither."""
    known.ask(q)
    found = []
    for at in range(0, len(q), known.queries):
        a = slice(at, min(at + known.queries, len(q)))
        n = a.stop - a.start
        row, pos, dist, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(n, np.inf)
        for first in range(0, len(ref), known.rows):
            b = slice(first, min(first + known.rows, len(ref)))
            loose = known.loose(a, b)
            cut = known.level(kth) + loose
            rough = known.rough(a, b, cut)
            if rough.shape[1] > k and np.isinf(kth).any():
                cut = np.minimum(cut, np.partition(rough, k - 1, 1)[:, k - 1] + 2 * loose)
            r, c = np.nonzero(rough <= cut[:, None])
            if not len(r):
                continue
            d = np.concatenate([known.exact(at + r[i : i + PAIRS], first + c[i : i + PAIRS]) for i in range(0, len(r), PAIRS)])
            row, pos, dist = np.concatenate([row, r]), np.concatenate([pos, first + c]), np.concatenate([dist, d])
            keep, _ = best(row, ref[pos], dist, k)
            row, pos, dist = row[keep], pos[keep], dist[keep]
            full = np.bincount(row, minlength=n) >= k
            kth[full] = dist[np.searchsorted(row, np.flatnonzero(full), "right") - 1]
        rank = best(row, ref[pos], dist, k)[1] + 1
        found.append((row + at, pos, rank, dist))
    return [np.concatenate([np.zeros(0, t), *c]) for t, c in zip((np.int64, np.int64, np.int64, np.float64), zip(*found) if found else [()] * 4)]


def _found(keys, q, known, ref, label, k) -> pa.Table:
    """`keys`: query, qid and y of each query."""
    row, pos, rank, d = best_of_block(q, known, ref, k)
    columns = [*(np.asarray(key)[row] for key in keys), rank, ref[pos], label[pos], d]
    kinds = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int32, np.float64)
    return pa.table([c.astype(t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in RESULT.split(", ")])


def nearest(queries: DataFrame, bank: DataFrame, k: int = 1, normalize: bool = False, broadcast_bytes: int = BROADCAST_BYTES, measure: str = "euclidean") -> DataFrame:
    """The k nearest references (all, if fewer) of `queries` (row_id, label, x) in `bank` (ref_index, z, label)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = queries.sparkSession
    ship(spark)
    asked = queries.select(F.monotonically_increasing_id().alias("query"), F.col("row_id").alias("qid"), F.col("label").cast("int").alias("y"), vec.doubles("x").alias("x"))
    held = bank.select(F.col("ref_index").cast("long").alias("ref_index"), vec.doubles("z").alias("z"), F.col("label").cast("int").alias("label"))
    widths = held.agg(F.min(F.size("z")).alias("lo"), F.max(F.size("z")).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if widths["n"] == 0:
        return spark.createDataFrame([], RESULT)
    if widths["lo"] != widths["hi"]:
        raise ValueError("bank vectors differ in length")
    width, prepared = widths["hi"], _unit if normalize else (lambda v: v)
    asked = asked.where(F.assert_true(F.size("x") == width, F.lit("a query's length differs from the bank's")).isNull())

    if widths["n"] * width * 8 <= broadcast_bytes:
        rows = held.orderBy("ref_index").toArrow().combine_chunks()
        z = prepared(as_rows(rows["z"].combine_chunks()))
        shared = spark.sparkContext.broadcast((z, rows["ref_index"].to_numpy(), rows["label"].to_numpy()))

        def scan(batches):
            known = None
            for batch in batches:
                if batch.num_rows:
                    z, ref, label = shared.value
                    known = known or MEASURES[measure](z)
                    keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                    found = _found(keys, prepared(as_rows(batch.column(3))), known, ref, label, k)
                    yield from found.combine_chunks().to_batches()

        # scoring is what costs: over all tasks, however few files hold the queries
        return asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query").mapInArrow(scan, RESULT)

    if measure == "euclidean":
        return nearest_by_cells(queries, bank, k, normalize).neighbours.select(*(f.split()[0] for f in RESULT.split(", ")))

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64())], names=[f.split()[0] for f in RESULT.split(", ")])
        q, z = (prepared(as_rows(t[c].combine_chunks())) for t, c in ((asked, "x"), (held, "z")))
        keys = [asked[c].to_numpy() for c in ("query", "qid", "y")]
        return _found(keys, q, MEASURES[measure](z), held["ref_index"].to_numpy(), held["label"].to_numpy(), k)

    parts, groups = math.ceil(widths["n"] / BLOCK_ROWS), max(1, math.ceil(asked.count() / BLOCK_ROWS))
    left = asked.withColumn("g", F.pmod(F.xxhash64("query"), F.lit(groups))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = held.withColumn("b", F.pmod(F.xxhash64("ref_index"), F.lit(parts)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    found = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(meet, RESULT)
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "ref_index"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def circular_work(queries: DataFrame, bank: DataFrame, k: int = 1) -> DataFrame:
    """One row: pairs of queries and references, and those of them whose circular peak is computed to find each query's k best. For a
    bank that fits a broadcast."""
    ship(queries.sparkSession)
    rows = bank.select("ref_index", vec.doubles("z").alias("z")).limit(BLOCK_ROWS + 1).toArrow().combine_chunks()
    if len(rows) > BLOCK_ROWS:
        raise ValueError("the bank is too large to be broadcast")
    shared = queries.sparkSession.sparkContext.broadcast((as_rows(rows["z"].combine_chunks()) if len(rows) else np.zeros((0, 2)), rows["ref_index"].to_numpy()))

    def scan(batches):
        for batch in batches:
            z, ref = shared.value
            if batch.num_rows and len(z):
                seen = [n for *_, n in best_circular(as_rows(batch.column(0)), z, ref, k)]
                yield pa.RecordBatch.from_arrays([pa.array([len(seen) * len(z)]), pa.array([sum(seen)])], names=["pairs", "verified"])

    found = queries.select(vec.doubles("x").alias("x")).mapInArrow(scan, "pairs long, verified long")
    return found.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("verified"), F.lit(0)).alias("verified"))


def nearest_by_expressions(queries: DataFrame, bank: DataFrame, k: int = 1, normalize: bool = False) -> DataFrame:
    """The same through a cross join of a small bank: the form that SQL can check."""
    x, z = vec.doubles("x"), vec.doubles("z")
    if normalize:
        x, z = vec.scaled_to_unit(x), vec.scaled_to_unit(z)
    left = queries.select(F.monotonically_increasing_id().alias("query"), F.col("row_id").alias("qid"), F.col("label").cast("int").alias("y"), x.alias("x"))
    small = bank.select("ref_index", z.alias("z"), F.col("label").cast("int").alias("label"))
    if small.limit(BLOCK_ROWS + 1).count() > BLOCK_ROWS:
        raise ValueError("the bank is too large for a cross join; use nearest()")
    both = left.crossJoin(F.broadcast(small)).select("query", "qid", "y", "ref_index", "label", vec.distance(F.col("x"), F.col("z")).alias("distance"))
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "ref_index"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "qid", "y", "rank", "ref_index", "label", "distance")


def majority_vote(neighbours: DataFrame) -> DataFrame:
    """(row_id, y, pred) of every query: the commonest label; ties go to the smallest."""
    votes = neighbours.groupBy("query", "qid", "y", "label").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("query", "qid", "y").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("pred"))
    return best.select(F.col("qid").alias("row_id"), "y", "pred")


def within(neighbours: DataFrame, limit: float) -> DataFrame:
    """Open-set rejection: only references closer than the limit take part."""
    return neighbours.where(F.col("distance") <= limit)
