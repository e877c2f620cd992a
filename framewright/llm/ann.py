"""Approximate nearest neighbours by collision counting (query-aware hashing with virtual rehashing).

An index holds, for each of `PROJECTIONS` random directions, the vectors' projections in sorted order and each vector's rank in
it. A query opens a window around its own projection in each of them; virtual rehashing widens all windows together, step
by step of `WIDTHS`, over the same sorted arrays. A vector covered in at least `SHARE` of the windows is verified by its
exact score. The first step at which enough vectors are covered so is taken: a share `VERIFY` of the vectors, and `AT_LEAST` of
them in all. Where that step lies is sought from the one the query before it took, which changes no result.

Largest inner products become nearest points by one more component, which makes all norms alike.

The table is dealt into blocks, each with an index of its own over all its rows; groups of queries meet blocks
of rows in a task each, and only each query's best `k` of a block go on. Every query meets every block: on vectors without
structure a window that finds the neighbours covers half of each projection, so leaving out blocks would lose neighbours.
The result is exact in its scores and approximate only in which neighbours are found: recall and the verified share are measured in the tests.

Vectors that are null, empty, zero or have null or non-finite components take no part; an empty table gives no row. A query's candidates
are the vectors of its own length but its own row: one row with its id and vector. So other rows with its id are candidates, a repeat
of the row too, and queries that repeat an id have a list each. Ties go to the smaller id. Columns other than the two named are not
read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrix, usable

PROJECTIONS, SHARE, VERIFY, AT_LEAST = 240, 0.6, 0.04, 800  # counts of projections fit a byte
BLOCK_ROWS, BLOCK_QUERIES = 65_000, 65_536  # ranks in a block fit two bytes
#: Half-widths of the windows, in distances between typical points; the last covers everything.
WIDTHS = np.append(0.2 * 1.03 ** np.arange(100), np.inf).astype(np.float32)


class BlockIndex:
    """Sorted projections of a block's vectors. `share`: the part of the block that is to be verified."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, share: float, seed: int = 7):
        self.ids, self.vectors, self.largest = ids, vectors, largest
        self.enough, self.step, self.verified = math.ceil(share * len(ids)), len(WIDTHS) // 2, 0
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        scaled = vectors / largest
        lift = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", scaled, scaled), 0))
        at = np.ascontiguousarray((scaled @ self.directions[:-1] + lift[:, None] * self.directions[-1]).astype(np.float32).T)
        self.ranks = np.empty(at.shape, np.uint32 if len(ids) > 65_535 else np.uint16)
        for row, ranks in zip(at, self.ranks):
            order = np.argsort(row)
            ranks[order] = np.arange(len(order))
            row[:] = row[order]
        self.sorted = at

    def covered(self, centre: np.ndarray, step: int) -> np.ndarray:
        """Which vectors lie in enough of the windows of a step."""
        width, count = WIDTHS[step], np.zeros(len(self.ids), np.uint8)
        for row, ranks, c in zip(self.sorted, self.ranks, centre):
            low, high = row.searchsorted(np.array([c - width, np.nextafter(c + width, np.float32(np.inf))], np.float32)).tolist()
            # ranks below `low` wrap around to large numbers
            count += (ranks - ranks.dtype.type(low) < ranks.dtype.type(high - low)).view(np.uint8)
        return np.flatnonzero(count >= math.ceil(SHARE * PROJECTIONS))

    def search(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k verified vectors, best first."""
        unit = query / np.abs(query).max()
        centre = (unit @ self.directions[:-1] / np.linalg.norm(unit)).astype(np.float32)
        low, high, step, stride, found = -1, len(WIDTHS) - 1, self.step, 1, None
        while high - low > 1 or found is None:  # `high` covers enough, `low` doesn't
            step = min(max(step, low + 1), high)
            got = self.covered(centre, step)
            if len(got) >= self.enough or step == len(WIDTHS) - 1:
                high, found, step = step, got, max(step - stride, (low + step) // 2)
            else:
                low, step = step, min(step + stride, (step + high + 1) // 2)
            stride *= 2
        self.step = high
        own = found[self.ids[found] == query_id]
        own = own[(self.vectors[own] == query).all(1)][:1]
        found = np.setdiff1d(found, own)
        self.verified += len(found)
        score = (self.vectors[found] * query).sum(1)
        if len(found) > k:
            limit = np.partition(score, len(score) - k)[len(score) - k]
            found = found[score >= limit - 1e-12 * self.largest * float(np.abs(query).max()) * len(query)]
        score = products(self.vectors[found], query)
        best = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found[best]], score[best]


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, whatever the number of rows."""
    total = np.zeros(len(rows))
    for column, value in zip(rows.T, query.tolist()):
        total += column * value
    return total


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors found, by largest inner product."""
    spark = vectors.sparkSession
    numbered = lambda df: usable(df).withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()})
    base, asked = (stored(numbered(df), name) for df, name in ((vectors, "base"), (queries, "queries")))
    length = F.array_max(F.transform("v", F.abs)) * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(x / F.array_max(F.transform("v", F.abs)), 2)))
    # a row for each length of vectors
    sizes = base.select("dim", length.alias("length")).groupBy("dim").agg(F.count("*").alias("n"), F.max("length").alias("largest"))
    sizes = sizes.join(asked.groupBy("dim").agg(F.count("*").alias("asked")), "dim")
    tasks = spark.sparkContext.defaultParallelism
    sizes = stored(
        sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
        # more groups than their bound asks for only where tasks would be too few; this changes no result
        .withColumn("groups", F.greatest(F.ceil(F.col("asked") / BLOCK_QUERIES), F.least(F.ceil(F.lit(tasks) / F.col("blocks")), F.ceil(F.col("asked") / 64))).cast("int")),
        "sizes",
    )

    def dealt(rows, own, parts, other, others):
        spread = rows.join(sizes.toDF(*sizes.columns), "dim").withColumn(own, F.pmod(F.xxhash64("vec_id", F.lit(own)), F.col(parts)).cast("int"))
        spread = spread.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return spread.select("dim", "block", "group", "row", "vec_id", "v", "n", "largest").groupBy("dim", "block", "group")

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(rows) and len(asked):
            n, largest = rows["n"][0].as_py(), rows["largest"][0].as_py()
            index = BlockIndex(rows["vec_id"].to_numpy(), matrix(rows["v"]), largest * (1 + 1e-9), max(VERIFY, min(1.0, AT_LEAST / n)))
            for row, query_id, query in zip(asked["row"].to_numpy(), asked["vec_id"].to_numpy(), matrix(asked["v"])):
                ids, scores = index.search(query, query_id, k)
                for column, values in zip(out, (np.full(len(ids), row), np.full(len(ids), query_id), ids, scores)):
                    column.append(values)
        return pa.table([np.concatenate(c) for c in out], names=["row", "query_id", "vec_id", "score"])

    found = dealt(base, "block", "blocks", "group", "groups").cogroup(dealt(asked, "group", "groups", "block", "blocks")).applyInArrow(meet, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
