"""A product-quantised bank: a byte per part in place of its components, and exact distances for the few that are returned.

Codebooks: vectors are cut into `parts` equal pieces, and k-means (`prototypes`, a class per part) gives 256 entries or fewer for each, fitted on
at most `SAMPLE` references, those with the smallest hashes of their index. Every reference is coded.

Search: for each query a table of squared distances from its pieces to all entries; a reference's estimate is the sum of `parts` of them
by its code. The `rerank` references of the smallest estimates, ties to the smaller index, are looked up in the exact bank, and the k
nearest of these by exact distance are returned, ties to the smaller index. So what is returned is exact; what may be missed is a
neighbour whose estimate isn't among the `rerank` best. With `rerank` as large as the bank every reference is looked at, whatever its
estimate: the bank meets the queries as in `knn.nearest`, and the result is its.

Codes of up to `BROADCAST_BYTES` go to every task, a sixteenth or less of the bank's own size; more meet the queries in blocks, of which each
passes on its `rerank` best. Vectors of a length that `parts` doesn't divide are an error, as are queries of another length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright import scratch
from framewright.functions import vec
from framewright.operators import knn, prototypes
from framewright.operators.knn_join import best
from framewright.operators.score import as_rows
from framewright.operators.split import hash32
from framewright.shipping import ship

SAMPLE, BROADCAST_BYTES, BLOCK_ROWS, CHUNK, TILE = 20_000, 128 << 20, 500_000, 64, 8192
GUESS = "query long, qid long, y int, ref_index long, estimate double"


class Codebooks:
    """entries[p]: (number of entries, length / parts)."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries, self.parts, self.width = entries, len(entries), sum(e.shape[1] for e in entries)

    def encode(self, x: np.ndarray) -> np.ndarray:
        pieces = x.reshape(len(x), self.parts, -1)
        return np.stack([prototypes.nearest(pieces[:, p], e)[0] for p, e in enumerate(self.entries)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([e[codes[:, p]] for p, e in enumerate(self.entries)], 1)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each part (queries, entries) of squared distances."""
        pieces = q.reshape(len(q), self.parts, -1)
        return [((pieces[:, p, None, :] - e[None]) ** 2).sum(2) for p, e in enumerate(self.entries)]

    def estimates(self, tables: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
        out = tables[0][:, codes[:, 0]].copy()
        for p in range(1, self.parts):
            out += tables[p][:, codes[:, p]]
        return out

    def bytes(self) -> int:
        """Of the codebooks as float32."""
        return sum(e.size * 4 for e in self.entries)


def fit(bank: DataFrame, parts: int = 8, entries: int = 256, rounds: int = 8, seed: int = 42, sample: int = SAMPLE) -> Codebooks:
    """Codebooks of a bank (ref_index, z, label)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    rows = bank.select("ref_index", vec.doubles("z").alias("z")).where(vec.finite(F.col("z"))).orderBy(hash32(seed, "ref_index"), "ref_index").limit(sample)
    widths = [r[0] for r in rows.select(F.size("z")).distinct().limit(2).collect()]
    if len(widths) != 1 or widths[0] % parts:
        raise ValueError(f"vectors of one length that {parts} divides are needed")
    size = widths[0] // parts
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("z", p * size + 1, size))
    pieces = rows.select("ref_index", F.posexplode(cut).alias("label", "z"))
    got = prototypes.fit(pieces, entries, rounds, seed)
    return Codebooks([got.centres[p] for p in range(parts)])


def encode(bank: DataFrame, books: Codebooks) -> DataFrame:
    """(ref_index, label, code) of every reference."""
    ship(bank.sparkSession)
    shared = bank.sparkSession.sparkContext.broadcast(books)
    fits = F.assert_true(F.size("z") == books.width, F.lit("a reference's length isn't the codebooks'")).isNull()
    rows = bank.select(F.col("ref_index").cast("long").alias("ref_index"), F.col("label").cast("int").alias("label"), vec.doubles("z").alias("z")).where(fits)

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                codes = shared.value.encode(as_rows(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["ref_index", "label", "code"])

    return rows.mapInArrow(scan, "ref_index long, label int, code binary")


def _guess(books: Codebooks, keys, q: np.ndarray, codes: np.ndarray, ref: np.ndarray, most: int) -> pa.RecordBatch:
    """The references with the smallest estimates for each query, gathered tile by tile: what is held grows with neither."""
    found: list = []
    for at in range(0, len(q), CHUNK):
        tables = books.tables(q[at : at + CHUNK])
        n = len(tables[0])
        row, pos, guess, worst = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(n, np.inf)
        for first in range(0, len(ref), TILE):
            rough = books.estimates(tables, codes[first : first + TILE])
            cut = worst
            if rough.shape[1] > most and np.isinf(worst).any():
                cut = np.minimum(cut, np.partition(rough, most - 1, 1)[:, most - 1])
            r, c = np.nonzero(rough <= cut[:, None])
            if not len(r):
                continue
            row, pos, guess = np.concatenate([row, r]), np.concatenate([pos, first + c]), np.concatenate([guess, rough[r, c]])
            keep, _ = best(row, ref[pos], guess, most)
            row, pos, guess = row[keep], pos[keep], guess[keep]
            full = np.bincount(row, minlength=n) >= most
            worst[full] = guess[np.searchsorted(row, np.flatnonzero(full), "right") - 1]
        found.append((*(np.asarray(key)[at + row] for key in keys), ref[pos], guess))
    kinds = (np.int64, np.int64, np.int32, np.int64, np.float64)
    columns = zip(*found) if found else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, t), *c]).astype(t)) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in GUESS.split(", ")])


def _codes(column, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def nearest(queries: DataFrame, bank: DataFrame, coded: DataFrame, books: Codebooks, k: int = 1, rerank: int = 100,
            broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query, qid, y, rank, ref_index, label, distance of the k nearest found for `queries` (row_id, label, x). `coded` is `encode(bank)`,
    best written out before."""
    if not 1 <= k <= rerank:
        raise ValueError("k must be at least 1 and at most rerank")
    spark = queries.sparkSession
    ship(spark)
    fits = F.assert_true(F.size("x") == books.width, F.lit("a query's length isn't the codebooks'")).isNull()
    n = coded.count()
    if n <= rerank:
        # every reference is among the `rerank` best, whatever its estimate: all are looked at, block by block, and no pair is written
        held = bank.join(coded.select(F.col("ref_index")), "ref_index", "left_semi")
        return knn.nearest(queries.where(fits), held, k)
    asked = queries.select(F.monotonically_increasing_id().alias("query"), F.col("row_id").alias("qid"), F.col("label").cast("int").alias("y"), vec.doubles("x").alias("x"))
    asked = scratch.written(asked.where(fits), "asked")
    shared = spark.sparkContext.broadcast(books)
    if n * (books.parts + 8) <= broadcast_bytes:
        rows = coded.select("ref_index", "code").toArrow()
        held = spark.sparkContext.broadcast((_codes(rows["code"], books.parts), rows["ref_index"].to_numpy()))

        def scan(batches):
            for batch in batches:
                if batch.num_rows and n:
                    keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                    yield _guess(shared.value, keys, as_rows(batch.column(3)), *held.value, rerank)

        found = asked.mapInArrow(scan, GUESS)
    else:
        parts, groups = math.ceil(n / block_rows), max(1, math.ceil(asked.count() / block_rows))

        def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
            if not len(asked) or not len(held):
                return pa.Table.from_batches([_guess(books, [[], [], []], np.zeros((0, books.width)), np.zeros((0, books.parts), np.uint8), np.zeros(0, np.int64), rerank)])
            keys = [asked[c].to_numpy() for c in ("query", "qid", "y")]
            return pa.Table.from_batches([_guess(shared.value, keys, as_rows(asked["x"].combine_chunks()), _codes(held["code"], books.parts), held["ref_index"].to_numpy(), rerank)])

        left = asked.withColumn("g", F.pmod(F.xxhash64("query"), F.lit(groups))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = coded.withColumn("b", F.pmod(F.xxhash64("ref_index"), F.lit(parts)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        found = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(meet, GUESS)
        place = F.row_number().over(W.partitionBy("query").orderBy("estimate", "ref_index"))
        found = found.withColumn("r", place).where(F.col("r") <= rerank).drop("r")
    # the few that are left meet their exact vectors; how many rows tasks in Python give Spark can't know, so that it must not broadcast them
    exact = bank.select(F.col("ref_index").cast("long").alias("ref_index"), F.col("label").cast("int").alias("label"), vec.doubles("z").alias("z"))
    both = found.hint("merge").join(exact, "ref_index").join(asked.select("query", "x"), "query").withColumn("distance", vec.distance(F.col("x"), F.col("z")))
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "ref_index"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "qid", "y", "rank", "ref_index", "label", "distance")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: of the exact neighbours (qid, ref_index) of all queries, the share that was found."""
    hit = found.select("qid", "ref_index").distinct().withColumn("hit", F.lit(1))
    both = exact.select("qid", "ref_index").distinct().join(hit, ["qid", "ref_index"], "left")
    return both.agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("total"), (F.count("hit") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("recall"))
