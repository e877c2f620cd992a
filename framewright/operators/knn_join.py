"""Exact k-nearest-neighbour join that leaves cells of the bank out.

Pivots, about as many as the square root of the bank's rows and bounded in bytes, cut the space into Voronoi cells. Every reference and
every query goes to its nearest pivot's cell; of a cell only its number of rows, the range of distances to its pivot and the k smallest
of them are gathered.

Round 1 bounds each query's k-th distance: by d(query, pivot) + d(pivot, reference) over the gathered distances, and by the k-th
distance that it finds in its own cell. Round 2 visits a further cell only if the triangle inequality leaves room below that bound:
with p the query's distance to the cell's pivot and [low, high] the cell's range, every reference there is at least
max(p - high, low - p) away and, as it is nearer to its own pivot than to that of the query's cell, at least
(p^2 - own^2) / (2 d(pivot, own pivot)). Bounds are loosened by 1e-7 of the largest length, so that rounding never closes a cell.

Cells that lie together share a block of about `BLOCK_ROWS` references; a larger cell is dealt over several. A unit of work is a block and at
most about `QUERY_ROWS` of the queries that visit it: where more do, they are dealt over several units, each with a copy of the block. So no
task holds more than that, whichever cell is hot. A query goes once to each block with a cell that it visits, not to each cell.

Distances are those of `knn.nearest` (the survivors' are computed exactly from the differences), ties go to the smaller ref_index,
queries that repeat an id are answered each, and an empty bank or no queries give no row.
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
from framewright.operators.score import as_rows
from framewright.operators.split import hash32
from framewright.shipping import ship

PIVOT_BYTES = 16 << 20
BLOCK_ROWS, QUERY_ROWS = 20_000, 20_000
CHUNK = 256
#: References that a chunk of queries meets at once (4 MB of rough distances), and pairs whose exact distances are computed at once.
TILE_ROWS, PAIRS = 2048, 1 << 15
#: Blocks up to which their counts of visits are sent to all tasks (16 MB).
BROADCAST_BLOCKS = 1_000_000
LOOSE = 1e-9
FOUND = "query long, qid long, y int, ref_index long, label int, distance double"


class Cells:
    """What all tasks know of the cells."""

    def __init__(self, pivots: np.ndarray, k: int, reach: float):
        """`reach`: the largest squared length of a reference."""
        n, self.reach = len(pivots), reach
        self.pivots, self.k = pivots, k
        self.square = (pivots * pivots).sum(1)
        self.size = np.zeros(n, np.int64)
        self.low, self.high = np.full(n, np.inf), np.full(n, -np.inf)
        self.near = np.full((n, k), np.inf)
        self.first, self.blocks = np.zeros(n, np.int64), np.ones(n, np.int64)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """To all pivots, up to `slack`."""
        d = (x * x).sum(1)[:, None] - 2 * x @ self.pivots.T + self.square
        return np.sqrt(np.maximum(d, 0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, exact distance to its pivot). Which of nearly equal pivots is taken doesn't matter: a cell's range covers what
        it holds, and `lower` allows for the rounding."""
        cell = self.distances(x).argmin(1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(1))

    def upper(self, d: np.ndarray) -> np.ndarray:
        """For each row of distances to the pivots a bound on the k-th distance: of all d(query, pivot) + d(pivot, reference) that
        the cells' nearest references give, the k-th smallest. Infinite with fewer than k references."""
        m = min(d.shape[1], 4 * self.k + 4)
        at = np.argpartition(d, m - 1, 1)[:, :m] if m < d.shape[1] else np.tile(np.arange(m), (len(d), 1))
        sums = (np.take_along_axis(d, at, 1)[:, :, None] + self.near[at]).reshape(len(d), -1)
        return np.partition(sums, self.k - 1, 1)[:, self.k - 1]

    def lower(self, d: np.ndarray, cell: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """A bound from below on the distance of each row to each cell's references; `slack`: a row's rounding."""
        own = np.take_along_axis(d, cell[:, None], 1)
        between = np.sqrt(np.maximum(self.square[cell][:, None] - 2 * self.pivots[cell] @ self.pivots.T + self.square, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(between > 0, ((d - slack[:, None]) ** 2 - (own + slack[:, None]) ** 2) / (2 * between + 2 * slack[:, None]), -np.inf)
        plane = np.where(d > slack[:, None], plane, -np.inf)
        return np.maximum(plane, np.maximum(d - self.high, self.low - d)) - slack[:, None]

    def slack(self, x: np.ndarray) -> np.ndarray:
        """How far distances by products, and the choice of the nearest pivot by them, can be off: the root of the squares' rounding,
        which is far below 1e-14 of the largest square."""
        return np.sqrt((x * x).sum(1) + self.reach) * 1e-7

    def place(self, block_rows: int) -> None:
        """Blocks: cells halved along their pivots' widest direction until a half fits; a cell that doesn't fit is dealt out."""
        at, stack = 0, [np.flatnonzero(self.size)]
        while stack:
            own = stack.pop()
            total = int(self.size[own].sum())
            if not len(own):
                continue
            if total <= block_rows or len(own) == 1:
                n = max(1, -(-total // block_rows))
                self.first[own], self.blocks[own] = at, n
                at += n
                continue
            p = self.pivots[own]
            order = np.argsort(p[:, p.var(0).argmax()], kind="stable")
            half = np.searchsorted(np.cumsum(self.size[own][order]), total / 2)
            half = min(max(int(half), 1), len(own) - 1)
            stack += [own[order[half:]], own[order[:half]]]
        self.n_blocks = at


def within(q: np.ndarray, z: np.ndarray, ref: np.ndarray, limit: np.ndarray, k: int):
    """(row of q, row of z, distance) of a query's k nearest here, no farther than its limit. References are met tile by tile, so that what is
    held grows neither with them nor with how many of them are copies of one another."""
    square, out = (z * z).sum(1), []
    for at in range(0, len(q), CHUNK):
        part, most = q[at : at + CHUNK], limit[at : at + CHUNK]
        norm, kth = (part * part).sum(1), most.copy()
        loose = LOOSE * (1 + norm + square.max(initial=0))
        row, pos, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for first in range(0, len(z), TILE_ROWS):
            tile = slice(first, first + TILE_ROWS)
            rough = part @ z[tile].T
            rough *= -2
            rough += norm[:, None]
            rough += square[tile]
            cut = kth * kth * (1 + LOOSE) + loose
            if not first and rough.shape[1] > k:
                cut = np.minimum(cut, np.partition(rough, k - 1, 1)[:, k - 1] + 2 * loose)
            r, c = np.nonzero(rough <= cut[:, None])
            if not len(r):
                continue
            c += first
            d = np.concatenate([np.sqrt(((z[c[i : i + PAIRS]] - part[r[i : i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(r), PAIRS)])
            good = d <= most[r]
            row, pos, dist = np.concatenate([row, r[good]]), np.concatenate([pos, c[good]]), np.concatenate([dist, d[good]])
            keep, _ = best(row, ref[pos], dist, k)
            row, pos, dist = row[keep], pos[keep], dist[keep]
            full = np.flatnonzero(np.bincount(row, minlength=len(part)) >= k)
            kth[full] = dist[np.searchsorted(row, full, "right") - 1]
        out.append((row + at, pos, dist))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def best(row: np.ndarray, ref: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of each row's k nearest, by row, distance and then index; their ranks from 0)."""
    order = np.lexsort((ref, d, row))
    ordered = row[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k], rank[rank < k]


class KnnJoin:
    """`neighbours`: query, qid, y, rank, ref_index, label, distance. `work`: what was visited."""

    def __init__(self, neighbours: DataFrame, visits: DataFrame, n_refs: int, n_pivots: int):
        self.neighbours, self._visits, self.n_refs, self.n_pivots = neighbours, visits, n_refs, n_pivots

    def work(self) -> DataFrame:
        """One row: queries, references, pivots, and the share of all pairs that lie in visited cells."""
        sums = self._visits.groupBy("query").agg(F.sum("pairs").alias("pairs"))
        share = F.sum("pairs") / F.greatest(F.count(F.lit(1)) * self.n_refs, F.lit(1))
        return sums.agg(F.count(F.lit(1)).alias("n_queries"), F.lit(self.n_refs).cast("long").alias("n_refs"), F.lit(self.n_pivots).cast("int").alias("n_pivots"), share.alias("visited"))


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "ref_index"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _meet(visits: DataFrame, refs: DataFrame, k: int, query_rows: int) -> DataFrame:
    """FOUND: for every visit (query, qid, y, x, limit, block, cells) the references of its cells in that block within its limit, k at
    most for a query and unit."""
    counts = scratch.written(visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("units")), "units")
    units = F.broadcast(counts) if counts.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS else counts
    asked = visits.join(units, "block").withColumn("unit", F.pmod(F.xxhash64("query"), F.col("units").cast("long")).cast("int"))
    held = refs.join(units, "block").withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        names, kinds = [f.split()[0] for f in FOUND.split(", ")], (np.int64, np.int64, np.int32, np.int64, np.int32, np.float64)
        rows: list = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(asked) and len(held):
            q, z = (as_rows(t[c].combine_chunks()) for t, c in ((asked, "x"), (held, "z")))
            of, ref, limit = held["cell"].to_numpy(), held["ref_index"].to_numpy(), asked["limit"].to_numpy()
            order = np.argsort(of, kind="stable")
            cells, start = np.unique(of[order], return_index=True)
            lists = asked["cells"].combine_chunks()
            wanted = lists.flatten().to_numpy()
            who = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            by_cell = np.argsort(wanted, kind="stable")
            wanted, who = wanted[by_cell], who[by_cell]
            for cell, a, b in zip(cells.tolist(), start.tolist(), [*start[1:].tolist(), len(of)]):
                lo, hi = np.searchsorted(wanted, [cell, cell + 1])
                if lo < hi:
                    rows_q, rows_z = who[lo:hi], order[a:b]
                    r, c, d = within(q[rows_q], z[rows_z], ref[rows_z], limit[rows_q], k)
                    for column, values in zip(rows, (rows_q[r], rows_z[c], d)):
                        column.append(values)
        r, c, d = (np.concatenate(column) for column in rows)
        ref = held["ref_index"].to_numpy()[c] if len(c) else np.zeros(0, np.int64)
        keep, _ = best(r, ref, d, k)
        r, c = r[keep], c[keep]
        values = [asked[n].to_numpy()[r] for n in ("query", "qid", "y")] + [held[n].to_numpy()[c] for n in ("ref_index", "label")] + [d[keep]]
        return pa.table([np.asarray(v).astype(t) for v, t in zip(values, kinds)], names=names)

    left = asked.select("query", "qid", "y", "x", "limit", "cells", "block", "unit")
    right = held.select("ref_index", "z", "label", "cell", "block", "unit")
    return left.groupBy("block", "unit").cogroup(right.groupBy("block", "unit")).applyInArrow(meet, FOUND)


def nearest_by_cells(queries: DataFrame, bank: DataFrame, k: int = 1, normalize: bool = False, pivots: int | None = None, seed: int = 42,
                     block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> KnnJoin | None:
    """The k nearest references (all, if fewer) of `queries` (row_id, label, x) in `bank` (ref_index, z, label), by Euclidean distance, of
    unit vectors if `normalize`. None for an empty bank. Vectors of another length than the bank's are an error."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = queries.sparkSession
    ship(spark)
    unit = vec.scaled_to_unit if normalize else (lambda v: v)
    held = bank.select(F.col("ref_index").cast("long").alias("ref_index"), unit(vec.doubles("z")).alias("z"), F.col("label").cast("int").alias("label"))
    n, lo, hi, reach = held.agg(F.count(F.lit(1)), F.min(F.size("z")), F.max(F.size("z")), F.max(vec.dot(F.col("z"), F.col("z")))).first()
    if n == 0:
        return None
    if lo != hi:
        raise ValueError("bank vectors differ in length")
    asked = queries.select(F.monotonically_increasing_id().alias("query"), F.col("row_id").alias("qid"), F.col("label").cast("int").alias("y"), unit(vec.doubles("x")).alias("x"))
    asked = asked.where(F.assert_true(F.size("x") == lo, F.lit("a query's length differs from the bank's")).isNull())

    # pivots: references with the smallest hashes, equal ones once
    many = min(pivots or math.ceil(math.sqrt(n)), max(1, PIVOT_BYTES // (8 * max(lo, 1))))
    chosen = held.orderBy(hash32(seed, "ref_index"), "ref_index").limit(many).select("z").toArrow().combine_chunks()["z"]
    cells = Cells(np.unique(as_rows(chosen.combine_chunks() if isinstance(chosen, pa.ChunkedArray) else chosen), axis=0), k, reach)
    first = spark.sparkContext.broadcast(cells)

    def settle(batches):
        """References with their cell and distance to its pivot."""
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                cell, radius = first.value.nearest(as_rows(part.column(1)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(radius)], names=["ref_index", "z", "label", "cell", "radius"])

    refs = scratch.written(held.mapInArrow(settle, "ref_index long, z array<double>, label int, cell int, radius double"), "refs")

    def ranges(batches):
        """Of each cell in the task: rows, range and k smallest distances."""
        known = first.value
        size, low, high, near = known.size.copy(), known.low.copy(), known.high.copy(), known.near.copy()
        for batch in batches:
            cell, radius = (batch.column(i).to_numpy() for i in (0, 1))
            order = np.lexsort((radius, cell))
            of, start, n = np.unique(cell[order], return_index=True, return_counts=True)
            size[of] += n
            for c, a, m in zip(of.tolist(), start.tolist(), n.tolist()):
                own = radius[order[a : a + m]]
                low[c], high[c] = min(low[c], own[0]), max(high[c], own[-1])
                near[c] = np.sort(np.concatenate([near[c], own[:k]]))[:k]
        used = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(size[used]), pa.array(low[used]), pa.array(high[used]), pa.array(list(near[used]), pa.list_(pa.float64()))], names=["cell", "n", "low", "high", "near"])

    by_task = refs.select("cell", "radius").mapInArrow(ranges, "cell int, n long, low double, high double, near array<double>")
    smallest = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    # a row of k + 4 numbers for each pivot
    for r in by_task.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), smallest.alias("near")).collect():
        c = r["cell"]
        cells.size[c], cells.low[c], cells.high[c] = r["n"], r["low"], r["high"]
        cells.near[c] = r["near"]
    cells.place(block_rows)
    shared = spark.sparkContext.broadcast(cells)

    def block_of(batches):
        """A reference's block: its cell's, or one of several by a hash of its index."""
        for batch in batches:
            known, cell, ref = shared.value, batch.column(3).to_numpy(), batch.column(0).to_numpy(zero_copy_only=False)
            spread = (ref.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = known.first[cell] + (spread % known.blocks[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=["ref_index", "z", "label", "cell", "block"])

    placed = refs.select("ref_index", "z", "label", "cell").mapInArrow(block_of, "ref_index long, z array<double>, label int, cell int, block long")

    def visits_of(known: Cells, keys: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, limit: np.ndarray):
        """A row for each query and block: `row` and `cell` are pairs to be visited, sorted by row."""
        times = known.blocks[cell]
        row, cell = np.repeat(row, times), np.repeat(cell, times)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        block, pairs = known.first[cell] + offset, known.size[cell] / known.blocks[cell]
        order = np.lexsort((cell, block, row))
        row, block, cell, pairs = row[order], block[order], cell[order], pairs[order]
        start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])) if len(row) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)), pa.int32()), pa.array(cell, pa.int32()))
        taken = [keys.column(i).take(pa.array(row[start])) for i in range(4)]
        total = np.add.reduceat(pairs, start) if len(start) else np.zeros(0)
        return pa.RecordBatch.from_arrays([*taken, pa.array(limit[row[start]]), pa.array(block[start]), lists, pa.array(total)], names=["query", "qid", "y", "x", "limit", "block", "cells", "pairs"])

    visit_schema = "query long, qid long, y int, x array<double>, limit double, block long, cells array<int>, pairs double"

    def own_cells(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part, known = batch.slice(at, CHUNK), shared.value
                x = as_rows(part.column(3))
                limit = known.upper(known.distances(x) + known.slack(x)[:, None]) * (1 + LOOSE)
                yield visits_of(known, part, np.arange(len(x)), known.nearest(x)[0], limit)

    asked = scratch.written(asked, "queries")
    home = scratch.written(asked.mapInArrow(own_cells, visit_schema), "home-visits")
    own = scratch.written(_top(_meet(home, placed, k, query_rows), k).drop("rank"), "own-neighbours")
    bounds = own.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).where(F.col("n") >= k).select("query", "far")
    upper = home.groupBy("query").agg(F.first("limit").alias("limit"))
    limited = asked.join(upper, "query").join(bounds, "query", "left").select("query", "qid", "y", "x", F.least("limit", "far").alias("limit"))

    def other_cells(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part, known = batch.slice(at, CHUNK), shared.value
                x, limit = as_rows(part.column(3)), part.column(4).to_numpy()
                cell = known.nearest(x)[0]
                possible = known.lower(known.distances(x), cell, known.slack(x)) <= (limit * (1 + LOOSE))[:, None]
                possible[:, known.size == 0] = False
                possible[np.arange(len(x)), cell] = False
                yield visits_of(known, part, *np.nonzero(possible), limit)

    away = scratch.written(limited.mapInArrow(other_cells, visit_schema), "visits")
    found = own.unionByName(_meet(away, placed, k, query_rows))
    neighbours = _top(found, k).select("query", "qid", "y", "rank", "ref_index", "label", "distance")
    return KnnJoin(neighbours, home.select("query", "pairs").unionByName(away.select("query", "pairs")), n, len(cells.pivots))
