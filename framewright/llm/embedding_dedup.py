"""Embedding near-duplicates by a forest of random-projection trees with spill.

Every tree splits recursively at the median of a random projection; vectors near a split go to both sides
(spill), so that a pair within the threshold is rarely parted, and several trees make up for the rest. Pairs are compared in
leaves in double precision, verified, and united.

The first splits are fitted on at most `SAMPLE` vectors (those with the smallest hash of their id), and every vector is placed
by them. Leaves that still hold more than `LEAF` vectors are split further, all of a level at once, by Spark jobs over their
members, so that leaves stay of bounded size however many vectors there are; only what no projection parts, such as one large
cluster, stays together and is compared in pairs of blocks. A tree's spill is as wide as the threshold asks for, but never so wide
that it makes many more than `COPIES` copies of the vectors: up to 100,000 vectors it hardly binds. A pair may meet in many leaves: each row carries all its leaves,
and a pair counts only in the first it shares, so links are counted without listing pairs. A leaf gives out just sums and a
spanning forest of its links.

Equal vectors are one class with a weight from the start. Vectors are compared with those of their own length. Vectors that are
null, empty, zero or have null or non-finite components link with nothing. A pair at the threshold links if its cosine in double
precision isn't below it. Rows that repeat an id with different vectors keep links of each. An empty table gives no row; columns
other than the two named are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, stored
from .components import components
from .vectors import matrix, usable

TREES, LEAF, SAMPLE, SMALLEST, BLOCK, LEVELS = 4, 1500, 20_000, 8, 2048, 40
#: A tree makes this many copies of the vectors at most, whatever its depth: the deeper it has to be, the narrower its spill.
COPIES = 8
#: A split that leaves more than this share of the members on one side is no use.
USELESS = 0.95


class Forest:
    """Trees as arrays of nodes: a direction, a threshold and a spill, or a leaf's number. Its size is bounded by the sample's."""

    def __init__(self, sample: np.ndarray, n: int, spill: float, first_leaf: int, seed: int = 11):
        self.spill = spill
        self.rng = np.random.default_rng(seed)
        self.leaves = first_leaf
        smallest = max(SMALLEST, math.ceil(LEAF * len(sample) / max(n, 1)))
        # the share of a node that may go to both sides: with growth g a level, leaves are reached after log2(n / LEAF) / log2(2 / g) levels
        copies, halvings = math.log2(COPIES), max(1.0, math.log2(max(n, 2) / LEAF))
        self.both = 2 ** (copies / (halvings + copies)) - 1
        self.trees = [self._grow(sample, smallest, 0) for _ in range(TREES)]
        del self.rng

    def _leaf(self) -> int:
        self.leaves += 1
        return self.leaves - 1

    def _grow(self, sample: np.ndarray, smallest: int, depth: int):
        if len(sample) > smallest and depth < LEVELS:
            direction = self.rng.standard_normal(sample.shape[1])
            direction /= np.linalg.norm(direction)
            p = sample @ direction
            cut = float(np.median(p))
            spill = min(self.spill, float(np.quantile(np.abs(p - cut), self.both))) if self.both < 1 else self.spill
            left, right = sample[p <= cut + spill], sample[p >= cut - spill]
            if max(len(left), len(right)) < USELESS * len(sample):
                return direction, cut, spill, self._grow(left, smallest, depth + 1), self._grow(right, smallest, depth + 1)
        return self._leaf()

    def place(self, unit: np.ndarray) -> list[list[int]]:
        """The leaves of each vector in all trees."""
        out: list[list[int]] = [[] for _ in unit]

        def walk(node, rows):
            if isinstance(node, int):
                for r in rows.tolist():
                    out[r].append(node)
                return
            direction, cut, spill, left, right = node
            p = unit[rows] @ direction
            walk(left, rows[p <= cut + spill])
            walk(right, rows[p >= cut - spill])

        for tree in self.trees:
            walk(tree, np.arange(len(unit)))
        return out


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(1, keepdims=True)  # no overflow or underflow in the squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def same_length(batch: pa.RecordBatch, column: int):
    """(rows, unit vectors) of a batch for each length of its vectors."""
    length = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        yield rows, unit_rows(matrix(batch.column(column).take(pa.array(rows))))


def forest_edges(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix."""
    left, edges = links.any(1), []
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        front = np.array([root])
        while len(front):
            reach = links[front] & left
            at = np.flatnonzero(reach.any(0))
            edges += zip(front[np.argmax(reach[:, at], 0)].tolist(), at.tolist())
            left[at] = False
            front = at
    return edges


def leaf_links(leaf: int, rep, weight, block, unit, homes: list, threshold: float, cross: bool):
    """(sums of linked weights, spanning edges) of the pairs that meet first in this leaf. Single precision finds what may
    be close, double precision decides; only rows with such a pair are looked at further."""
    rough, close = unit.astype(np.float32), np.zeros(len(rep), bool)
    for at in range(0, len(rep), 512):
        near = rough[at : at + 512] @ rough.T >= np.float32(threshold - 1e-4)
        near[np.arange(len(near)), np.arange(at, at + len(near))] = False
        if cross:
            near &= block[at : at + 512, None] != block[None, :]
        close[at : at + 512] = near.any(1)
    some = np.flatnonzero(close)
    linked = np.zeros(len(rep), np.int64)
    if not len(some):
        return linked, []
    unit, block, homes = unit[some], block[some], [homes[i] for i in some.tolist()]
    column = {h: i for i, h in enumerate(sorted({h for x in homes for h in x if h < leaf}))}
    earlier = np.zeros((len(some), len(column)), np.float32)
    for r, x in enumerate(homes):
        earlier[r, [column[h] for h in x if h < leaf]] = 1
    links = np.zeros((len(some), len(some)), bool)
    for at in range(0, len(some), 512):
        rows = slice(at, at + 512)
        links[rows] = (unit[rows] @ unit.T >= threshold) & (earlier[rows] @ earlier.T == 0)
        if cross:
            links[rows] &= block[rows, None] != block[None, :]
    links |= links.T
    np.fill_diagonal(links, False)
    linked[some] = links @ weight[some]
    return linked, [(int(some[a]), int(some[b])) for a, b in forest_edges(links)]


PLACED = "rep long, weight long, v array<double>, homes array<long>"


def first_places(classes: DataFrame, threshold: float) -> DataFrame:
    """Classes with their leaves in forests fitted on samples, one forest for each length of vectors with more than a leaf's
    worth of classes; fewer are one leaf."""
    spark = classes.sparkSession
    lengths = classes.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()  # a row for each length that occurs
    forests, leaf = {}, 0
    for dim, n in lengths:
        if n <= LEAF:
            forests[dim], leaf = leaf, leaf + 1
            continue
        sample = classes.where(F.size("v") == dim).select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow()
        # the usual distance along a random direction of two vectors at the threshold
        forests[dim] = Forest(unit_rows(matrix(sample["v"])), n, spill_of(threshold, dim), leaf)
        leaf = forests[dim].leaves
    shared = spark.sparkContext.broadcast(forests)

    def place(batches):
        for batch in batches:
            homes: list = [None] * batch.num_rows
            for rows, unit in same_length(batch, 2):
                forest = shared.value[unit.shape[1]]
                for r, found in zip(rows.tolist(), forest.place(unit) if isinstance(forest, Forest) else [[forest]] * len(rows)):
                    homes[r] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(homes, pa.list_(pa.int64()))], names=["rep", "weight", "v", "homes"])

    return stored(classes.select("rep", "weight", "v").mapInArrow(place, PLACED), "placed")


def spill_of(threshold: float, dim: int) -> float:
    return math.sqrt(max(0.0, 2 - 2 * threshold) / dim)


def split_large(placed: DataFrame, threshold: float) -> DataFrame:
    """Large leaves split in two, level by level, until none is left that a projection parts. A member of a leaf that is split
    exchanges it for one or both of its halves."""
    spark, final = placed.sparkSession, None
    for _ in range(LEVELS):
        sizes = placed.select(F.explode("homes").alias("leaf")).groupBy("leaf").count().where(F.col("count") > LEAF).select("leaf")
        large = sizes if final is None else sizes.join(final, "leaf", "left_anti")
        large = stored(large, "large-leaves")
        if large.isEmpty():
            break
        members = placed.select("rep", "v", F.explode("homes").alias("leaf")).join(large, "leaf")

        def project(batches):
            directions: dict = {}
            for batch in batches:
                leaf, p = batch.column(0).to_pylist(), np.zeros(batch.num_rows)
                for rows, unit in same_length(batch, 2):
                    dim = unit.shape[1]
                    of = np.array([leaf[r] for r in rows.tolist()])
                    for one in np.unique(of):
                        if (one, dim) not in directions:
                            if len(directions) > 4096:
                                directions.clear()
                            d = np.random.default_rng([int(one) & (1 << 63) - 1, dim]).standard_normal(dim)
                            directions[one, dim] = d / np.linalg.norm(d)
                        here = of == one
                        p[rows[here]] = unit[here] @ directions[one, dim]
                spill = [spill_of(threshold, n) for n in batch.column(2).value_lengths().to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array(spill)], names=["leaf", "rep", "p", "spill"])

        at = stored(members.select("leaf", "rep", "v").mapInArrow(project, "leaf long, rep long, p double, spill double"), "projections")
        cuts = at.groupBy("leaf").agg(F.percentile_approx("p", 0.5, 1000).alias("cut"))
        sides = at.join(cuts, "leaf").select("leaf", "rep", (F.col("p") <= F.col("cut") + F.col("spill")).alias("left"), (F.col("p") >= F.col("cut") - F.col("spill")).alias("right"))
        sides = stored(sides, "sides")
        share = [F.sum(F.col(side).cast("long")) / F.count("*") for side in ("left", "right")]
        useless = sides.groupBy("leaf").agg(F.greatest(*share).alias("most")).where(F.col("most") >= USELESS).select("leaf")
        final = stored(useless if final is None else useless.unionByName(final), "final-leaves")
        halves = F.array_compact(F.array(*(F.when(F.col(side), F.xxhash64("leaf", F.lit(side))) for side in ("left", "right"))))
        changed = sides.join(final, "leaf", "left_anti").groupBy("rep").agg(F.collect_set("leaf").alias("gone"), F.flatten(F.collect_list(halves)).alias("come"))
        homes = F.when(F.col("gone").isNull(), F.col("homes")).otherwise(F.array_union(F.array_except("homes", "gone"), "come"))
        new = stored(placed.join(changed, "rep", "left").select("rep", "weight", "v", homes.alias("homes")), "placed")
        for old in (placed, large, at, sides):
            drop_shared(spark, old._stored_at)
        placed = new
    return placed


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable), kept."""
    rows = stored(usable(vectors, id_col, vector_col), "vectors")
    # -0.0 and 0.0 are equal components, but not equal keys
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    classes = stored(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    # an id may stand for several vectors: classes get a number of their own
    classes = stored(classes.withColumn("id", F.col("rep")).withColumn("rep", F.monotonically_increasing_id()), "numbered")
    placed = split_large(first_places(classes, threshold), threshold)
    sizes = placed.select(F.explode("homes").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        placed.withColumn("leaf", F.explode("homes")).join(sizes, "leaf")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
        .select("leaf", "i", "j", "block", "rep", "weight", "v", "homes")
    )

    def compare(rows: pa.Table) -> pa.Table:
        rep, block = rows["rep"].to_numpy(), rows["block"].to_numpy()
        leaf, cross = rows["leaf"][0].as_py(), rows["i"][0].as_py() != rows["j"][0].as_py()
        linked, edges = leaf_links(leaf, rep, rows["weight"].to_numpy(), block, unit_rows(matrix(rows["v"])), rows["homes"].to_pylist(), threshold, cross)
        some = np.flatnonzero(linked)
        u = [*rep[some].tolist(), *(int(rep[a]) for a, _ in edges)]
        v = [*[None] * len(some), *(int(rep[b]) for _, b in edges)]
        n = [*linked[some].tolist(), *[0] * len(edges)]
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "n"])

    met = stored(dealt.groupBy("leaf", "i", "j").applyInArrow(compare, "u long, v long, n long"), "met")
    linked = met.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    # rows of one id are linked through it, whatever their vectors
    owners = rows.join(classes.select("v", "rep"), "v").select("vec_id", "rep").distinct()
    shared = owners.groupBy("vec_id").agg(F.min("rep").alias("u"), F.max("rep").alias("top")).where("u < top").select("vec_id", "u")
    same_id = shared.join(owners, "vec_id").where("rep > u").select("u", F.col("rep").alias("v"))
    found = stored(components(met.where("v is not null").select("u", "v").unionByName(same_id)), "components")
    of_class = classes.join(linked, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = stored(of_class.select("v", "id", F.coalesce("n", F.lit(0)).alias("n"), "weight", F.coalesce("component", "rep").alias("component")), "linked")
    smallest = of_class.groupBy("component").agg(F.min("id").alias("component_id"))
    named = of_class.join(smallest, "component").select("v", "n", "weight", "component_id")
    own = rows.join(named, "v").groupBy("vec_id").agg(F.max(F.col("n") + F.col("weight") - 1).alias("n_links"), F.min("component_id").alias("component_id"))
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    return every.join(own, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
