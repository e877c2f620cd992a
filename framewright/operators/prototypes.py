"""Several prototypes a class: k-means within every class of a bank, all classes in one job a round.

First centres come by k-means|| (oversampling): from one reference a class, every round draws references with a chance in proportion to their
squared distance to the centres so far, about 2 `per_class` a class; what was drawn, weighted by the references nearest to it, is
reduced to `per_class` by weighted k-means++ on the driver. Draws are decided by a hash of seed, round and index. Then Lloyd's rounds:
tasks send sums and counts per class and centre, which Spark adds up by position; the driver gets classes x centres x length numbers.

A centre without references stays where it is. Of equally near centres the one with the smaller number wins. A class with fewer
references than `per_class` has as many centres; references with a null label or vector, or with non-finite components, take no part;
repeated ones count each. An empty bank gives none. The centres of all classes must fit `BROADCAST_BYTES`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright import scratch
from framewright.functions import vec
from framewright.operators.score import as_rows
from framewright.operators.split import hash32
from framewright.schema import BANK
from framewright.shipping import ship

BROADCAST_BYTES = 64 << 20
DRAWS, OVERSAMPLING = 3, 2


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centre; from differences, so that equal centres are equally near."""
    best, least = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for j, c in enumerate(centres):
        d = ((x - c) ** 2).sum(1)
        closer = d < least
        best[closer], least[closer] = j, d[closer]
    return best, least


def _checked(centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    if sum(c.nbytes for c in centres.values()) > BROADCAST_BYTES:
        raise ValueError("the classes' centres don't fit a broadcast: fewer classes or fewer prototypes")
    return centres


def _by_label(batch: pa.RecordBatch):
    """(label, rows, vectors) of a batch (label, z, ...)."""
    label = batch.column(0).to_numpy(zero_copy_only=False)
    x = as_rows(batch.column(1)) if batch.num_rows else None
    for one in np.unique(label).tolist():
        rows = np.flatnonzero(label == one)
        yield one, rows, x[rows]


def assigned_sums(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """(label, centre, n, cost, total) per task: references nearest to the centre, their squared distances and their sum."""
    shared = rows.sparkSession.sparkContext.broadcast(_checked(centres))

    def scan(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for label, _, x in _by_label(batch):
                own = shared.value[label]
                n, cost, total = sums.setdefault(label, [np.zeros(len(own), np.int64), np.zeros(len(own)), np.zeros(own.shape)])
                best, d = nearest(x, own)
                n += np.bincount(best, minlength=len(own))
                cost += np.bincount(best, weights=d, minlength=len(own))
                np.add.at(total, best, x)
        for label, (n, cost, total) in sums.items():
            used = np.flatnonzero(n)
            columns = [pa.array(np.full(len(used), label), pa.int32()), pa.array(used, pa.int32()), pa.array(n[used]), pa.array(cost[used]), pa.array(list(total[used]), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "centre", "n", "cost", "total"])

    return rows.select("label", "z").mapInArrow(scan, "label int, centre int, n long, cost double, total array<double>")


def _moved(rows: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Every centre that has references, moved to their mean."""
    parts = assigned_sums(rows, centres).select("label", "centre", "n", F.posexplode("total").alias("pos", "v"))
    sums = parts.groupBy("label", "centre", "pos").agg((F.sum("v") / F.sum("n")).alias("mean")).toArrow()
    new = {label: c.copy() for label, c in centres.items()}
    for label, centre, pos, mean in zip(*(sums[c].to_pylist() for c in ("label", "centre", "pos", "mean"))):
        new[label][centre, pos] = mean
    return new


def first_by_hash(rows: DataFrame, per_class: int, seed: int = 42) -> dict[int, np.ndarray]:
    """The references of each class with the smallest hashes of their index."""
    rank = F.row_number().over(W.partitionBy("label").orderBy(hash32(seed, "ref_index"), "ref_index"))
    top = rows.select("label", "z", rank.alias("r")).where(F.col("r") <= per_class).orderBy("label", "r").collect()
    found: dict[int, list] = {}
    for r in top:
        found.setdefault(r["label"], []).append(r["z"])
    return {label: np.array(z) for label, z in found.items()}


def _plus_plus(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of weighted points, each drawn in proportion to weight and squared distance to those before."""
    chosen = [int(rng.choice(len(points), p=weight / weight.sum()))]
    least = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(points)):
        chance = weight * least
        if not chance.sum() > 0:
            rest = np.setdiff1d(np.arange(len(points)), chosen)  # all others equal a chosen one
            chosen += rest[: min(k, len(points)) - len(chosen)].tolist()
            break
        chosen.append(int(rng.choice(len(points), p=chance / chance.sum())))
        least = np.minimum(least, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def oversampled(rows: DataFrame, per_class: int, seed: int = 42, draws: int = DRAWS) -> dict[int, np.ndarray]:
    """First centres by k-means||."""
    spark = rows.sparkSession
    centres = first_by_hash(rows, 1, seed)
    for draw in range(draws):
        cost = {r["label"]: r["cost"] for r in assigned_sums(rows, centres).groupBy("label").agg(F.sum("cost").alias("cost")).collect()}
        shared = spark.sparkContext.broadcast((_checked(centres), cost))

        def sample(batches):
            for batch in batches:
                kept = []
                for label, at, x in _by_label(batch):
                    centres, cost = shared.value
                    if cost[label] > 0:
                        chance = OVERSAMPLING * per_class * nearest(x, centres[label])[1] / cost[label]
                        kept.append(at[batch.column(2).to_numpy(zero_copy_only=False)[at] < chance])
                if kept:
                    yield batch.take(pa.array(np.sort(np.concatenate(kept)))).select(["label", "z"])

        u = hash32(seed * 1_000_003 + draw + 1, "ref_index") / float(1 << 32)
        drawn = rows.select("label", "z", u.alias("u")).mapInArrow(sample, "label int, z array<double>").collect()
        more: dict[int, list] = {}
        for r in drawn:
            more.setdefault(r["label"], []).append(r["z"])
        centres = {label: np.unique(np.concatenate([c, np.array(more[label])]), axis=0) if label in more else c for label, c in centres.items()}
    weight = {label: np.zeros(len(c)) for label, c in centres.items()}
    for r in assigned_sums(rows, centres).groupBy("label", "centre").agg(F.sum("n").alias("n")).collect():
        weight[r["label"]][r["centre"]] = r["n"]
    return {label: _plus_plus(c, np.maximum(weight[label], 1e-9), per_class, np.random.default_rng([seed, label & 0xFFFFFFFF])) for label, c in centres.items()}


class Prototypes:
    """Centres by class, the rounds made and the cost after the last: summed squared distances to the nearest centre."""

    def __init__(self, centres: dict[int, np.ndarray], rounds: int):
        self.centres, self.rounds = centres, rounds

    def bank(self, spark, normalize: bool = False) -> DataFrame:
        """(ref_index, z, label), numbered by class and centre."""
        rows = [(label, z) for label in sorted(self.centres) for z in self.centres[label].tolist()]
        made = spark.createDataFrame([(i, z, label) for i, (label, z) in enumerate(rows)], BANK)
        return made.withColumn("z", vec.scaled_to_unit(F.col("z"))) if normalize else made

    def cost(self, bank: DataFrame) -> float:
        return assigned_sums(_taking_part(bank), self.centres).agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]


def _taking_part(bank: DataFrame) -> DataFrame:
    rows = bank.select(F.col("ref_index").cast("long").alias("ref_index"), F.col("label").cast("int").alias("label"), vec.doubles("z").alias("z"))
    return rows.where(F.col("label").isNotNull() & vec.finite(F.col("z")))


def fit(bank: DataFrame, per_class: int, rounds: int = 10, seed: int = 42, initial: str = "oversampled") -> Prototypes:
    """Prototypes of a bank (ref_index, z, label) after `rounds` rounds at most, fewer if nothing moves any more. `initial`: `oversampled`
    for k-means||, `hash` for the references with the smallest hashes."""
    if per_class < 1 or initial not in ("oversampled", "hash"):
        raise ValueError("at least one prototype a class; initial must be oversampled or hash")
    ship(bank.sparkSession)
    rows = scratch.written(_taking_part(bank), "prototypes")
    centres = _checked((oversampled if initial == "oversampled" else first_by_hash)(rows, per_class, seed))
    made = 0
    while made < rounds and centres:
        new, made = _moved(rows, centres), made + 1
        still = all(np.array_equal(new[label], centres[label]) for label in centres)
        centres = new
        if still:
            break
    scratch.drop(rows)
    return Prototypes(centres, made)
