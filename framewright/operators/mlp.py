"""Multilayer perceptrons: as joins and sums over a weight table, and as an Arrow kernel. `training` trains them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.vec import doubles
from framewright.operators import versions
from framewright.operators.score import as_rows
from framewright.shipping import ship


#: Weights of a layer that a join may broadcast (24 MB).
BROADCAST_WEIGHTS = 1_000_000


class Mlp:
    """Dense layers with ReLU between them and none after the last. weights[l]: (out, in)."""

    def __init__(self, weights: list[np.ndarray], biases: list[np.ndarray]):
        self.weights, self.biases = [np.asarray(w, float) for w in weights], [np.asarray(b, float) for b in biases]

    def forward(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            x = x @ w.T + b
            if i + 1 < len(self.weights):
                x = np.maximum(x, 0)
        return x

    def digest(self) -> str:
        """Identifies the weights, so that a bank can say which encoder made it."""
        h = hashlib.sha256()
        for a in (*self.weights, *self.biases):
            h.update(np.ascontiguousarray(a, "<f8").tobytes())
        return h.hexdigest()

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(layer, out, pos, w) and (layer, out, b)."""
        w = [(i, o, p, float(v)) for i, m in enumerate(self.weights) for (o, p), v in np.ndenumerate(m)]
        b = [(i, o, float(v)) for i, m in enumerate(self.biases) for o, v in enumerate(m)]
        return spark.createDataFrame(w, "layer int, out int, pos int, w double"), spark.createDataFrame(b, "layer int, out int, b double")

    @staticmethod
    def from_tables(weights: DataFrame, biases: DataFrame) -> Mlp:
        w, b = weights.toPandas(), biases.toPandas()
        layers = sorted(b["layer"].unique())
        return Mlp(
            [w[w["layer"] == i].pivot(index="out", columns="pos", values="w").to_numpy() for i in layers],
            [b[b["layer"] == i].sort_values("out")["b"].to_numpy() for i in layers],
        )


def by_rule(sizes: list[int]) -> Mlp:
    """Weights from a formula that SQL can repeat: ((7 i + 13 o) mod 11 - 5) / 11, biases (o mod 3 - 1) / 10."""
    weights = [((7 * np.arange(n_in)[None, :] + 13 * np.arange(n_out)[:, None]) % 11 - 5) / 11 for n_in, n_out in zip(sizes, sizes[1:])]
    return Mlp(weights, [(np.arange(n) % 3 - 1) / 10 for n in sizes[1:]])


def apply(frames: DataFrame, model: Mlp, x: str = "x", out: str = "z") -> DataFrame:
    """Frames with `out`, the network's output for `x`. The weights, of a size that data doesn't change, are broadcast."""
    ship(frames.sparkSession)
    shared, keep = frames.sparkSession.sparkContext.broadcast(model), [c for c in frames.columns if c != out]

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                values = shared.value.forward(as_rows(batch.column(batch.num_columns - 1)))
                arrays = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), values.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], arrays], names=[*keep, out])

    rows = frames.select(*keep, doubles(x).alias("__input"))
    return rows.mapInArrow(scan, frames.select(*keep).schema.add(out, T.ArrayType(T.DoubleType())))


def apply_iq(frames: DataFrame, model: Mlp, re: str = "re", im: str = "im", out: str = "z") -> DataFrame:
    """The network's output for complex frames given as two real vectors, which are stacked."""
    return apply(frames.withColumn("x", F.concat(doubles(re), doubles(im))), model, "x", out).drop("x")


def dense_by_join(values: DataFrame, weights: DataFrame, biases: DataFrame, layer: int, relu: bool) -> DataFrame:
    """One layer on rows (row_id, pos, v): an equi-join on the position and a sum by output."""
    w, b = (t.where(F.col("layer") == layer).drop("layer") for t in (weights, biases))
    # one layer's weights: a shuffle join where they are too many to send to every task
    small = w.limit(BROADCAST_WEIGHTS + 1).count() <= BROADCAST_WEIGHTS
    sums = values.join(F.broadcast(w) if small else w, "pos").groupBy("row_id", "out").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    v = F.col("s") + F.col("b")
    return sums.join(F.broadcast(b) if small else b, "out").select("row_id", F.col("out").alias("pos"), (F.greatest(v, F.lit(0.0)) if relu else v).alias("v"))


def apply_by_join(frames: DataFrame, model: Mlp) -> DataFrame:
    """(row_id, pos, v) of the network's output, by joins only."""
    weights, biases = model.tables(frames.sparkSession)
    values = frames.select("row_id", F.posexplode(doubles("x")).alias("pos", "v"))
    for layer in range(len(model.weights)):
        values = dense_by_join(values, weights, biases, layer, layer + 1 < len(model.weights))
    return values


def save(model: Mlp, spark: SparkSession, path: str, **config) -> None:
    """A checkpoint: tables of weights and biases and the run's settings, published together as a new version of `path`."""
    weights, biases = model.tables(spark)
    tables = {"weights": weights.coalesce(1), "biases": biases.coalesce(1)}
    versions.publish(spark, path, tables, config | {"sha256": model.digest()})


def load(spark: SparkSession, path: str) -> tuple[Mlp, dict]:
    """The network of the latest checkpoint, if its weights are those that were saved, and its settings."""
    version = versions.current(spark, path)
    model, config = Mlp.from_tables(version.table("weights"), version.table("biases")), dict(version.manifest)
    if config.pop("sha256") != model.digest():
        raise ValueError(f"the checkpoint at {path} isn't whole")
    return model, config


def best_so_far(epochs: DataFrame) -> DataFrame:
    """Epochs with `improved`: strictly better than every one before. The log is a row per epoch."""
    from pyspark.sql import Window as W

    before = F.min("val_mse").over(W.orderBy("epoch").rowsBetween(W.unboundedPreceding, -1))
    return epochs.withColumn("improved", before.isNull() | (F.col("val_mse") < before))


def best_epoch(epochs: DataFrame) -> DataFrame:
    """One row: the epoch with the smallest validation error, the earliest if several have it."""
    return epochs.agg(F.min_by("epoch", F.struct("val_mse", "epoch")).alias("best_epoch"), F.min("val_mse").alias("best_val_mse"))
