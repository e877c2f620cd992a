"""A classifier one can train and evaluate: logistic regression, or a multilayer one, on whole frames.

`pyspark.ml` trains both by distributed passes; only coefficients come to the driver. Frames are scaled to unit length first,
like all else that is compared here.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import vec
from framewright.operators import mlp, score


def _features(frames: DataFrame) -> DataFrame:
    unit = vec.scaled_to_unit(vec.doubles("x"))
    return frames.select("row_id", F.col("label").cast("double").alias("label"), array_to_vector(unit).alias("features"))


def train(frames: DataFrame, num_classes: int, hidden: tuple[int, ...] = (), max_iter: int = 100, l2: float = 1e-4, seed: int = 42):
    """A fitted `pyspark.ml` model: logistic regression, or with `hidden` a network of these layers. Labels run from 0."""
    rows = _features(frames)
    if not hidden:
        return LogisticRegression(family="multinomial", maxIter=max_iter, regParam=l2).fit(rows)
    first = rows.select("features").first()
    sizes = [len(first["features"]), *hidden, num_classes]
    return MultilayerPerceptronClassifier(layers=sizes, maxIter=max_iter, seed=seed).fit(rows)


def predict(frames: DataFrame, model) -> DataFrame:
    """(row_id, y, pred) by a fitted model."""
    out = model.transform(_features(frames))
    return out.select("row_id", F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"))


def predict_by_network(frames: DataFrame, network: mlp.Mlp) -> DataFrame:
    """(row_id, y, pred, score) by a network whose outputs are the classes' logits; equal ones go to the smaller class."""
    logits = mlp.apply(frames.select("row_id", F.col("label").cast("int").alias("y"), "x"), network, "x", "logits")
    best = F.array_max(F.transform("logits", lambda v, i: F.struct(v.alias("score"), (-i).alias("order")))).alias("best")
    return logits.select("row_id", "y", best).select("row_id", "y", (-F.col("best.order")).cast("int").alias("pred"), F.col("best.score").alias("score"))


def evaluate(frames: DataFrame, model) -> DataFrame:
    """One row: accuracy, correct, total."""
    return score.accuracy(predict_by_network(frames, model) if isinstance(model, mlp.Mlp) else predict(frames, model))
