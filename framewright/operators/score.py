"""Scores of frames against templates, and the decision for the best one.

Templates are a row per class, or several. Up to `BROADCAST_TEMPLATES` of them, in at most `BROADCAST_BYTES`, go to every
task as one constant array, and a frame's best template is found in its own row: nothing is shuffled, and frames that
repeat an id are scored each. More templates meet the frames in blocks, as references do in `knn`.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import vec
from framewright.shipping import ship

BROADCAST_TEMPLATES, BROADCAST_BYTES = 10_000, 64 << 20

#: For each mode the floor of a frame's length, and the score of a scaled frame and a template.
EXPRESSIONS = {
    "time": (vec.ENERGY_FLOOR, vec.hermitian_magnitude),
    "cosine": (vec.LENGTH_FLOOR, vec.dot),
    "shifts": (vec.ENERGY_FLOOR, vec.circular_peak),
}
MODES = ("time", "fft", "cosine", "shifts")


def fits(templates: DataFrame) -> bool:
    """Whether the templates may be broadcast, by their number and size."""
    n, size = templates.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("mu").cast("long") * 8), F.lit(0))).first()
    return n <= BROADCAST_TEMPLATES and size <= BROADCAST_BYTES


def scores(frames: DataFrame, templates: DataFrame, mode: str = "time") -> DataFrame:
    """(row_id, y, label, score) of every frame and template; the templates must fit a broadcast."""
    if not fits(templates):
        raise ValueError("the templates don't fit a broadcast; use predict()")
    floor, score = EXPRESSIONS[mode]
    unit = frames.select("row_id", F.col("label").alias("y"), vec.scaled_to_unit(vec.doubles("x"), floor).alias("x"))
    return unit.crossJoin(F.broadcast(templates)).select("row_id", "y", "label", score(F.col("x"), F.col("mu")).alias("score"))


def best_in_row(known: Column, unit: Column, score) -> Column:
    """struct(score, -label) of the best of an array of templates; equal scores go to the smallest label."""
    return F.array_max(F.transform(known, lambda t: F.struct(score(unit, t["mu"]).alias("score"), (-t["label"]).alias("order"))))


def predict_by_expressions(frames: DataFrame, templates: DataFrame, mode: str) -> DataFrame:
    floor, score = EXPRESSIONS[mode]
    unit = frames.select("row_id", F.col("label").cast("int").alias("y"), vec.scaled_to_unit(vec.doubles("x"), floor).alias("x"))
    if mode == "shifts":
        # templates are turned once, not in each frame's row; scoring is what costs: over all tasks, however few files hold the frames
        templates = templates.select("label", F.explode(vec.turned("mu")).alias("mu"))
        unit, score = unit.repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))), vec.turned_magnitude
    one = templates.agg(F.collect_list(F.struct("label", "mu")).alias("known"))
    best = unit.crossJoin(F.broadcast(one)).select("row_id", "y", best_in_row(F.col("known"), F.col("x"), score).alias("best"))
    return best.where("best is not null").select("row_id", "y", (-F.col("best.order")).cast("int").alias("pred"), F.col("best.score").alias("score"))


def as_rows(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def complex_rows(x: np.ndarray) -> np.ndarray:
    half = x.shape[1] // 2
    return x[:, :half] + 1j * x[:, half:]


def fft_peaks(x: np.ndarray, spectra: np.ndarray) -> np.ndarray:
    """(frames, templates): the largest magnitude of the circular correlation; spectra are conjugated."""
    energy = np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), vec.ENERGY_FLOOR)
    f = np.fft.fft(complex_rows(x / energy), axis=1)
    out = np.empty((len(x), len(spectra)))
    for c, s in enumerate(spectra):
        out[:, c] = np.abs(np.fft.ifft(f * s, axis=1)).max(1)
    return out


def predict_by_fft(frames: DataFrame, templates: DataFrame) -> DataFrame:
    """Circular-correlation peak by FFT in Arrow batches; the templates' spectra are computed once."""
    spark = frames.sparkSession
    ship(spark)
    got = templates.orderBy("label").select("label", "mu").collect()  # few: fits() was asked
    if not got:
        return spark.createDataFrame([], "row_id long, y int, pred int, score double")
    labels = np.array([r["label"] for r in got], np.int32)
    spectra = spark.sparkContext.broadcast(np.conj(np.fft.fft(complex_rows(np.array([r["mu"] for r in got])), axis=1)))

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                s = fft_peaks(as_rows(batch.column(2)), spectra.value)
                best = s.argmax(1)  # the first of equals, which has the smallest label
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(labels[best]), pa.array(s[np.arange(len(s)), best])], names=["row_id", "y", "pred", "score"])

    rows = frames.select(F.col("row_id").cast("long"), F.col("label").cast("int").alias("y"), vec.doubles("x").alias("x"))
    return rows.mapInArrow(scan, "row_id long, y int, pred int, score double")


def predict(frames: DataFrame, templates: DataFrame, mode: str = "time") -> DataFrame:
    """(row_id, y, pred, score): each frame's best template. Templates are (label, mu); a class may have several."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if not fits(templates):
        from framewright.operators import knn

        bank = templates.select(F.col("label").cast("long").alias("ref_index"), F.col("mu").alias("z"), "label")
        found = knn.nearest(frames, bank, 1, measure={"time": "hermitian", "cosine": "cosine"}.get(mode, "circular"))
        return found.select(F.col("qid").alias("row_id"), "y", F.col("label").alias("pred"), (-F.col("distance")).alias("score"))
    return predict_by_fft(frames, templates) if mode == "fft" else predict_by_expressions(frames, templates, mode)


def kernel(x: np.ndarray, mu: np.ndarray, mode: str) -> np.ndarray:
    """(frames, templates): scores of a mode in numpy, of templates that are scaled already."""
    if mode == "fft":
        return fft_peaks(x, np.conj(np.fft.fft(complex_rows(mu), axis=1)))
    if mode not in ("time", "cosine"):
        raise ValueError("mode must be time, fft or cosine")
    floor = vec.ENERGY_FLOOR if mode == "time" else vec.LENGTH_FLOOR
    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), floor)
    return np.abs(complex_rows(x) @ np.conj(complex_rows(mu)).T) if mode == "time" else x @ mu.T


def predict_timed(frames: DataFrame, templates: DataFrame, mode: str) -> DataFrame:
    """(row_id, y, pred, load_ns, score_ns): predictions of one pass, with the nanoseconds that its task waited for a batch's rows and
    spent on scoring them, on the batch's first row. Of equal scores the smallest label's wins."""
    if not fits(templates):
        raise ValueError("the templates don't fit a broadcast")
    spark = frames.sparkSession
    ship(spark)
    got = templates.orderBy("label").select("label", "mu").collect()  # few: fits() was asked
    shared = spark.sparkContext.broadcast((np.array([r["label"] for r in got], np.int32), np.array([r["mu"] for r in got])))

    def scan(batches):
        labels, mu = shared.value
        began = time.perf_counter_ns()
        for batch in batches:
            loaded = time.perf_counter_ns()
            if batch.num_rows and len(labels):
                best = labels[np.round(kernel(as_rows(batch.column(2)), mu, mode), 12).argmax(1)]
                scored = time.perf_counter_ns()
                spent = np.zeros((2, batch.num_rows), np.int64)
                spent[:, 0] = loaded - began, scored - loaded
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(best), *map(pa.array, spent)], names=["row_id", "y", "pred", "load_ns", "score_ns"])
            began = time.perf_counter_ns()

    rows = frames.select(F.col("row_id").cast("long"), F.col("label").cast("int").alias("y"), vec.doubles("x").alias("x"))
    return rows.mapInArrow(scan, "row_id long, y int, pred int, load_ns long, score_ns long")


def accuracy(predictions: DataFrame) -> DataFrame:
    """One row: accuracy, correct, total; every row of the input counts, and an empty input has accuracy 0."""
    n, good = F.count(F.lit(1)), F.coalesce(F.sum((F.col("pred") == F.col("y")).cast("long")), F.lit(0))
    return predictions.agg((good / F.greatest(n, F.lit(1))).alias("accuracy"), good.alias("correct"), n.alias("total"))
