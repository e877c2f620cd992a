"""Whole evaluations: fit on one split, score another, report one row."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from framewright.functions import vec
from framewright.operators import bank as banks
from framewright.operators import knn, mlp, score, split, templates


def matched_filter(train: DataFrame, val: DataFrame, num_classes: int, dim: int, mode: str = "time") -> DataFrame:
    """Accuracy of class-mean templates; `dim` is the vectors' length (twice the samples of a complex frame)."""
    floor = vec.LENGTH_FLOOR if mode == "cosine" else vec.ENERGY_FLOOR
    return score.accuracy(score.predict(val, templates.templates(train, num_classes, dim, floor), mode))


def knn_retrieval(queries: DataFrame, bank: DataFrame, k: int = 5, normalize: bool = False, limit: float | None = None) -> DataFrame:
    """Accuracy of the vote over the k nearest references, within `limit` if one is given."""
    found = knn.nearest(queries, bank, k, normalize)
    return score.accuracy(knn.majority_vote(found if limit is None else knn.within(found, limit)))


def latent_retrieval(queries: DataFrame, encoder: mlp.Mlp, bank: DataFrame, k: int = 5, normalize: bool = False) -> DataFrame:
    encoded = mlp.apply(queries.select("row_id", "x", "label"), encoder).select("row_id", "label", F.col("z").alias("x"))
    return knn_retrieval(encoded, bank, k, normalize)


def waveform_neighbours(train: DataFrame, val: DataFrame, k: int = 5, mode: str = "time") -> DataFrame:
    """Beyond the reference: every training frame is a template of its own; the k best vote. References meet frames in blocks
    that keep only the best k, so pairs are never written out."""
    refs = train.select(F.col("row_id").alias("ref_index"), vec.scaled_to_unit(vec.doubles("x"), vec.ENERGY_FLOOR).alias("z"), "label")
    return knn.majority_vote(knn.nearest(val, refs, k, measure={"time": "hermitian", "fft": "circular", "cosine": "cosine"}[mode]))


def multi_template(train: DataFrame, val: DataFrame, group: str, mode: str = "cosine") -> DataFrame:
    """Beyond the reference: predictions with a template for each class and value of `group`."""
    floor = vec.LENGTH_FLOOR if mode == "cosine" else vec.ENERGY_FLOOR
    return score.predict(val, templates.grouped_templates(train, group, floor).drop("grp"), mode)


def comparison(train: DataFrame, val: DataFrame, num_classes: int, dim: int, k: int = 5, timed: bool = False) -> DataFrame:
    """Beyond the reference: methods side by side (method, accuracy, total, n_bytes of what they compare with), and with `timed`
    the seconds that each took."""
    spark, bank = train.sparkSession, banks.from_frames(train)
    prototypes = banks.prototypes(bank, num_classes, dim)
    plans = [(m, matched_filter(train, val, num_classes, dim, m), prototypes) for m in ("cosine", "time", "fft")]
    plans.append(("knn", knn_retrieval(val, bank, k, True), bank))
    rows = []
    for method, plan, against in plans:
        one = plan.crossJoin(banks.footprint(against)).select(F.lit(method).alias("method"), "accuracy", "total", "n_bytes")
        if timed:
            began = time.perf_counter()
            one = spark.createDataFrame(one.collect(), one.schema)
            one = one.withColumn("seconds", F.lit(time.perf_counter() - began))
        rows.append(one)
    out = rows[0]
    for one in rows[1:]:
        out = out.unionByName(one)
    return out


def decoded_templates(bank: DataFrame, decoder: mlp.Mlp, num_classes: int) -> DataFrame:
    """Beyond the reference: class centroids of a bank, decoded to waveforms of unit energy."""
    dim = decoder.weights[0].shape[1]
    centre = banks.prototypes(bank, num_classes, dim).select(F.col("ref_index").alias("row_id"), F.col("z").alias("x"), "label")
    return mlp.apply(centre, decoder).select("label", vec.scaled_to_unit(F.col("z"), vec.ENERGY_FLOOR).alias("mu"))


def decoded_matched_filter(val: DataFrame, bank: DataFrame, decoder: mlp.Mlp, num_classes: int, mode: str = "time") -> DataFrame:
    """Beyond the reference: accuracy of templates that were decoded from a latent bank, on frames (row_id, label, x)."""
    return score.accuracy(score.predict(val, decoded_templates(bank, decoder, num_classes), mode))


def first_frame(frames: DataFrame, name: str) -> DataFrame:
    """One row that shows that a loader works: how many frames there are, and the first one's length, range and label; the types
    of x and label as text."""
    kinds = dict(frames.dtypes)
    first = frames.agg(F.count(F.lit(1)).alias("n_frames"), F.min_by(F.struct("row_id", F.size("x").alias("n_samples"), F.array_min("x").alias("least"), F.array_max("x").alias("most"), "label"), "row_id").alias("f"))
    return first.select(F.lit(name).alias("split"), "n_frames", "f.*", F.lit(kinds["x"]).alias("x_type"), F.lit(kinds["label"]).alias("label_type"))


def single_frame_ms(frame: np.ndarray, spectra: np.ndarray, mode: str, repeats: int) -> float:
    """Milliseconds of the kernel for one frame, in this process: a Spark job per frame would time scheduling."""
    x, warm_up = frame[None, :], min(repeats, 20)
    t = np.conj(np.fft.ifft(spectra, axis=1))

    def run():
        if mode == "fft":
            return score.fft_peaks(x, spectra)
        return np.abs(score.complex_rows(x) @ np.conj(t.T)) / max(np.sqrt((x * x).sum()), vec.ENERGY_FLOOR)

    for _ in range(1 + warm_up):
        run()
    began = time.perf_counter()
    for _ in range(repeats):
        run()
    return 1000 * (time.perf_counter() - began) / max(repeats, 1)


def rates(samples, seconds):
    """(milliseconds a frame, frames a second) as columns; nothing takes no time, and no time is infinitely fast."""
    ms = 1000 * seconds / F.greatest(samples, F.lit(1))
    return ms.alias("mean_frame_ms"), F.when(seconds > 0, samples / seconds).otherwise(F.lit(float("inf"))).alias("fps")


RUNTIME = (
    "mode string, split string, samples long, template_build_s double, single_frame_ms double, frame_repeats int, "
    "load_s double, score_s double, wall_s double, mean_frame_ms double, fps double, accuracy double, correct long, total long"
)


def one_pass(frames: DataFrame, templates: DataFrame, mode: str) -> dict:
    """Counts and times of one pass over frames, which `DataFrame.observe` gathers while it runs: total, correct, and seconds summed over
    tasks that were spent on waiting for rows (reading, decoding, handing over) and on scoring; and the pass's seconds by the clock."""
    seen = Observation()
    good = F.sum((F.col("pred") == F.col("y")).cast("long"))
    sums = {"total": F.count(F.lit(1)), "correct": good, "load_ns": F.sum("load_ns"), "score_ns": F.sum("score_ns")}
    watched = score.predict_timed(frames, templates, mode).observe(seen, *(F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()))
    began = time.perf_counter()
    watched.write.format("noop").mode("overwrite").save()
    wall, got = time.perf_counter() - began, seen.get
    return {"total": got["total"], "correct": got["correct"], "load_s": got["load_ns"] / 1e9, "score_s": got["score_ns"] / 1e9, "wall_s": wall}


def runtime(frames: DataFrame, n: int, num_classes: int, mode: str = "fft", max_train: int | None = None, max_eval: int | None = None,
            frame_repeats: int = 200, reference_compat: bool = False, warm_up: int = 2) -> DataFrame:
    """One row of times and counts, from one pass after `warm_up` untimed ones over a small part: `load_s` and `score_s` are summed over
    tasks, the rates are by the clock. Rows are split once and each side then takes a prefix; with `reference_compat` each side is split over
    its own prefix, as is customary there, so that rows may be in both."""
    spark = frames.sparkSession
    if reference_compat:
        train = split.seeded(split.prefix(frames, max_train), "train", min(n, max_train or n))
        val = split.seeded(split.prefix(frames, max_eval), "val", min(n, max_eval or n))
    else:
        train, val = split.prefix(split.seeded(frames, "train", n), max_train), split.prefix(split.seeded(frames, "val", n), max_eval)
    first = val.orderBy("row_id").first()
    if first is None:
        return spark.createDataFrame([], RUNTIME)
    began = time.perf_counter()
    fitted = templates.templates(train, num_classes, len(first["x"]), vec.ENERGY_FLOOR)
    mu = spark.createDataFrame(fitted.collect(), fitted.schema)
    build_s = time.perf_counter() - began
    spectra = np.conj(np.fft.fft(score.complex_rows(np.array([r["mu"] for r in mu.orderBy("label").collect()])), axis=1))
    frame_ms = single_frame_ms(np.array(first["x"]), spectra, mode, frame_repeats)
    for _ in range(warm_up):
        one_pass(split.prefix(val, first["row_id"] + 256), mu, mode)
    got = one_pass(val, mu, mode)
    columns = [c for c in RUNTIME.split(", ") if c.split()[0] not in ("mean_frame_ms", "fps")]
    row = (mode, "val", got["total"], build_s, frame_ms, frame_repeats, got["load_s"], got["score_s"], got["wall_s"], got["correct"] / max(got["total"], 1), got["correct"], got["total"])
    one = spark.createDataFrame([row], ", ".join(columns))
    return one.select("*", *rates(F.col("samples"), F.col("wall_s"))).select(*(c.split()[0] for c in RUNTIME.split(", ")))
