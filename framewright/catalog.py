"""Named queries of the library and the SQL that checks them.

`embeddings` serves as bank, as queries and, read as 32 real and 32 imaginary parts, as complex frames. Its vectors
have unit length, so that frames are scaled by 1 + vec_id mod 7 wherever normalising must show. Every tenth
row validates, unless a query is about splitting. Floats are rounded to six places.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright import schema, scratch
from framewright.functions import vec
from framewright.operators import bank as banks
from framewright.operators import knn_join as knn_join_
from framewright.operators import classifier, knn, mlp, permutation, prototypes, quantized, score, split, stats, templates, training
from framewright.plans import evaluate
from framewright.sources import frames as sources
from framewright.streaming import correlate

CLASSES, DIM, HALF = 10, 64, 32
ENCODER, DECODER, HEAD = [64, 16, 8], [8, 16, 64], [8, 10]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_embeddings(_table(spark, sf_dir, "embeddings"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.labels_of(_table(spark, sf_dir, "embeddings"))


def _scaled(frames: DataFrame) -> DataFrame:
    return frames.withColumn("x", F.transform("x", lambda v: v * (1 + F.col("row_id") % 7)))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = _scaled(_frames(spark, sf_dir))
    return split.modular(every, "train"), split.modular(every, "val")


def _r(c, name: str | None = None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def frame_meta(spark, sf_dir):
    f = sources.numeric_meta(_frames(spark, sf_dir).withColumn("n_samples", F.size("x")))
    return f.select("row_id", "label", "n_samples")


#: A name for each label: the signal classes', then numbered ones.
CLASS_NAMES = schema.SIGNAL_CLASSES | {c: f"class_{c}" for c in range(len(schema.SIGNAL_CLASSES), CLASSES)}


def class_name_lookup(spark, sf_dir):
    return stats.class_names(_labels(spark, sf_dir), CLASS_NAMES).select("row_id", "label", "class_name")


def iq_stack(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumn("x", vec.stacked(vec.imaginary(F.col("x")), vec.real(F.col("x"))))
    return f.select("row_id", F.posexplode("x").alias("pos", "v")).select("row_id", "pos", _r("v", "value"))


def split_seeded(spark, sf_dir):
    f = _labels(spark, sf_dir)
    return split.labelled(f, f.count()).select("row_id", "split")


def split_hashed(spark, sf_dir):
    """The split for tables of any size."""
    f = _labels(spark, sf_dir)
    parts = [split.hashed(f, name).select("row_id", F.lit(name).alias("split")) for name in ("train", "val")]
    return parts[0].unionByName(parts[1])


def epoch_shuffle(spark, sf_dir):
    return split.epoch_order(_labels(spark, sf_dir), 3).select("row_id", "place")


def loader_smoke(spark, sf_dir):
    """Each split's first frame, as a loader gives it."""
    def part(name):
        f = sources.load_frames(spark, "embeddings", name, path=f"{sf_dir}/embeddings.parquet")
        return evaluate.first_frame(f, name).select("split", "n_frames", "row_id", "n_samples", _r("least"), _r("most"), F.col("label").cast("int").alias("label"))

    return part("train").unionByName(part("val")).unionByName(part("all"))


def split_permuted(spark, sf_dir):
    """An exact split of a table of any size: a permutation by expressions."""
    f = _labels(spark, sf_dir)
    n = f.count()
    parts = [permutation.split_exactly(f, name, n).select("row_id", F.lit(name).alias("split")) for name in ("train", "val")]
    return parts[0].unionByName(parts[1])


def epoch_permuted(spark, sf_dir):
    f = _labels(spark, sf_dir)
    return permutation.epoch_places(f, f.count(), 3).select("row_id", "place")


def load_frames(spark, sf_dir):
    """Frames by the name of their kind: a prefix, of which the seeded split's validation rows are taken."""
    f = sources.load_frames(spark, "embeddings", "VAL", path=f"{sf_dir}/embeddings.parquet", max_samples=200)
    return f.select("row_id", "label", F.size("x").alias("n_samples"))


def split_prefix(spark, sf_dir):
    return split.prefix(_labels(spark, sf_dir), 100).select("row_id", "label")


def split_disjoint(spark, sf_dir):
    """Train and validation share nothing and make up everything."""
    f = _labels(spark, sf_dir).select("row_id")
    n = f.count()
    train, val = (split.seeded(f, s, n).select("row_id") for s in ("train", "val"))
    both = F.count(F.lit(1))
    rows = [
        ("shared", train.join(val, "row_id", "left_semi").agg(both.alias("n"))),
        ("missing", f.join(train.unionByName(val), "row_id", "left_anti").agg(both.alias("n"))),
        ("train", train.agg(both.alias("n"))),
        ("val", val.agg(both.alias("n"))),
    ]
    out = [df.select(F.lit(name).alias("what"), "n") for name, df in rows]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _as_signals(spark, sf_dir):
    """The vectors as rows of a signal file, with the label fields that such a file has."""
    e = _table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"), F.slice("embedding", 1, HALF).alias("re"), F.slice("embedding", HALF + 1, HALF).alias("im"),
        F.col("label").alias("signal_type"), (F.col("vec_id") % 41 - 20).alias("signal_to_noise_ratio"), (F.col("vec_id") % 5 + 2).alias("number_of_pulses"),
        (F.col("vec_id") % 7 / 4).alias("pulse_width"), (F.col("vec_id") % 3 / 8).alias("time_delay"), (F.col("vec_id") % 11 / 2).alias("pulse_repetition_interval"),
        F.col("vec_id").alias("index"),
    )


def signal_frames(spark, sf_dir):
    """Signal rows as frames with renamed metadata; the first imaginary sample shows the stacking."""
    f = sources.from_signals(_as_signals(spark, sf_dir))
    meta = ["row_id", "label", "snr_db", "number_of_pulses", "pulse_width", "time_delay", "pulse_repetition_interval", "index"]
    return f.select(*meta, F.size("x").alias("n_samples"), _r(F.element_at("x", HALF + 1), "first_im"))


def encode_iq(spark, sf_dir):
    """The network on complex frames given as real and imaginary halves."""
    return _long(mlp.apply_iq(_as_signals(spark, sf_dir).select("row_id", "re", "im"), mlp.by_rule(ENCODER)))


def _normalized(spark, sf_dir, floor):
    f = _scaled(_frames(spark, sf_dir)).withColumn("x", vec.scaled_to_unit(F.col("x"), floor))
    return f.select("row_id", F.posexplode("x").alias("pos", "v")).select("row_id", "pos", _r("v", "value"))


def normalize_energy(spark, sf_dir):
    return _normalized(spark, sf_dir, vec.ENERGY_FLOOR)


def normalize_l2(spark, sf_dir):
    return _normalized(spark, sf_dir, vec.LENGTH_FLOOR)


def templates_real(spark, sf_dir):
    return templates.long_form(templates.templates(_parts(spark, sf_dir)[0], CLASSES, DIM)).select("label", "pos", _r("value"))


def templates_complex(spark, sf_dir):
    """Over a domain one class larger than the data's: the last template stays zero."""
    return templates.long_form(templates.complex_templates(_parts(spark, sf_dir)[0], CLASSES + 1, HALF)).select("label", "pos", _r("value"))


def _predicted(mode):
    def query(spark, sf_dir):
        train, val = _parts(spark, sf_dir)
        floor = vec.LENGTH_FLOOR if mode == "cosine" else vec.ENERGY_FLOOR
        best = score.predict(val, templates.templates(train, CLASSES, DIM, floor), mode)
        return best.select("row_id", "y", "pred", _r("score"))

    return query


def _accuracy(mode):
    def query(spark, sf_dir):
        train, val = _parts(spark, sf_dir)
        return evaluate.matched_filter(train, val, CLASSES, DIM, mode).select(_r("accuracy"), "correct", "total")

    return query


def mf_fft_by_expressions(spark, sf_dir):
    """The circular-correlation peak without Python, as a check on the kernel."""
    train, val = _parts(spark, sf_dir)
    best = score.predict(val, templates.complex_templates(train, CLASSES, HALF), "shifts")
    return best.select("row_id", "y", "pred", _r("score"))


def bank_normalize(spark, sf_dir):
    b = banks.from_frames(_scaled(_frames(spark, sf_dir)), normalize=True)
    return b.select("ref_index", "label", F.posexplode("z").alias("pos", "v")).select("ref_index", "label", "pos", _r("v", "value"))


def _neighbours(normalize):
    def query(spark, sf_dir):
        train, val = _parts(spark, sf_dir)
        found = knn.nearest(val, banks.from_frames(train), 5, normalize)
        return found.select("qid", "y", "rank", "ref_index", "label", _r("distance"))

    return query


def knn_vote(spark, sf_dir):
    train, val = _parts(spark, sf_dir)
    return knn.majority_vote(knn.nearest(val, banks.from_frames(train), 5, True)).select("row_id", "y", "pred")


def accuracy_knn(spark, sf_dir):
    train, val = _parts(spark, sf_dir)
    return evaluate.knn_retrieval(val, banks.from_frames(train), 5, True).select(_r("accuracy"), "correct", "total")


def knn_rejected(spark, sf_dir):
    """Beyond the reference: neighbours farther than 1.1 don't vote; a query without any is left out."""
    train, val = _parts(spark, sf_dir)
    found = knn.within(knn.nearest(val, banks.from_frames(train), 5, True), 1.1)
    return knn.majority_vote(found).select("row_id", "y", "pred")


def _long(df, vector="z"):
    return df.select("row_id", F.posexplode(vector).alias("pos", "v")).select("row_id", "pos", _r("v", "value"))


def encode_mlp(spark, sf_dir):
    return _long(mlp.apply(_frames(spark, sf_dir), mlp.by_rule(ENCODER)))


def encode_mlp_by_join(spark, sf_dir):
    got = mlp.apply_by_join(_frames(spark, sf_dir), mlp.by_rule(ENCODER))
    return got.select("row_id", "pos", _r("v", "value"))


def _decoded(spark, sf_dir):
    z = mlp.apply(_frames(spark, sf_dir), mlp.by_rule(ENCODER)).withColumnRenamed("z", "latent")
    whole = _frames(spark, sf_dir).select("row_id", F.col("x").alias("original"))
    return mlp.apply(z, mlp.by_rule(DECODER), "latent", "x_hat").join(whole, "row_id")


def decode_mlp(spark, sf_dir):
    z = mlp.apply(_frames(spark, sf_dir), mlp.by_rule(ENCODER)).withColumnRenamed("z", "latent")
    return _long(mlp.apply(z, mlp.by_rule(DECODER), "latent", "x_hat"), "x_hat")


def recon_mse(spark, sf_dir):
    per_row = vec.mean_square(F.col("original"), F.col("x_hat"))
    return _decoded(spark, sf_dir).agg(_r(F.avg(per_row), "mse"), F.count(F.lit(1)).alias("n"))


def cls_ce(spark, sf_dir):
    z = mlp.apply(_frames(spark, sf_dir), mlp.by_rule(ENCODER))
    logits = mlp.apply(z, mlp.by_rule(HEAD), "z", "logits")
    return logits.agg(_r(F.avg(vec.cross_entropy(F.col("logits"), F.col("label"))), "ce"), F.count(F.lit(1)).alias("n"))


def _epochs(spark, sf_dir):
    """Seven rows (epoch, train_mse, val_mse) of means over a table, in place of a run's log."""
    by = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("epoch"))
    return by.agg(F.round(F.avg("l_tax"), 4).alias("train_mse"), F.round(F.avg("l_discount"), 4).alias("val_mse"))


def best_epoch(spark, sf_dir):
    return mlp.best_epoch(_epochs(spark, sf_dir)).select("best_epoch", _r("best_val_mse"))


def epochs_improved(spark, sf_dir):
    return mlp.best_so_far(_epochs(spark, sf_dir)).select("epoch", "val_mse", "improved")


def stats_class_counts(spark, sf_dir):
    return stats.class_counts(_labels(spark, sf_dir), CLASSES + 2).select("label", "n", _r("percent"))


def stats_histogram(spark, sf_dir):
    return stats.histogram(_table(spark, sf_dir, "lineitem"), "l_quantity")


def stats_n_unique(spark, sf_dir):
    return stats.n_unique(_table(spark, sf_dir, "lineitem"), "l_quantity")


def stats_split_counts(spark, sf_dir):
    f = _labels(spark, sf_dir)
    return stats.split_counts(split.labelled(f, f.count()), CLASSES)


def waveform_neighbours(spark, sf_dir):
    train, val = _parts(spark, sf_dir)
    return evaluate.waveform_neighbours(train, val, 5).select("row_id", "y", "pred")


def waveform_neighbours_fft(spark, sf_dir):
    """Neighbours by the peak of the circular correlation, of which a spectral bound leaves most out."""
    train, val = _parts(spark, sf_dir)
    refs = train.select(F.col("row_id").alias("ref_index"), vec.scaled_to_unit(vec.doubles("x"), vec.ENERGY_FLOOR).alias("z"), "label")
    found = knn.nearest(val, refs, 5, measure="circular")
    return found.select("qid", "y", "rank", "ref_index", "label", F.round(-F.col("distance"), 6).alias("score"))


def quantized_neighbors(spark, sf_dir):
    """Neighbours through byte codes, all of them looked at exactly."""
    train, val = _parts(spark, sf_dir)
    found = _quantized(spark, banks.from_frames(train), val, rerank=1 << 20)
    return found.select("qid", "y", "rank", "ref_index", "label", _r("distance"))


def quantized_recall(spark, sf_dir):
    """Of the exact neighbours how many a code of eight bytes finds among 100 that are looked at exactly."""
    train, val = _parts(spark, sf_dir)
    bank = banks.from_frames(train)
    return quantized.recall(_quantized(spark, bank, val, rerank=100), knn.nearest(val, bank, 5))


def _quantized(spark, bank, val, rerank):
    books = quantized.fit(bank, 8, 64, 2)
    return quantized.nearest(val, bank, scratch.written(quantized.encode(bank, books), "codes"), books, 5, rerank)


def accuracy_decoded(spark, sf_dir):
    """Frames scored with templates that were decoded from a latent bank's centroids."""
    f, encoder = _frames(spark, sf_dir), mlp.by_rule(ENCODER)
    bank = banks.encoded(split.modular(f, "train"), encoder)
    got = evaluate.decoded_matched_filter(split.modular(f, "val"), bank, mlp.by_rule(DECODER), CLASSES)
    return got.select(_r("accuracy"), "correct", "total")


def bank_prototypes(spark, sf_dir):
    b = banks.prototypes(banks.from_frames(_parts(spark, sf_dir)[0]), CLASSES, DIM)
    return b.select("label", F.posexplode("z").alias("pos", "v")).select("label", "pos", _r("v", "value"))


def bank_kmeans(spark, sf_dir):
    """Three prototypes a class after two rounds, from the references with the smallest hashes."""
    b = prototypes.fit(banks.from_frames(_parts(spark, sf_dir)[0]), 3, 2, initial="hash").bank(spark)
    return b.select("ref_index", "label", F.posexplode("z").alias("pos", "v")).select("ref_index", "label", "pos", _r("v", "value"))


def bank_footprint(spark, sf_dir):
    return banks.footprint(banks.from_frames(_parts(spark, sf_dir)[0]))


def bank_subsample(spark, sf_dir):
    return banks.subsample(banks.from_frames(_frames(spark, sf_dir)), 20).select("ref_index", "label")


def bank_stored(spark, sf_dir):
    """A bank written with its manifest and read again for the encoder that made it."""
    encoder, path = mlp.by_rule(ENCODER), scratch.path_for(spark, "bank")
    banks.export(_frames(spark, sf_dir), encoder, path, run="query")
    b = banks.load(spark, path, encoder)
    return b.select("ref_index", "label", F.posexplode("z").alias("pos", "v")).select("ref_index", "label", "pos", F.round("v", 4).alias("value"))


def checkpoint_stored(spark, sf_dir):
    """An encoder written as a checkpoint, read again and applied."""
    path = scratch.path_for(spark, "checkpoint")
    mlp.save(mlp.by_rule(ENCODER), spark, path, latent_dim=ENCODER[-1])
    encoder, config = mlp.load(spark, path)
    return _long(mlp.apply(_frames(spark, sf_dir), encoder)).withColumn("latent_dim", F.lit(config["latent_dim"]))


def derived_rates(spark, sf_dir):
    """Milliseconds a frame and frames a second, of made-up runs."""
    runs = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("run"))
    runs = runs.agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("l_tax"), 2).alias("seconds"))
    return runs.select("run", "samples", *(_r(c) for c in ("seconds",)), *(F.round(c, 6).alias(n) for c, n in zip(evaluate.rates(F.col("samples"), F.col("seconds")), ("mean_frame_ms", "fps"))))


def comparison(spark, sf_dir):
    train, val = _parts(spark, sf_dir)
    return evaluate.comparison(train, val, CLASSES, DIM).select("method", _r("accuracy"), "total", "n_bytes")


def mf_multi_template(spark, sf_dir):
    """Three templates for each class."""
    train, val = _parts(spark, sf_dir)
    best = evaluate.multi_template(train.withColumn("kind", F.floor(F.col("row_id") / 10) % 3), val, "kind")
    return best.select("row_id", "y", "pred", _r("score"))


def templates_decoded(spark, sf_dir):
    """Centroids of a latent bank, decoded to waveforms."""
    bank = banks.encoded(_frames(spark, sf_dir), mlp.by_rule(ENCODER))
    return templates.long_form(evaluate.decoded_templates(bank, mlp.by_rule(DECODER), CLASSES)).select("label", "pos", _r("value"))


def latent_retrieval(spark, sf_dir):
    f, encoder = _frames(spark, sf_dir), mlp.by_rule(ENCODER)
    bank = banks.encoded(split.modular(f, "train"), encoder)
    return evaluate.latent_retrieval(split.modular(f, "val"), encoder, bank, 5).select(_r("accuracy"), "correct", "total")


def classify_by_network(spark, sf_dir):
    """Frames' classes by a network's logits on their latent vectors."""
    z = mlp.apply(_frames(spark, sf_dir), mlp.by_rule(ENCODER)).select("row_id", "label", F.col("z").alias("x"))
    return classifier.predict_by_network(z, mlp.by_rule(HEAD)).select("row_id", "y", "pred", _r("score"))


def train_classifier(spark, sf_dir):
    """Accuracy of logistic regression (optimised, so that only its rows are checked)."""
    train, val = _parts(spark, sf_dir)
    return classifier.evaluate(val, classifier.train(train, CLASSES, max_iter=20))


def train_autoencoder(spark, sf_dir):
    """Epoch metrics of a small run (random weights: only its rows are checked)."""
    train, val = _parts(spark, sf_dir)
    got = training.train_autoencoder(train, val, latent=8, hidden=(32, 16), epochs=5, joint_weight=0.1)
    return spark.createDataFrame(got.epochs, schema.EPOCHS)


def train_step(spark, sf_dir):
    """Weights after one step of gradient descent on all frames, from weights by rule: forward, backward and the sum over tasks."""
    f = _frames(spark, sf_dir)
    start = mlp.by_rule([DIM, 8, 4]), mlp.by_rule([4, 8, DIM]), mlp.by_rule([4, CLASSES])
    got = training.train_autoencoder(f, f, 4, (8,), epochs=1, batch=1 << 30, rate=0.5, joint_weight=0.25, optimizer="sgd", initial=start)
    rows = [
        (name, layer, int(o), int(p), float(v))
        for name, net in (("encoder", got.encoder), ("decoder", got.decoder), ("head", got.head))
        for layer, (w, b) in enumerate(zip(net.weights, net.biases))
        for (o, p), v in [*np.ndenumerate(w), *(((o, -1), v) for o, v in enumerate(b))]
    ]
    return spark.createDataFrame(rows, "net string, layer int, out int, pos int, value double").withColumn("value", F.round("value", 6) + F.lit(0.0))


def knn_join(spark, sf_dir):
    """Exact neighbours of unit vectors, found cell by cell."""
    train, val = _parts(spark, sf_dir)
    found = knn_join_.nearest_by_cells(val, banks.from_frames(train), 5, True).neighbours
    return found.select("qid", "y", "rank", "ref_index", "label", _r("distance"))


SPAN = 500


def _signal_of(rows):
    """Vectors laid end to end as four endless signals of complex samples, a vector a second."""
    order = F.floor(F.col("vec_id") / 4)
    return rows.select(
        F.concat(F.lit("c"), F.col("vec_id") % 4).alias("channel"), (order * HALF).alias("start"), F.col("embedding").alias("x"),
        F.timestamp_seconds(order + 86_400).alias("ts"),
    )


def _sought(spark, sf_dir):
    """The first three vectors as templates, known to be no more than that."""
    return _table(spark, sf_dir, "embeddings").where("vec_id < 3").select(F.col("vec_id").cast("int").alias("label"), F.col("embedding").alias("mu"))


def signal_detections(spark, sf_dir):
    """Places of endless signals where a template's correlation peaks."""
    found = correlate.detections(_signal_of(_table(spark, sf_dir, "embeddings")), _sought(spark, sf_dir), 0.5, SPAN)
    return found.select("channel", "label", "place", _r("score"))


def signal_detections_streamed(spark, sf_dir):
    """The same from a stream: what is decided when all files are read, which is all blocks whose samples are there."""
    rows = _table(spark, sf_dir, "embeddings")
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/embeddings.parque[t]")  # a stream reads folders and patterns
    found = correlate.detect_stream(_signal_of(stream), _sought(spark, sf_dir), 0.5, SPAN, "10 days")
    out = scratch.path_for(spark, "detections")
    sink = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.path_for(spark, "stream"))
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(correlate.FOUND).parquet(out).select("channel", "label", "place", _r("score"))


def bench_matched_filter(spark, sf_dir):
    f = _frames(spark, sf_dir)
    return evaluate.runtime(f, f.count(), CLASSES)


def runtime_counts(spark, sf_dir):
    """What the run-time report counts in its one pass; its times are left out."""
    f = _frames(spark, sf_dir)
    return evaluate.runtime(f, f.count(), CLASSES, "fft", frame_repeats=1, warm_up=0).select("mode", "split", "samples", _r("accuracy"), "correct", "total")


QUERIES = {
    "frame_meta": frame_meta, "class_name_lookup": class_name_lookup, "iq_stack": iq_stack,
    "split_seeded": split_seeded, "split_hashed": split_hashed, "split_prefix": split_prefix, "split_disjoint": split_disjoint,
    "normalize_energy": normalize_energy, "normalize_l2": normalize_l2,
    "templates_real": templates_real, "templates_complex": templates_complex,
    "mf_cosine": _predicted("cosine"), "mf_time": _predicted("time"), "mf_fft": _predicted("fft"),
    "mf_fft_by_expressions": mf_fft_by_expressions,
    "accuracy_cosine": _accuracy("cosine"), "accuracy_time": _accuracy("time"), "accuracy_fft": _accuracy("fft"),
    "bank_normalize": bank_normalize, "knn_neighbors": _neighbours(False), "knn_neighbors_normalized": _neighbours(True),
    "knn_vote": knn_vote, "accuracy_knn": accuracy_knn, "knn_rejected": knn_rejected,
    "encode_mlp": encode_mlp, "encode_mlp_by_join": encode_mlp_by_join, "decode_mlp": decode_mlp,
    "recon_mse": recon_mse, "cls_ce": cls_ce, "best_epoch": best_epoch, "epochs_improved": epochs_improved,
    "stats_class_counts": stats_class_counts, "stats_histogram": stats_histogram,
    "stats_n_unique": stats_n_unique, "stats_split_counts": stats_split_counts,
    "waveform_neighbours": waveform_neighbours, "waveform_neighbours_fft": waveform_neighbours_fft, "accuracy_decoded": accuracy_decoded,
    "quantized_neighbors": quantized_neighbors, "quantized_recall": quantized_recall, "bank_prototypes": bank_prototypes,
    "bank_footprint": bank_footprint, "bank_kmeans": bank_kmeans, "bank_subsample": bank_subsample, "comparison": comparison,
    "epoch_shuffle": epoch_shuffle, "split_permuted": split_permuted, "loader_smoke": loader_smoke, "epoch_permuted": epoch_permuted, "load_frames": load_frames, "bank_stored": bank_stored, "checkpoint_stored": checkpoint_stored,
    "derived_rates": derived_rates,
    "signal_frames": signal_frames, "encode_iq": encode_iq, "mf_multi_template": mf_multi_template, "templates_decoded": templates_decoded,
    "latent_retrieval": latent_retrieval, "classify_by_network": classify_by_network, "train_classifier": train_classifier,
    "train_autoencoder": train_autoencoder, "train_step": train_step, "knn_join": knn_join,
    "signal_detections": signal_detections, "signal_detections_streamed": signal_detections_streamed, "bench_matched_filter": bench_matched_filter,
    "runtime_counts": runtime_counts,
}

# --- SQL ---------------------------------------------------------------------------------------------------


def _left_out(n: int) -> str:
    """The rows that numpy's own permutation leaves for validation at 0.9 and seed 42: the definition of the split, without the library."""
    return ",".join(map(str, sorted(np.random.default_rng(42).permutation(n)[n * 9 // 10 :].tolist())))


#: For the sizes that the vector tables have, all multiples of ten.
_VAL = " OR ".join(f"((SELECT count(*) FROM embeddings) = {n} AND vec_id IN ({_left_out(n)}))" for n in (500, 2000))
_SPLIT = f"CASE WHEN {_VAL} THEN 'val' ELSE 'train' END"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


_RAW = """f AS (SELECT vec_id AS row_id, label, generate_subscripts(embedding, 1) - 1 AS pos,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""
_SCALED = """f AS (SELECT vec_id AS row_id, label, generate_subscripts(embedding, 1) - 1 AS pos,
  CAST(unnest(embedding) AS DOUBLE) * (1 + vec_id % 7) AS v FROM embeddings)"""


def _unit(name: str, source: str, key: str, floor: str) -> str:
    return f"""{name} AS (SELECT {key}, pos, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY {key})), {floor}::DOUBLE) AS v
  FROM {source})"""


def _templates(floor: str) -> str:
    return (
        "m AS (SELECT label, pos, avg(v) AS v FROM f WHERE row_id % 10 <> 0 GROUP BY label, pos), "
        + _unit("t", "m", "label", floor)
    )


_VALIDATING = "v AS (SELECT * FROM f WHERE row_id % 10 = 0), y AS (SELECT DISTINCT row_id, CAST(label AS INT) AS y FROM v)"
_COSINE = "s AS (SELECT q.row_id, t.label, sum(q.v * t.v) AS score FROM q JOIN t USING (pos) GROUP BY q.row_id, t.label)"
_COMPLEX = """qc AS (SELECT a.row_id, a.pos, a.v AS re, b.v AS im FROM q a JOIN q b ON a.row_id = b.row_id AND b.pos = a.pos + 32),
tc AS (SELECT a.label, a.pos, a.v AS re, b.v AS im FROM t a JOIN t b ON a.label = b.label AND b.pos = a.pos + 32)"""
_TIME = """s AS (SELECT q.row_id, t.label,
  sqrt(pow(sum(q.re * t.re + q.im * t.im), 2) + pow(sum(q.im * t.re - q.re * t.im), 2)) AS score
  FROM qc q JOIN tc t USING (pos) GROUP BY q.row_id, t.label)"""
_FFT = """l AS (SELECT q.row_id, t.label, (q.pos - t.pos + 32) % 32 AS lag,
  sqrt(pow(sum(q.re * t.re + q.im * t.im), 2) + pow(sum(q.im * t.re - q.re * t.im), 2)) AS score
  FROM qc q JOIN tc t ON true GROUP BY q.row_id, t.label, lag),
s AS (SELECT row_id, label, max(score) AS score FROM l GROUP BY row_id, label)"""
_BEST = """p AS (SELECT row_id, y, CAST(label AS INT) AS pred, score FROM
  (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(score, 12) DESC, label) AS r FROM s) JOIN y USING (row_id) WHERE r = 1)"""
_ACCURACY = """SELECT round(count(*) FILTER (WHERE pred = y) / greatest(count(*), 1)::DOUBLE, 6) AS accuracy,
  count(*) FILTER (WHERE pred = y) AS correct, count(*) AS total FROM p"""


def _filter_sql(mode: str) -> str:
    floor = "1e-12" if mode == "cosine" else "1e-8"
    scores = _COSINE if mode == "cosine" else _COMPLEX + ", " + (_TIME if mode == "time" else _FFT)
    return _with(_SCALED, _templates(floor), _VALIDATING, _unit("q", "v", "row_id", floor), scores, _BEST)


def _neighbour_sql(normalize: bool) -> str:
    source = _unit("u", "f", "row_id, label", "1e-12") if normalize else "u AS (SELECT row_id, label, pos, v FROM f)"
    return _with(
        _SCALED,
        source,
        """d AS (SELECT a.row_id AS qid, CAST(a.label AS INT) AS y, b.row_id AS ref_index, CAST(b.label AS INT) AS label,
  sqrt(sum(pow(a.v - b.v, 2))) AS distance FROM u a JOIN u b ON a.pos = b.pos WHERE a.row_id % 10 = 0 AND b.row_id % 10 <> 0
  GROUP BY a.row_id, a.label, b.row_id, b.label)""",
        """n AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, ref_index) AS INT) AS rank FROM d)
  WHERE rank <= 5)""",
    )


_VOTE = """p AS (SELECT qid AS row_id, y, label AS pred FROM (SELECT qid, y, label,
  row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, label) AS r FROM n GROUP BY qid, y, label) WHERE r = 1)"""


def _layer(name: str, source: str, n_in: int, n_out: int, relu: bool) -> str:
    value = "sum(x.v * ((7 * x.pos + 13 * o.o) % 11 - 5) / 11.0::DOUBLE) + (o.o % 3 - 1) / 10.0::DOUBLE"
    return f"""{name} AS (SELECT x.row_id, o.o AS pos, {f'greatest({value}, 0)' if relu else value} AS v
  FROM {source} x JOIN (SELECT unnest(range({n_out})) AS o) o ON true GROUP BY x.row_id, o.o)"""


_ENCODED = (_RAW, _layer("h", "f", 64, 16, True), _layer("z", "h", 16, 8, False))
_DECODED = (*_ENCODED, _layer("g", "z", 8, 16, True), _layer("w", "g", 16, 64, False))
_LONG = "SELECT row_id, CAST(pos AS INT) AS pos, round(v, 6) AS value FROM "
_EPOCH_ROWS = "e AS (SELECT l_linenumber AS epoch, round(avg(l_discount), 4) AS val_mse FROM lineitem GROUP BY 1)"
_VOTED = "SELECT row_id, y, pred FROM p"


def _rule(o: str, i: str) -> str:
    """A weight by rule; `i` is null for a bias."""
    return f"CASE WHEN {i} < 0 THEN ({o} % 3 - 1) / 10.0::DOUBLE ELSE ((7 * {i} + 13 * {o}) % 11 - 5) / 11.0::DOUBLE END"


def _back(name: str, after: str, n_in: int, relu_of: str | None) -> str:
    """What an error at a layer's outputs is at its inputs."""
    sums = f"""SELECT d.row_id, i.i AS pos, sum(d.v * ((7 * i.i + 13 * d.pos) % 11 - 5) / 11.0::DOUBLE) AS v
  FROM {after} d JOIN (SELECT unnest(range({n_in})) AS i) i ON true GROUP BY d.row_id, i.i"""
    if relu_of is None:
        return f"{name} AS ({sums})"
    return f"{name} AS (SELECT s.row_id, s.pos, CASE WHEN a.v > 0 THEN s.v ELSE 0 END AS v FROM ({sums}) s JOIN {relu_of} a USING (row_id, pos))"


def _stepped(net: str, layer: int, error: str, source: str, rate: float = 0.5) -> str:
    """A layer's weights and biases after a step down their gradient, a mean over rows."""
    return f"""SELECT '{net}' AS net, {layer} AS layer, CAST(o AS INT) AS out, CAST(i AS INT) AS pos, round({_rule('o', 'i')} - {rate} * g, 6) + 0.0::DOUBLE AS value FROM (
  SELECT d.pos AS o, x.pos AS i, sum(d.v * x.v) / any_value(c.n) AS g FROM {error} d JOIN (SELECT row_id, pos, v FROM {source} UNION ALL SELECT DISTINCT row_id, -1, 1.0 FROM {source}) x
  USING (row_id), (SELECT count(DISTINCT row_id) AS n FROM f) c GROUP BY d.pos, x.pos)"""


_STEP = _with(
    _RAW,
    _layer("h", "f", 64, 8, True),
    _layer("z", "h", 8, 4, False),
    _layer("g", "z", 4, 8, True),
    _layer("w", "g", 8, 64, False),
    _layer("c", "z", 4, 10, False),
    "dw AS (SELECT row_id, pos, 2 * (w.v - f.v) / 64 AS v FROM w JOIN f USING (row_id, pos))",
    """dc AS (SELECT row_id, c.pos, 0.25 * (exp(c.v - m.m) / m.s - CASE WHEN c.pos = m.label THEN 1 ELSE 0 END) AS v FROM c JOIN
  (SELECT row_id, any_value(label) AS label, max(m) AS m, sum(exp(v - m)) AS s FROM (SELECT row_id, v, max(v) OVER (PARTITION BY row_id) AS m FROM c)
   JOIN (SELECT DISTINCT row_id, label FROM f) USING (row_id) GROUP BY row_id) m USING (row_id))""",
    _back("dg", "dw", 8, "g"),
    _back("dz1", "dg", 4, None),
    _back("dz2", "dc", 4, None),
    "dz AS (SELECT row_id, pos, a.v + b.v AS v FROM dz1 a JOIN dz2 b USING (row_id, pos))",
    _back("dh", "dz", 8, "h"),
) + " UNION ALL ".join(
    (_stepped("encoder", 0, "dh", "f"), _stepped("encoder", 1, "dz", "h"), _stepped("decoder", 0, "dg", "z"), _stepped("decoder", 1, "dw", "g"), _stepped("head", 0, "dc", "z"))
)


_KMEANS = _with(
    _SCALED.replace("FROM embeddings", "FROM embeddings WHERE vec_id % 10 <> 0"),
    """h AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5('42:' || vec_id), 1, 8) AS BIGINT), vec_id) - 1 AS j
  FROM embeddings WHERE vec_id % 10 <> 0 QUALIFY j < 3)""",
    "c0 AS (SELECT h.label, j, pos, v FROM h JOIN f ON f.row_id = h.vec_id)",
    *(
        part
        for r in range(2)
        for part in (
            f"""d{r} AS (SELECT row_id, f.label, j, sum(pow(f.v - c.v, 2)) AS d FROM f JOIN c{r} c ON c.label = f.label AND c.pos = f.pos GROUP BY row_id, f.label, j)""",
            f"""a{r} AS (SELECT row_id, label, j FROM d{r} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(d, 9), j) = 1)""",
            f"""c{r + 1} AS (SELECT c.label, c.j, c.pos, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN
  (SELECT a.label, j, pos, avg(v) AS v FROM a{r} a JOIN f USING (row_id) GROUP BY a.label, j, pos) m ON m.label = c.label AND m.j = c.j AND m.pos = c.pos)""",
        )
    ),
) + """SELECT dense_rank() OVER (ORDER BY label, j) - 1 AS ref_index, CAST(label AS INT) AS label, CAST(pos AS INT) AS pos, round(v, 6) AS value FROM c2"""

_SIGNAL = _with(
    """s AS (SELECT 'c' || vec_id % 4 AS channel, (vec_id // 4) * 32 + i AS k, CAST(embedding[i + 1] AS DOUBLE) AS re, CAST(embedding[i + 33] AS DOUBLE) AS im
  FROM embeddings JOIN (SELECT unnest(range(32)) AS i) ON true)""",
    "t AS (SELECT vec_id AS label, i, CAST(embedding[i + 1] AS DOUBLE) AS re, CAST(embedding[i + 33] AS DOUBLE) AS im FROM embeddings JOIN (SELECT unnest(range(32)) AS i) ON true WHERE vec_id < 3)",
    "e AS (SELECT label, sqrt(sum(re * re + im * im)) AS e FROM t GROUP BY label)",
    """c AS (SELECT channel, label, k - i AS place, sqrt(pow(sum(s.re * t.re + s.im * t.im), 2) + pow(sum(s.im * t.re - s.re * t.im), 2)) / sqrt(sum(s.re * s.re + s.im * s.im)) / any_value(e.e) AS score
  FROM s JOIN t ON true JOIN e USING (label) WHERE k >= i GROUP BY channel, label, k - i HAVING count(*) = 32)""",
    """p AS (SELECT *, coalesce(lag(score) OVER w, -1) AS before, coalesce(lead(score) OVER w, -1) AS after, max(place) OVER (PARTITION BY channel) + 32 AS n
  FROM c WINDOW w AS (PARTITION BY channel, label ORDER BY place))""",
) + "SELECT channel, CAST(label AS INT) AS label, place, round(score, 6) AS score FROM p WHERE score >= 0.5 AND score > before AND score >= after"


def _permutation_sql(seed: int, turns: int = 6) -> str:
    """w (id, s): where the permutation puts every number below the table's size n; all of the places are moved once, then walked."""
    text = """n AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM embeddings), ab AS (SELECT n, a, (n + a - 1) // a AS b FROM n),
p0 AS (SELECT x, x // b AS l, x % b AS r, n, a, b FROM (SELECT unnest(range(a * b)) AS x, n, a, b FROM ab))"""
    for j in range(turns):
        by, moved = ("r", "l") if j % 2 == 0 else ("l", "r")
        step = f"({moved} + CAST('0x' || substr(md5('{seed}:{j}:' || {by}), 1, 15) AS BIGINT) % {'a' if j % 2 == 0 else 'b'}) % {'a' if j % 2 == 0 else 'b'}"
        text += f""",
p{j + 1} AS (SELECT x, {f'{step} AS l, r' if j % 2 == 0 else f'l, {step} AS r'}, n, a, b FROM p{j})"""
    return f"""WITH RECURSIVE {text}, f AS MATERIALIZED (SELECT x, l * b + r AS y, n FROM p{turns}),
w(id, s, n) AS (SELECT x, y, n FROM f WHERE x < n UNION ALL SELECT w.id, f.y, w.n FROM w JOIN f ON f.x = w.s WHERE w.s >= w.n) """


ORACLES: dict[str, str] = {
    "split_permuted": _permutation_sql(42)
    + "SELECT id AS row_id, CASE WHEN s < CAST(round_even(n * 0.9::DOUBLE, 0) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM w WHERE s < n",
    "epoch_permuted": _permutation_sql(42_000_129) + "SELECT id AS row_id, s AS place FROM w WHERE s < n",
    "frame_meta": "SELECT vec_id AS row_id, CAST(label AS INT) AS label, CAST(len(embedding) AS INT) AS n_samples FROM embeddings",
    "class_name_lookup": """SELECT vec_id AS row_id, CAST(label AS INT) AS label, CASE label WHEN 0 THEN 'coherent_pulse_train'
  WHEN 1 THEN 'barker_code' WHEN 2 THEN 'polyphase_barker_code' WHEN 3 THEN 'frank_code' WHEN 4 THEN 'linear_frequency_modulated'
  ELSE 'class_' || label END AS class_name FROM embeddings""",
    "iq_stack": _with(_RAW) + "SELECT row_id, CAST((pos + 32) % 64 AS INT) AS pos, round(v, 6) AS value FROM f",
    "split_seeded": f"SELECT vec_id AS row_id, {_SPLIT} AS split FROM embeddings",
    "split_hashed": """SELECT vec_id AS row_id, CASE WHEN CAST('0x' || substr(md5('42:' || vec_id), 1, 8) AS BIGINT) < CAST(floor(0.9 * 4294967296) AS BIGINT)
  THEN 'train' ELSE 'val' END AS split FROM embeddings""",
    "epoch_shuffle": "SELECT vec_id AS row_id, CAST('0x' || substr(md5('42000129:' || vec_id), 1, 8) AS BIGINT) AS place FROM embeddings",
    "load_frames": f"""SELECT vec_id AS row_id, CAST(label AS INT) AS label, CAST(len(embedding) AS INT) AS n_samples FROM embeddings
  WHERE vec_id IN ({_left_out(200)})""",
    "bank_stored": _with(*_ENCODED, "y AS (SELECT DISTINCT row_id, CAST(label AS INT) AS label FROM f)")
    + """SELECT row_id AS ref_index, label, CAST(pos AS INT) AS pos, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 4) AS value FROM z JOIN y USING (row_id)""",
    "checkpoint_stored": _with(*_ENCODED) + "SELECT row_id, CAST(pos AS INT) AS pos, round(v, 6) AS value, CAST(8 AS INT) AS latent_dim FROM z",
    "derived_rates": """SELECT run, samples, seconds, round(1000 * seconds / samples, 6) AS mean_frame_ms, round(samples / seconds, 6) AS fps FROM
  (SELECT CAST(l_linenumber AS INT) AS run, count(*) AS samples, round(sum(l_tax), 2) AS seconds FROM lineitem GROUP BY 1)""",
    "split_prefix": "SELECT vec_id AS row_id, CAST(label AS INT) AS label FROM embeddings WHERE vec_id < 100",
    "split_disjoint": f"""WITH s AS (SELECT vec_id, {_SPLIT} AS split FROM embeddings), t AS (SELECT vec_id FROM s WHERE split = 'train'), v AS (SELECT vec_id FROM s WHERE split = 'val')
SELECT 'shared' AS what, (SELECT count(*) FROM t WHERE vec_id IN (SELECT vec_id FROM v)) AS n
UNION ALL SELECT 'missing', (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM t UNION ALL SELECT vec_id FROM v))
UNION ALL SELECT 'train', (SELECT count(*) FROM t) UNION ALL SELECT 'val', (SELECT count(*) FROM v)""",
    "signal_frames": """SELECT vec_id AS row_id, CAST(label AS INT) AS label, CAST(vec_id % 41 - 20 AS INT) AS snr_db, CAST(vec_id % 5 + 2 AS INT) AS number_of_pulses,
  (vec_id % 7) / 4.0::DOUBLE AS pulse_width, (vec_id % 3) / 8.0::DOUBLE AS time_delay, (vec_id % 11) / 2.0::DOUBLE AS pulse_repetition_interval,
  vec_id AS index, CAST(len(embedding) AS INT) AS n_samples, round(CAST(embedding[33] AS DOUBLE), 6) AS first_im FROM embeddings""",
    "encode_iq": _with(*_ENCODED) + _LONG + "z",
    "normalize_energy": _with(_SCALED, _unit("u", "f", "row_id", "1e-8")) + _LONG + "u",
    "normalize_l2": _with(_SCALED, _unit("u", "f", "row_id", "1e-12")) + _LONG + "u",
    "templates_real": _with(_SCALED, _templates("1e-12")) + "SELECT CAST(label AS INT) AS label, CAST(pos AS INT) AS pos, round(v, 6) AS value FROM t",
    "templates_complex": _with(_SCALED, _templates("1e-8"))
    + """SELECT CAST(label AS INT) AS label, CAST(pos AS INT) AS pos, round(v, 6) AS value FROM t
  UNION ALL SELECT 10, CAST(r AS INT), 0.0::DOUBLE FROM (SELECT unnest(range(64)) AS r)""",
    "bank_normalize": _with(_SCALED, _unit("u", "f", "row_id, label", "1e-12"))
    + "SELECT row_id AS ref_index, CAST(label AS INT) AS label, CAST(pos AS INT) AS pos, round(v, 6) AS value FROM u",
    "knn_neighbors": _neighbour_sql(False) + "SELECT qid, y, rank, ref_index, label, round(distance, 6) AS distance FROM n",
    "knn_neighbors_normalized": _neighbour_sql(True) + "SELECT qid, y, rank, ref_index, label, round(distance, 6) AS distance FROM n",
    "bank_kmeans": _KMEANS,
    "loader_smoke": f"""WITH s AS (SELECT *, {_SPLIT} AS split FROM embeddings), p AS (SELECT * FROM s UNION ALL SELECT * REPLACE ('all' AS split) FROM s)
SELECT split, count(*) AS n_frames, min(vec_id) AS row_id, CAST(any_value(len(embedding)) AS INT) AS n_samples, round(CAST(list_min(arg_min(embedding, vec_id)) AS DOUBLE), 6) AS least,
  round(CAST(list_max(arg_min(embedding, vec_id)) AS DOUBLE), 6) AS most, CAST(arg_min(label, vec_id) AS INT) AS label FROM p GROUP BY split""",
    "quantized_neighbors": _neighbour_sql(False) + "SELECT qid, y, rank, ref_index, label, round(distance, 6) AS distance FROM n",
    "waveform_neighbours_fft": _with(
        _SCALED,
        _unit("u", "f", "row_id, label", "1e-8"),
        """c AS (SELECT a.row_id, CAST(a.label AS INT) AS label, a.pos, a.v AS re, b.v AS im FROM u a JOIN u b ON a.row_id = b.row_id AND b.pos = a.pos + 32)""",
        """l AS (SELECT q.row_id AS qid, q.label AS y, t.row_id AS ref_index, t.label, (q.pos - t.pos + 32) % 32 AS lag,
  pow(sum(q.re * t.re + q.im * t.im), 2) + pow(sum(q.im * t.re - q.re * t.im), 2) AS square FROM c q JOIN c t ON q.row_id % 10 = 0 AND t.row_id % 10 <> 0
  GROUP BY q.row_id, q.label, t.row_id, t.label, lag)""",
        "s AS (SELECT qid, y, ref_index, label, sqrt(max(square)) AS score FROM l GROUP BY qid, y, ref_index, label)",
    )
    + """SELECT * REPLACE (round(score, 6) AS score) FROM (SELECT qid, y, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, ref_index) AS INT) AS rank, ref_index, label, score FROM s)
  WHERE rank <= 5""",
    "accuracy_decoded": _with(
        *_ENCODED,
        "y0 AS (SELECT DISTINCT row_id, label FROM f)",
        "m AS (SELECT label, pos, avg(v) AS v FROM z JOIN y0 USING (row_id) WHERE row_id % 10 <> 0 GROUP BY label, pos)",
        _unit("k", "m", "label", "1e-12"),
        "x AS (SELECT label AS row_id, pos, v FROM k)",
        _layer("g", "x", 8, 16, True),
        _layer("w", "g", 16, 64, False),
        _unit("u", "w", "row_id", "1e-8"),
        "t AS (SELECT row_id AS label, pos, v FROM u)",
        _VALIDATING,
        _unit("q", "v", "row_id", "1e-8"),
        _COMPLEX,
        _TIME,
        _BEST,
    )
    + _ACCURACY,
    "signal_detections": _SIGNAL,
    "signal_detections_streamed": _SIGNAL + " AND (place // 500 + 1) * 500 + 32 <= n",
    "knn_join": _neighbour_sql(True) + "SELECT qid, y, rank, ref_index, label, round(distance, 6) AS distance FROM n",
    "train_step": _STEP,
    "knn_vote": _neighbour_sql(True) + ", " + _VOTE + " " + _VOTED,
    "knn_rejected": _neighbour_sql(True) + ", " + _VOTE.replace("FROM n ", "FROM n WHERE distance <= 1.1 ") + " " + _VOTED,
    "accuracy_knn": _neighbour_sql(True) + ", " + _VOTE + " " + _ACCURACY,
    "encode_mlp": _with(*_ENCODED) + _LONG + "z",
    "encode_mlp_by_join": _with(*_ENCODED) + _LONG + "z",
    "decode_mlp": _with(*_DECODED) + _LONG + "w",
    "recon_mse": _with(*_DECODED)
    + """SELECT round(avg(e), 6) AS mse, count(*) AS n FROM (SELECT row_id, avg(pow(f.v - w.v, 2)) AS e FROM f JOIN w USING (row_id, pos) GROUP BY row_id)""",
    "cls_ce": _with(*_ENCODED, _layer("c", "z", 8, 10, False), "y AS (SELECT DISTINCT row_id, label FROM f)")
    + """SELECT round(avg(e), 6) AS ce, count(*) AS n FROM (SELECT row_id, ln(sum(exp(v))) - max(v) FILTER (WHERE pos = label) AS e
  FROM c JOIN y USING (row_id) GROUP BY row_id)""",
    "best_epoch": _with(_EPOCH_ROWS) + "SELECT CAST(epoch AS INT) AS best_epoch, round(val_mse, 6) AS best_val_mse FROM e ORDER BY val_mse, epoch LIMIT 1",
    "epochs_improved": _with(_EPOCH_ROWS)
    + """SELECT CAST(epoch AS INT) AS epoch, val_mse, coalesce(val_mse < min(val_mse) OVER (ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM e""",
    "stats_class_counts": """SELECT CAST(d.label AS INT) AS label, count(e.label) AS n,
  round(100.0::DOUBLE * count(e.label) / greatest((SELECT count(*) FROM embeddings), 1), 6) AS percent
  FROM (SELECT unnest(range(12)) AS label) d LEFT JOIN embeddings e ON e.label = d.label GROUP BY d.label""",
    "stats_histogram": "SELECT CAST(trunc(l_quantity) AS INT) AS value, count(*) AS n FROM lineitem GROUP BY 1",
    "stats_n_unique": "SELECT count(DISTINCT l_quantity) AS n_unique FROM lineitem",
    "stats_split_counts": f"""SELECT s.split, CAST(c.label AS INT) AS label, count(e.label) AS n FROM (VALUES ('train'), ('val')) AS s(split)
  CROSS JOIN (SELECT unnest(range(10)) AS label) c LEFT JOIN (SELECT label, {_SPLIT} AS split
  FROM embeddings) e ON e.split = s.split AND e.label = c.label GROUP BY s.split, c.label""",
    "bank_subsample": """SELECT ref_index, label FROM (SELECT vec_id AS ref_index, CAST(label AS INT) AS label, row_number() OVER (PARTITION BY label
  ORDER BY CAST('0x' || substr(md5('42:' || vec_id), 1, 8) AS BIGINT), vec_id) AS r FROM embeddings) WHERE r <= 20""",
    "mf_multi_template": _with(
        _SCALED,
        "m AS (SELECT label, (row_id // 10) % 3 AS grp, pos, avg(v) AS v FROM f WHERE row_id % 10 <> 0 GROUP BY label, (row_id // 10) % 3, pos)",
        _unit("t", "m", "label, grp", "1e-12"),
        _VALIDATING,
        _unit("q", "v", "row_id", "1e-12"),
        """l AS (SELECT q.row_id, t.label, t.grp, sum(q.v * t.v) AS score FROM q JOIN t USING (pos) GROUP BY q.row_id, t.label, t.grp),
s AS (SELECT row_id, label, max(score) AS score FROM l GROUP BY row_id, label)""",
        _BEST,
    )
    + "SELECT row_id, y, pred, round(score, 6) AS score FROM p",
    "templates_decoded": _with(
        *_ENCODED,
        "y AS (SELECT DISTINCT row_id, label FROM f)",
        "m AS (SELECT label, pos, avg(v) AS v FROM z JOIN y USING (row_id) GROUP BY label, pos)",
        _unit("t", "m", "label", "1e-12"),
        "x AS (SELECT label AS row_id, pos, v FROM t)",
        _layer("g", "x", 8, 16, True),
        _layer("w", "g", 16, 64, False),
        _unit("u", "w", "row_id", "1e-8"),
    )
    + "SELECT CAST(row_id AS INT) AS label, CAST(pos AS INT) AS pos, round(v, 6) AS value FROM u",
    "latent_retrieval": _with(
        *_ENCODED,
        "y0 AS (SELECT DISTINCT row_id, CAST(label AS INT) AS label FROM f)",
        """d AS (SELECT a.row_id AS qid, b.row_id AS ref_index, sqrt(sum(pow(a.v - b.v, 2))) AS distance FROM z a JOIN z b ON a.pos = b.pos
  WHERE a.row_id % 10 = 0 AND b.row_id % 10 <> 0 GROUP BY a.row_id, b.row_id)""",
        """n AS (SELECT qid, q.label AS y, r.label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, ref_index) AS rank FROM d) k
  JOIN y0 q ON q.row_id = qid JOIN y0 r ON r.row_id = ref_index WHERE rank <= 5)""",
        _VOTE,
    )
    + _ACCURACY,
    "classify_by_network": _with(*_ENCODED, _layer("c", "z", 8, 10, False), "y AS (SELECT DISTINCT row_id, CAST(label AS INT) AS y FROM f)")
    + """SELECT row_id, y, CAST(pos AS INT) AS pred, round(v, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(v, 12) DESC, pos) AS r FROM c)
  JOIN y USING (row_id) WHERE r = 1""",
    "bank_prototypes": _with(_SCALED, _templates("1e-12")) + "SELECT CAST(label AS INT) AS label, CAST(pos AS INT) AS pos, round(v, 6) AS value FROM t",
    "bank_footprint": "SELECT count(*) AS n_refs, CAST(sum(len(embedding)) * 4 AS BIGINT) AS n_bytes FROM embeddings WHERE vec_id % 10 <> 0",
    "waveform_neighbours": _with(
        _SCALED,
        _unit("u", "f", "row_id, label", "1e-8"),
        """c AS (SELECT a.row_id, a.label, a.pos, a.v AS re, b.v AS im FROM u a JOIN u b ON a.row_id = b.row_id AND b.pos = a.pos + 32)""",
        """s AS (SELECT q.row_id AS qid, CAST(q.label AS INT) AS y, t.row_id AS ref_index, CAST(t.label AS INT) AS label,
  sqrt(pow(sum(q.re * t.re + q.im * t.im), 2) + pow(sum(q.im * t.re - q.re * t.im), 2)) AS score FROM c q JOIN c t USING (pos)
  WHERE q.row_id % 10 = 0 AND t.row_id % 10 <> 0 GROUP BY q.row_id, q.label, t.row_id, t.label)""",
        "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ref_index) AS rank FROM s) WHERE rank <= 5)",
        _VOTE,
    )
    + _VOTED,
}
for _mode in ("cosine", "time", "fft"):
    ORACLES[f"mf_{_mode}"] = _filter_sql(_mode) + "SELECT row_id, y, pred, round(score, 6) AS score FROM p"
    ORACLES[f"accuracy_{_mode}"] = _filter_sql(_mode) + _ACCURACY
ORACLES["mf_fft_by_expressions"] = ORACLES["mf_fft"]
_SEEDED = f"row_id IN (SELECT vec_id FROM embeddings WHERE {_VAL})"
ORACLES["runtime_counts"] = (
    _filter_sql("fft").replace(_SCALED, _RAW).replace("row_id % 10 <> 0", f"NOT {_SEEDED}").replace("row_id % 10 = 0", _SEEDED)
    + "SELECT 'fft' AS mode, 'val' AS split, total AS samples, accuracy, correct, total FROM ("
    + _ACCURACY
    + ")"
)
ORACLES["comparison"] = " UNION ALL ".join(
    f"SELECT '{m}' AS method, accuracy, total, {n} AS n_bytes FROM ({ORACLES[f'accuracy_{m}']})"
    for m, n in (*((m, "(SELECT CAST(count(DISTINCT label) * max(len(embedding)) * 4 AS BIGINT) FROM embeddings WHERE vec_id % 10 <> 0)") for m in ("cosine", "time", "fft")), ("knn", "(SELECT CAST(sum(len(embedding)) * 4 AS BIGINT) FROM embeddings WHERE vec_id % 10 <> 0)"))
)
