"""Reference banks: building, reducing, writing with a manifest, loading with checks."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions import vec
from framewright.operators import mlp, split, templates, versions


def from_frames(frames: DataFrame, normalize: bool = False) -> DataFrame:
    """(ref_index, z, label) of frames themselves."""
    z = vec.doubles("x")
    return frames.select(F.col("row_id").alias("ref_index"), (vec.scaled_to_unit(z) if normalize else z).alias("z"), F.col("label").cast("int").alias("label"))


def encoded(frames: DataFrame, encoder: mlp.Mlp) -> DataFrame:
    z = mlp.apply(frames.select("row_id", "x", F.col("label").cast("int").alias("label")), encoder)
    return z.select(F.col("row_id").alias("ref_index"), "z", "label")


def export(frames: DataFrame, encoder: mlp.Mlp, path: str, **config) -> dict:
    """Publish the bank together with a manifest that names the weights and the run, as a new version of `path`, so that a bank can't be
    paired with others unnoticed, and a write that fails leaves the one before. Returns the manifest."""
    manifest = config | {"weights_sha256": encoder.digest(), "input_dim": encoder.weights[0].shape[1], "latent_dim": encoder.weights[-1].shape[0]}
    bank = encoded(frames, encoder).withColumn("z", F.col("z").cast("array<float>"))
    return versions.publish(frames.sparkSession, path, {"bank": bank}, manifest).manifest


def manifest_of(spark: SparkSession, path: str) -> dict:
    return versions.current(spark, path).manifest


def load(spark: SparkSession, path: str, encoder: mlp.Mlp | None = None, strict: bool = True) -> DataFrame:
    """The bank's latest version; with an encoder, only if its weights made it. With `strict` off that is a warning, as is customary
    where a checkpoint and a data set don't belong together."""
    version = versions.current(spark, path)
    if encoder is not None and version.manifest["weights_sha256"] != encoder.digest():
        said = f"the bank at {path} was made by other weights"
        if strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    return version.table("bank").withColumn("z", F.col("z").cast("array<double>"))


def prototypes(bank: DataFrame, num_classes: int, dim: int) -> DataFrame:
    """A bank of one unit-length centroid per class."""
    mean = templates.templates(bank.select(F.col("z").alias("x"), "label"), num_classes, dim)
    return mean.select(F.col("label").cast("long").alias("ref_index"), F.col("mu").alias("z"), "label")


def subsample(bank: DataFrame, per_class: int, seed: int = 42) -> DataFrame:
    """At most `per_class` references of each class, chosen by a hash of their index."""
    rank = F.row_number().over(W.partitionBy("label").orderBy(split.hash32(seed, "ref_index"), "ref_index"))
    return bank.withColumn("r", rank).where(F.col("r") <= per_class).drop("r")


def footprint(bank: DataFrame) -> DataFrame:
    """One row: references and the bytes of their float32 components."""
    return bank.agg(F.count(F.lit(1)).alias("n_refs"), F.coalesce(F.sum(F.size("z").cast("long") * 4), F.lit(0)).alias("n_bytes"))
