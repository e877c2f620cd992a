"""Class-mean templates: a mean vector per class, scaled to unit length or energy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.vec import ENERGY_FLOOR, LENGTH_FLOOR, doubles, scaled_to_unit


def means(frames: DataFrame, x: str = "x", label: str = "label") -> DataFrame:
    """(label, pos, value) of the class means. Partial sums are made before the shuffle, so what moves is
    classes x positions per task, however many frames there are."""
    return frames.select(label, F.posexplode(doubles(x)).alias("pos", "v")).groupBy(label, "pos").agg(F.avg("v").alias("value"))


def templates(frames: DataFrame, num_classes: int, dim: int, floor: float = LENGTH_FLOOR) -> DataFrame:
    """(label, mu) for every class of the domain; a class without frames keeps a zero vector."""
    whole = means(frames).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("at"))
    whole = whole.select("label", scaled_to_unit(F.col("at.value"), floor).alias("mu"))
    domain = frames.sparkSession.range(num_classes).select(F.col("id").cast("int").alias("label"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return domain.join(whole, "label", "left").select("label", F.coalesce("mu", zero).alias("mu"))


def grouped_templates(frames: DataFrame, group: str, floor: float = LENGTH_FLOOR) -> DataFrame:
    """(label, grp, mu): a template for each class and value of `group` that has frames, such as a noise level. With several
    templates a class scores as its best one."""
    parts = frames.select("label", F.col(group).alias("grp"), F.posexplode(doubles("x")).alias("pos", "v"))
    at = parts.groupBy("label", "grp", "pos").agg(F.avg("v").alias("value"))
    whole = at.groupBy("label", "grp").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("at"))
    return whole.select(F.col("label").cast("int").alias("label"), "grp", scaled_to_unit(F.col("at.value"), floor).alias("mu"))


def complex_templates(frames: DataFrame, num_classes: int, n_samples: int) -> DataFrame:
    """Templates of unit energy from stacked complex frames: the stacked length is the complex energy's root."""
    return templates(frames, num_classes, 2 * n_samples, ENERGY_FLOOR)


def long_form(of: DataFrame, vector: str = "mu") -> DataFrame:
    return of.select("label", F.posexplode(vector).alias("pos", "value"))
