"""Statistics of labelled tables over a fixed domain of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(rows: DataFrame, num_classes: int, label: str = "label") -> DataFrame:
    """(label, n, percent) of every class of the domain. Labels outside it aren't listed but count in the percentage."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    all_rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    domain = rows.sparkSession.range(num_classes).select(F.col("id").cast("int").alias("label"))
    listed = domain.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    return listed.crossJoin(F.broadcast(all_rows)).select("label", "n", (100.0 * F.col("n") / F.greatest("all", F.lit(1))).alias("percent"))


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """(value, n), values truncated to integers."""
    return rows.groupBy(F.col(value).cast("int").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def n_unique(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(F.countDistinct(value).alias("n_unique"))


def split_counts(rows: DataFrame, num_classes: int, splits=("train", "val")) -> DataFrame:
    """(split, label, n) of every split and class, zero-filled; `rows` have split and label."""
    spark = rows.sparkSession
    domain = spark.createDataFrame([(s, c) for s in splits for c in range(num_classes)], "split string, label int")
    counts = rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    return domain.join(counts, ["split", "label"], "left").select("split", "label", F.coalesce("n", F.lit(0)).alias("n"))


def class_names(rows: DataFrame, names: dict[int, str], label: str = "label") -> DataFrame:
    """Rows with `class_name`; an unknown class is an error, not a dropped row."""
    known = rows.sparkSession.createDataFrame(sorted(names.items()), f"{label} int, class_name string")
    named = rows.join(F.broadcast(known), label, "left")
    return named.where(F.assert_true(F.col("class_name").isNotNull(), F.lit("unknown class id")).isNull())
