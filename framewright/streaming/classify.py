"""Beyond the reference: templates applied to a stream of frames, and running accuracy per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import vec
from framewright.operators import score


def classify(stream: DataFrame, templates: DataFrame) -> DataFrame:
    """A streaming frame table (row_id, label, x, ts) with `pred` by cosine. Stateless: the templates, a row per class, are
    turned into one constant column, so no join or aggregation holds state."""
    rows = templates.orderBy("label").collect()
    known = F.array(*(F.struct(F.lit(r["label"]).alias("label"), F.array(*map(F.lit, r["mu"])).alias("mu")) for r in rows))
    unit = vec.scaled_to_unit(vec.doubles("x"))
    return stream.withColumn("pred", -score.best_in_row(known, unit, vec.dot)["order"])


def windowed_accuracy(predictions: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    good = F.sum((F.col("pred") == F.col("label")).cast("long")).alias("correct")
    return predictions.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(good, F.count(F.lit(1)).alias("total"))
