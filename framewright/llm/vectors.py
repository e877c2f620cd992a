"""Vectors as Spark rows and as numpy matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.shipping import ship


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, a vector that isn't null, empty or zero, and finite components. Components are
    doubles, which hold those of any numeric column as they are."""
    ship(vectors.sparkSession)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def matrix(column) -> np.ndarray:
    """Rows of equal length of an Arrow list column as a matrix of doubles."""
    values = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(values), -1)
