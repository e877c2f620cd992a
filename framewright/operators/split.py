"""Splitting rows into train and validation sets.

`seeded` repeats a numpy permutation exactly, which needs a number per row on the driver: for tables of up to
`SEEDED_ROWS` rows. `hashed` splits tables of any size without moving a row, and is what a table without that
permutation's history wants.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEEDED_ROWS = 10_000_000
SPLITS = ("train", "val", "test", "all")


def checked(split: str) -> str:
    split = split.lower()
    if split not in SPLITS:
        raise ValueError(f"split must be one of {', '.join(SPLITS)}, not {split!r}")
    return split


def train_size(n: int, fraction: float, rounding: str = "half_even") -> int:
    """How many of n rows train; Python's round is half to even."""
    if rounding not in ("half_even", "floor"):
        raise ValueError("rounding must be half_even or floor")
    return int(round(n * fraction)) if rounding == "half_even" else int(n * fraction)


def validation_rows(n: int, fraction: float = 0.9, seed: int = 42, rounding: str = "half_even") -> np.ndarray:
    """Positions, ascending, that a seeded permutation leaves for validation."""
    return np.sort(np.random.default_rng(seed).permutation(n)[train_size(n, fraction, rounding) :])


def prefix(frames: DataFrame, n: int | None, order: str = "row_id") -> DataFrame:
    """The first n rows by their order key, as a filter that reaches the scan; never a limit without an order."""
    return frames if n is None else frames.where(F.col(order) < n)


def labelled(frames: DataFrame, n: int, fraction: float = 0.9, seed: int = 42, rounding: str = "half_even", order: str = "row_id") -> DataFrame:
    """Frames with a column `split`; the order key must run from 0 to n - 1. The smaller part's ids are joined."""
    if n > SEEDED_ROWS:
        raise ValueError(f"a seeded permutation of {n} rows doesn't fit; use hashed()")
    ids = frames.sparkSession.createDataFrame(pa.table({order: validation_rows(n, fraction, seed, rounding).astype(np.int64)}))
    ids = ids.withColumn("split", F.lit("val"))
    ids = F.broadcast(ids) if n <= 1_000_000 else ids
    return frames.join(ids, order, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def seeded(frames: DataFrame, split: str, n: int, **options) -> DataFrame:
    """The rows of one split; test is the same as val."""
    split = checked(split)
    if split == "all":
        return frames
    wanted = "train" if split == "train" else "val"
    return labelled(frames, n, **options).where(F.col("split") == wanted).drop("split")


def hash32(seed: int, key: str):
    """A number below 2^32 for each key, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")


def hashed(frames: DataFrame, split: str, fraction: float = 0.9, seed: int = 42, order: str = "row_id") -> DataFrame:
    """About `fraction` of the rows to train, decided row by row by the first 32 bits of an MD5 of seed and key."""
    split = checked(split)
    if split == "all":
        return frames
    train = hash32(seed, order) < int(fraction * (1 << 32))
    return frames.where(train if split == "train" else ~train)


def epoch_order(frames: DataFrame, epoch: int, seed: int = 42, order: str = "row_id") -> DataFrame:
    """Frames with `place`, a number that orders them anew in every epoch; sorted by ranges, so that no task gets all rows."""
    key = hash32(seed * 1_000_003 + epoch, order)
    return frames.withColumn("place", key).repartitionByRange("place", order).sortWithinPartitions("place", order)


def modular(frames: DataFrame, split: str, order: str = "row_id", modulus: int = 10) -> DataFrame:
    """Every `modulus`-th row validates."""
    split = checked(split)
    if split == "all":
        return frames
    return frames.where(F.col(order) % modulus != 0) if split == "train" else frames.where(F.col(order) % modulus == 0)
