"""A seeded permutation of 0 .. n - 1 as a column expression: no array on the driver, no join, no sort, for any n.

An alternating Feistel network over a x b places, with a = ceil(sqrt(n)) and b = ceil(n / a): a number is split into l below a and r below b, and
by turns l moves by a hash of r (mod a) and r by a hash of l (mod b). Every turn can be undone, so the whole is a permutation of
a b places. Places of n and above, fewer than a of them, are walked on from until one below n comes (cycle walking), which makes it a
permutation of n. A walk through m such places ends after m + 1 steps at most; as only one number in sqrt(n) starts one, the mean cost
is that of one pass. The hash is MD5's first 60 bits of `seed:turn:value`, which other engines can repeat.

A null stays null; a number outside 0 .. n - 1 is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.split import checked, train_size

TURNS = 6


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def _hash(seed: int, turn: Column, value: Column, modulus: int) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(modulus)


def sides(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def _pass(s: Column, a: int, b: int, seed: int, back: bool) -> Column:
    """All turns once over the a x b places, or undone."""
    turns = range(TURNS - 1, -1, -1) if back else range(TURNS)
    sign = -1 if back else 1

    def turn(s: Column, j: Column) -> Column:
        left, right = _div(s, b), s % b
        moved_left = F.pmod(left + sign * _hash(seed, j, right, a), F.lit(a)) * b + right
        moved_right = left * b + F.pmod(right + sign * _hash(seed, j, left, b), F.lit(b))
        return F.when(j % 2 == 0, moved_left).otherwise(moved_right)

    return F.aggregate(F.array(*map(F.lit, turns)), s, turn)


def permuted(position: Column, n: int, seed: int, back: bool = False) -> Column:
    """Where the permutation puts a position; with `back`, which position it puts there."""
    a, b = sides(n)
    outside = a * b - n
    valid = F.assert_true(position.isNull() | ((position >= 0) & (position < n)), F.lit(f"a position outside 0 .. {n - 1}"))
    start = F.when(valid.isNull(), position.cast("long"))
    if outside == 0:
        return _pass(start, a, b, seed, back)

    def walked(s: Column) -> Column:
        steps = F.when(s < n, F.array().cast("array<long>")).otherwise(F.sequence(F.lit(1).cast("long"), F.lit(outside).cast("long")))
        return F.when(s.isNotNull(), F.aggregate(steps, s, lambda t, _: F.when(t < n, t).otherwise(_pass(t, a, b, seed, back))))

    # an array of one binds the first pass's result, which the walk looks at several times
    return F.element_at(F.transform(F.array(_pass(start, a, b, seed, back)), walked), 1)


def split_exactly(frames: DataFrame, split: str, n: int, fraction: float = 0.9, seed: int = 42, rounding: str = "half_even", order: str = "row_id") -> DataFrame:
    """The rows of one split of a table whose order key runs from 0 to n - 1: of exactly the sizes that `rounding` says."""
    split = checked(split)
    if split == "all":
        return frames
    trains = permuted(F.col(order), n, seed) < train_size(n, fraction, rounding)
    return frames.where(trains if split == "train" else ~trains)


def epoch_places(frames: DataFrame, n: int, epoch: int, seed: int = 42, order: str = "row_id") -> DataFrame:
    """Frames with `place`, their position in an epoch's order: a permutation of 0 .. n - 1, so that rows `batch` k to
    `batch` (k + 1) - 1 make up batches of exactly that size."""
    return frames.withColumn("place", permuted(F.col(order), n, seed * 1_000_003 + epoch))
