"""Vectors in array columns: expressions only, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guards against division by zero: unit energy and unit length use different ones.
ENERGY_FLOOR, LENGTH_FLOOR = 1e-8, 1e-12


def doubles(a) -> Column:
    """Cast before any arithmetic: products of floats would stay floats."""
    return F.col(a).cast("array<double>") if isinstance(a, str) else a.cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled_to_unit(a: Column, floor: float = LENGTH_FLOOR) -> Column:
    norm = F.greatest(length(a), F.lit(floor))
    return F.transform(a, lambda v: v / norm)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def stacked(re: Column, im: Column) -> Column:
    """One real vector [re..., im...] of a complex one."""
    return F.concat(re, im)


def real(x: Column) -> Column:
    return F.slice(x, F.lit(1), (F.size(x) / 2).cast("int"))


def imaginary(x: Column) -> Column:
    half = (F.size(x) / 2).cast("int")
    return F.slice(x, half + 1, half)


def hermitian_magnitude(x: Column, m: Column) -> Column:
    """Magnitude of sum x * conj(m) of stacked complex vectors."""
    a, b, c, d = real(x), imaginary(x), real(m), imaginary(m)
    return F.hypot(dot(a, c) + dot(b, d), dot(b, c) - dot(a, d))


def rotated(a: Column, k: Column) -> Column:
    """The vector moved right by k places, circularly."""
    n = F.size(a)
    at = (n - k).cast("int")
    return F.concat(F.slice(a, at + 1, k.cast("int")), F.slice(a, F.lit(1), at))


def circular_peak(x: Column, m: Column) -> Column:
    """Largest Hermitian magnitude over all circular shifts of m; quadratic, for short frames and as a check."""
    n = (F.size(x) / 2).cast("int")
    shifts = F.sequence(F.lit(0), n - 1)
    return F.array_max(
        F.transform(shifts, lambda k: hermitian_magnitude(x, F.concat(rotated(real(m), k), rotated(imaginary(m), k))))
    )


def turned(m) -> Column:
    """For each circular shift of a stacked complex vector the two real vectors whose products with another are the real and the imaginary
    part of their Hermitian product."""
    m = doubles(m)
    n = (F.size(m) / 2).cast("int")

    def at(k):
        re, im = rotated(real(m), k), rotated(imaginary(m), k)
        return F.struct(F.concat(re, im).alias("re"), F.concat(F.transform(im, lambda v: -v), re).alias("im"))

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def turned_magnitude(x: Column, m: Column) -> Column:
    """Magnitude of the Hermitian product with one of `turned`."""
    return F.hypot(dot(x, m["re"]), dot(x, m["im"]))


def mean_square(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax(logits)[label], shifted by the maximum."""
    top = F.array_max(logits)
    return F.log(total(F.transform(logits, lambda v: F.exp(v - top)))) + top - F.element_at(logits, (label + 1).cast("int"))


def finite(a: Column) -> Column:
    """Whether no component is null, NaN or infinite."""
    return a.isNotNull() & F.forall(a, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
