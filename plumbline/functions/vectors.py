"""Column functions on ``array<double>`` vectors. Sums run from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, s) -> Column:
    return F.transform(a, lambda x: x * s)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def normalize(a: Column) -> Column:
    """Null for a zero vector or one with a NaN."""
    n = norm(a)
    return F.when((n > 0) & ~F.isnan(n), F.transform(a, lambda x: x / n))


def quantize(a: Column, step: float, offset: float = 0.0) -> Column:
    """Scalar quantizer: the nearest multiple of ``step`` moved by ``offset``."""
    return F.transform(a, lambda x: F.floor((x + offset) / step + 0.5).cast("double") * step - offset)


def guarded_ratio(num: Column, den: Column, eps: float = 1e-12) -> Column:
    return F.when(F.abs(den) > eps, num / den)
