"""Vector expressions over ARRAY<FLOAT|DOUBLE>; sums are taken in DOUBLE, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def unit(a: Column) -> Column:
    """The vector at length 1; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def closeness(a: Column, b: Column) -> dict[str, Column]:
    """Mean and largest absolute difference, mean relative difference and cosine of two vectors."""
    diff = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    relative = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")) / (F.abs(x.cast("double")) + F.abs(y.cast("double")) + F.lit(1e-8)))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    return {"mean_abs": mean(diff), "max_abs": F.array_max(diff), "mean_relative": mean(relative), "cosine": cosine(a, b)}
