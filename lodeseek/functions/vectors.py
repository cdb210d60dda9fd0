"""Vectors as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def is_finite(a: Column) -> Column:
    """Whether every component is a finite number."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def normalised(a: Column) -> Column:
    """The unit vector; null for vectors that are null, of norm zero, or hold a null or non-finite component."""
    n = norm(a)
    return F.when(is_finite(a) & (n > 0), F.transform(a, lambda x: x / n))
