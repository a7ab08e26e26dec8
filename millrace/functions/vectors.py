"""Vectors as arrays: expressions that stay within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def conformed(a: Column, dims: int) -> Column:
    """Padded with zeros or cut to a number of dimensions."""
    return F.slice(F.concat(a.cast("array<double>"), F.array_repeat(F.lit(0.0), dims)), 1, dims)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def quantised(a: Column) -> Column:
    """A unit vector as bytes: 127 times each element, half to even."""
    return F.transform(unit(a), lambda x: F.rint(x * 127).cast("tinyint"))
