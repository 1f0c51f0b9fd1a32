"""Vectors as arrays: dot product over the shorter length, normalisation, padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in order and in doubles, over the shorter of the two; a null vector counts as empty."""
    n = F.least(F.size(F.coalesce(a, F.array().cast("array<double>"))), F.size(F.coalesce(b, F.array().cast("array<double>"))))
    products = F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, 1, F.greatest(n, F.lit(0))), lambda x, y: x.cast("double") * y.cast("double"))
    return F.coalesce(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def unit(v: Column) -> Column:
    """The vector over its length; empty if that is zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.array().cast("array<double>"))


def padded(v: Column, size: int) -> Column:
    """Cut or filled with zeros to size."""
    return F.slice(F.concat(F.coalesce(v, F.array().cast("array<float>")), F.array_repeat(F.lit(0.0).cast("float"), size)), 1, size)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
