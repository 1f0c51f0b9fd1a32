"""Array helpers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it, inside other lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(steps: Column) -> Column:
    """Inclusive prefix sums of an int array, by chunks, so that long arrays cost far less than their square."""

    def sums(s: Column) -> Column:
        part = lambda k, n: F.aggregate(F.slice(s, k * _CHUNK + 1, n), F.lit(0), lambda a, x: a + x)
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / F.lit(_CHUNK)).cast("int")), lambda k: part(k, F.lit(_CHUNK)))
        before = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + x)))
        of = lambda i: F.floor(i / F.lit(_CHUNK)).cast("int")
        return let(before, lambda b: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(b, of(i)) + part(of(i), i % _CHUNK + 1)))

    return let(steps, lambda s: F.when(F.size(s) <= 0, F.array().cast("array<int>")).otherwise(sums(s)))
