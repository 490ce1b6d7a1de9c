"""Helpers for array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: a name used inside a lambda may be computed for each element."""
    return F.transform(F.array(value), body)[0]


def indices(n: Column | int) -> Column:
    """[0 .. n - 1]; empty for n <= 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(values: Column) -> Column:
    """Null for an empty array."""
    return total(values) / F.nullif(F.size(values), F.lit(0))


def median(values: Column) -> Column:
    """The middle value, or the mean of the two middle ones; null for an empty array."""

    def of(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (s[F.floor((n - 1) / 2).cast("int")].cast("double") + s[F.floor(n / 2).cast("int")].cast("double")) / 2)

    return let(F.array_sort(values), of)
