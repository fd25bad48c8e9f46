"""Expressions over one series held as ``array<double>``.

A series never has more elements than the calendar has months, so one array per
row is bounded by the protocol, not by the data.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def mean(arr: Column) -> Column:
    return let(arr, lambda a: F.when(F.size(a) > 0, total(a) / F.size(a)))


def sum_of_squares(arr: Column, centre: Column | None = None) -> Column:
    if centre is None:
        return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x * x)
    return let(centre, lambda c: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - c) * (x - c)))


def variance_pop(arr: Column) -> Column:
    return let(arr, lambda a: F.when(F.size(a) > 0, sum_of_squares(a, mean(a)) / F.size(a)))


def median(arr: Column) -> Column:
    """Median of an array without NULLs, mean of the two middle values when even."""
    def middle(s: Column) -> Column:
        n = F.size(s)
        low = F.get(s, F.floor((n - 1) / 2).cast("int"))
        high = F.get(s, F.floor(n / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2.0)

    return let(F.array_sort(arr), middle)


def at(arr: Column, position: Column | int) -> Column:
    """Zero-based element, NULL outside the array."""
    pos = F.lit(position) if isinstance(position, int) else position
    return F.when(pos >= 0, F.get(arr, pos))


def head(arr: Column, n: Column | int) -> Column:
    return F.slice(arr, 1, n)


def window(arr: Column, start: Column, length: Column | int) -> Column:
    """``length`` elements from the zero-based ``start``."""
    size = F.lit(length) if isinstance(length, int) else length
    return F.slice(arr, start + 1, size)


def has_null(arr: Column) -> Column:
    return F.exists(arr, lambda x: x.isNull() | F.isnan(x))


def diffs(arr: Column) -> Column:
    def steps(a: Column) -> Column:
        n = F.size(a)
        moved = F.zip_with(F.slice(a, 2, F.greatest(n - 1, F.lit(0))), F.slice(a, 1, F.greatest(n - 1, F.lit(0))), lambda y, x: y - x)
        return F.when(n >= 2, moved).otherwise(F.array().cast("array<double>"))

    return let(arr, steps)
