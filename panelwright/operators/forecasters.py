"""Closed-form forecasters as column expressions over one training array.

Each takes ``y`` (training values, no NULL) and the horizon and gives ``array<double>``
of length ``horizon``. All models of a series are computed in the same row, so a
back-test needs no shuffle after the panel is packed.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from panelwright.functions import arrays as A

Forecaster = Callable[[Column, Column], Column]


def _steps(horizon: Column) -> Column:
    return F.sequence(F.lit(1), horizon)


def naive_last(y: Column, horizon: Column) -> Column:
    return F.array_repeat(A.at(y, F.size(y) - 1), horizon)


def seasonal_naive(y: Column, horizon: Column, season: int = 12) -> Column:
    n = F.size(y)
    last_year = F.transform(_steps(horizon), lambda s: F.get(y, n - season + (s - 1) % season))
    return F.when(n < season, naive_last(y, horizon)).otherwise(last_year)


def drift(y: Column, horizon: Column) -> Column:
    n = F.size(y)
    last, first = A.at(y, n - 1), A.at(y, 0)
    slope = F.when(n > 1, (last - first) / (n - 1)).otherwise(F.lit(0.0))
    return F.transform(_steps(horizon), lambda s: last + slope * s)


def seasonal_drift(y: Column, horizon: Column, season: int = 12) -> Column:
    n = F.size(y)
    k = F.least(F.lit(season), n - season)
    recent = A.mean(F.slice(y, n - k + 1, k))
    earlier = A.mean(F.slice(y, n - season - k + 1, k))
    step = F.when(k >= 1, (recent - earlier) / season).otherwise(F.lit(0.0))
    base = seasonal_naive(y, horizon, season)
    moved = A.let(step, lambda d: F.transform(base, lambda v, i: v + d * (i + 1)))
    return F.when(n < season, naive_last(y, horizon)).otherwise(moved)


CLOSED_FORM: dict[str, Forecaster] = {
    "naive_last": naive_last,
    "seasonal_naive": seasonal_naive,
    "drift": drift,
    "seasonal_drift": seasonal_drift,
}


def build(name: str) -> Forecaster:
    if name not in CLOSED_FORM:
        raise KeyError(f"unknown model {name!r}; known: {sorted(CLOSED_FORM)}")
    return CLOSED_FORM[name]
