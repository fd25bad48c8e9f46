"""Student t as Arrow-batched column functions. They only ever see summary rows."""
from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from panelwright.functions import student_t

# workers need no installed copy of these two modules
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(student_t)


@F.pandas_udf(DoubleType())
def _two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    good = t.notna() & (df > 0)
    return pd.Series([student_t.two_sided_p(a, b) if g else None for a, b, g in zip(t, df, good)], dtype="float64")


@F.pandas_udf(DoubleType())
def _quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    good = p.notna() & (df > 0)
    cache: dict = {}
    out = []
    for a, b, g in zip(p, df, good):
        if g and (a, b) not in cache:
            cache[a, b] = student_t.quantile(a, b)
        out.append(cache[a, b] if g else None)
    return pd.Series(out, dtype="float64")


def _null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def two_sided_p(t: Column, df: Column) -> Column:
    return _null(_two_sided_p(t, df.cast("double")))


def t_quantile(p: Column, df: Column) -> Column:
    return _null(_quantile(p, df.cast("double")))


def t_interval(mean: Column, sd: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Confidence bounds of a mean: NULL below two values, equal bounds when nothing varies."""
    se = sd / F.sqrt(n)
    margin = F.when(se == 0, F.lit(0.0)).otherwise(t_quantile(F.lit(1 - (1 - confidence) / 2), n - 1) * se)
    return F.when(n >= 2, mean - margin), F.when(n >= 2, mean + margin)
