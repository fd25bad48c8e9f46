"""Aggregate expressions of two columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation, NULL where one side does not vary (the built-in raises there in ANSI mode)."""
    xx, yy, xy = F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    return F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx * yy))
