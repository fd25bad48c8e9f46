"""Rounding shared by queries and their SQL.

Sums of cents over 3, 6 or 12 months often end exactly on half a unit of the last digit,
where two correct engines may round apart. Both sides add the same small shift first.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SHIFT = 3.7e-10


def rnd(column: str | Column, digits: int = 6) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value + F.lit(SHIFT), digits)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column; ``special`` gives other digits by name."""
    return df.select(*[
        rnd(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])
