"""Small frame helpers."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate) to every row."""
    return df.crossJoin(F.broadcast(one_row.limit(1)))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def average_rank(value: str, partition: Sequence[str], descending: bool = True) -> Column:
    """Rank with ties averaged. For partitions bounded by the calendar or a registry."""
    from pyspark.sql import Window

    order = F.desc(value) if descending else F.asc(value)
    ties = Window.partitionBy(*partition, value)
    return F.rank().over(Window.partitionBy(*partition).orderBy(order)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where NULL equals NULL; the keys of the left side are kept."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])
