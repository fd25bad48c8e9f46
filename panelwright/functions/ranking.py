"""A global 0-based rank without sending all rows through one task."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def global_rank(df: DataFrame, order_value: str, tie_key: str, name: str = "rank0", slices: int = 256) -> DataFrame:
    """Rank by ``order_value``; equal values are ordered by the hash of ``tie_key``.

    A bounded action reads at most ``slices`` cut points, so everything after it is
    deterministic. Rows fall into value slices; rows equal to a cut (one value may hold
    a third of all rows) are split again by the top byte of the hash. Slice sizes are
    summed over at most 512 * 256 rows and rows are numbered inside their slice.
    """
    steps = [i / slices for i in range(1, slices)]
    found = df.agg(F.percentile_approx(order_value, steps, 10_000).alias("c")).first()["c"]
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(found or []))]).cast("array<double>")
    value, tie = F.col(order_value), F.xxhash64(F.col(tie_key))
    equal = F.array_contains(cuts, value)
    sliced = (
        df.withColumn("_slice", F.size(F.filter(cuts, lambda c: c < value)) * 2 + equal.cast("int"))
        .withColumn("_tie", tie)
        .withColumn("_part", F.when(equal, F.shiftright("_tie", 56)).otherwise(F.lit(0)))
    )
    sizes = sliced.groupBy("_slice", "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_slice", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_slice", "_part").orderBy(order_value, "_tie", tie_key)
    return (
        sliced.withColumn("_n", F.row_number().over(inside) - 1)
        .join(offsets, ["_slice", "_part"])
        .withColumn(name, (F.col("_n") + F.col("_offset")).cast("bigint"))
        .drop("_slice", "_part", "_tie", "_n", "_offset")
    )
