"""Exact linear-interpolated quantiles of groups that may be very large.

``percentile`` keeps every distinct value of a group in one task. That is fine for
a group bounded by the calendar (one series), not for "all series of one month".
Here the group is narrowed first:

1. ``percentile_approx`` (a mergeable sketch, combined map-side) brackets the wanted
   rank; groups of at most ``accuracy`` rows need no bracket;
2. rows outside the bracket collapse into one counter per side, rows inside are
   counted per distinct value, both map-side;
3. a running count over the few bracket values picks the exact order statistics.

If the sketch ever missed the rank the query raises instead of returning a wrong
number.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    accuracy: int = 10_000,
    few_groups: bool = False,
) -> DataFrame:
    """One row per group: the keys, one column per entry of ``probs``, and ``n``.

    ``few_groups`` says that the number of groups is fixed by the protocol (months, steps,
    folds, registered models), not by the data. The brackets are then broadcast and the
    rows are not shuffled on a handful of keys.
    """
    keys = list(keys)
    constant = not keys
    if constant:
        df = df.withColumn("_all", F.lit(1))
        keys = ["_all"]
    rows = df.select(*keys, F.col(value).alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    names = list(probs)
    slack = 4.0 / accuracy
    edges = []
    for name in names:
        edges += [max(probs[name] - slack, 0.0), min(probs[name] + slack, 1.0)]
    lowest, highest = F.lit(float("-inf")), F.lit(float("inf"))
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), F.lit(accuracy)).alias("_e"),
    )
    small = F.col("_n") <= accuracy
    brackets = []
    for i, name in enumerate(names):
        lo = lowest if edges[2 * i] == 0.0 else F.when(small, lowest).otherwise(F.col("_e")[2 * i])
        hi = highest if edges[2 * i + 1] == 1.0 else F.when(small, highest).otherwise(F.col("_e")[2 * i + 1])
        brackets.append(F.struct(F.lit(i).alias("i"), lo.alias("lo"), hi.alias("hi")))
    bounds = sketch.select(*keys, "_n", F.explode(F.array(*brackets)).alias("_b"))
    bounds = bounds.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n", "_b.*")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    side = F.when(F.col("_v") < F.col("lo"), 0).when(F.col("_v") > F.col("hi"), 2).otherwise(1)
    group = [*keys, "i", "_n"]
    counted = (
        rows.join(F.broadcast(bounds) if few_groups or constant else bounds, condition)
        .select(*group, side.alias("_side"), "_v")
        .withColumn("_v", F.when(F.col("_side") == 1, F.col("_v")))
        .groupBy(*group, "_side", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = Window.partitionBy(*group).orderBy("_side", "_v")
    ranked = counted.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
    pos = F.get(F.array(*[F.lit(float(probs[n])) for n in names]), F.col("i")) * (F.col("_n") - 1)

    def pick(rank):
        hit = (F.col("_start") <= rank) & (rank < F.col("_end"))
        return F.max(F.when(hit, F.struct("_side", "_v")))

    low, high = F.floor(pos), F.ceil(pos)
    picked = ranked.groupBy(*group).agg(pick(low).alias("_a"), pick(high).alias("_z"))
    missed = (F.col("_a._side") != 1) | (F.col("_z._side") != 1)
    interpolated = F.col("_a._v") + (F.col("_z._v") - F.col("_a._v")) * (pos - low)
    picked = picked.withColumn(
        "_q",
        F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank; raise accuracy")).cast("double"))
        .otherwise(interpolated),
    )
    out = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("i") == i, F.col("_q"))).alias(name) for i, name in enumerate(names)],
        F.max("_n").alias("n"),
    )
    return out.drop("_all") if constant else out


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median",
                 approx: bool = False, few_groups: bool = False) -> DataFrame:
    """Median per group; ``approx=True`` stops after the sketch."""
    if approx:
        return df.groupBy(*keys).agg(F.percentile_approx(value, F.lit(0.5)).alias(name))
    return exact_quantiles(df, keys, value, {name: 0.5}, few_groups=few_groups).drop("n")
