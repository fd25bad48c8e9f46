"""Common factor: what a long aggregate series says about all short series at once.

``panel`` has ``series_id, t, y`` (cleaned), ``aggregate`` has ``month, value``, ``regions``
has ``series_id, region``. Everything is per fold origin, so several folds are one job.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions.frames import with_scalars
from panelwright.functions.quantiles import exact_quantiles
from panelwright.protocol import Calendar

MIN_PAIRS = 8


def on_calendar(aggregate: DataFrame, calendar: Calendar) -> DataFrame:
    inside = aggregate.where(calendar.contains(F.col("month")))
    return inside.select(calendar.position(F.col("month")).alias("t"), F.col("value").alias("f"))


def log_federal(aggregate: DataFrame, calendar: Calendar, horizon: int) -> DataFrame:
    """Log ratio of the aggregate for every ``(t, step)`` inside the calendar.

    Both sides are finite and positive. The frame has at most months x horizon rows.
    """
    points = on_calendar(aggregate, calendar).where((F.col("f") > 0) & ~F.isnan("f"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    ahead = points.select(F.col("t").alias("t1"), F.col("f").alias("f1"), steps)
    ahead = ahead.select((F.col("t1") - F.col("step")).alias("t"), "step", "f1")
    return points.join(ahead, "t").select("t", "step", F.log(F.col("f1") / F.col("f")).alias("log_federal"))


def series_ratios(arrays: DataFrame, horizon: int, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """``y[t + step] / y[t]`` of every series: read inside its array, no self-join."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    n = F.size("y")
    # y shifted by the step, zipped with y itself
    ahead = F.slice("y", F.col("step") + 1, n - F.col("step"))
    here = F.slice("y", 1, n - F.col("step"))
    ratio = F.zip_with(here, ahead, lambda a, b: b / F.when(a != 0, a))
    rows = arrays.select(*keys, "y", steps).select(*keys, "step", F.posexplode(ratio).alias("t", "ratio"))
    return rows.where(F.col("ratio").isNotNull())


def median_log_ratios(arrays: DataFrame, horizon: int, group: tuple[str, ...] = ()) -> DataFrame:
    """Log of the median ratio over series, per ``(group, t, step)``."""
    rows = series_ratios(arrays, horizon, keys=("series_id", *group))
    # without a group there is one bracket per month and step; the number of groups is not ours to bound
    med = exact_quantiles(rows, [*group, "t", "step"], "ratio", {"m": 0.5}, few_groups=not group)
    return med.where(F.col("m") > 0).select(*group, "t", "step", F.log("m").alias("log_ratio"), F.col("n").alias("n_series"))


def training_pairs(medians: DataFrame, federal: DataFrame, folds: Column) -> DataFrame:
    """Pairs ``x = log_federal, z = log_ratio`` usable at each origin: ``t + step < train_end``."""
    rows = medians.join(federal, ["t", "step"]).select("*", F.explode(folds).alias("f"))
    usable = (F.col("t") + F.col("step") < F.col("f.train_end")) & (F.col("step") <= F.col("f.horizon"))
    return rows.where(usable).select(
        *medians.columns, F.col("log_federal").alias("x"), F.col("log_ratio").alias("z"),
        F.col("f.horizon").alias("horizon"), F.col("f.fold").alias("fold"), F.col("f.train_end").alias("train_end"),
    )


def elasticity(pairs: DataFrame, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """OLS slope per fold and step; 1 below ``min_pairs`` or without variation."""
    fits = pairs.groupBy("horizon", "fold", "step").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.regr_slope("z", "x").alias("_b"), F.regr_sxx("z", "x").alias("_sxx")
    )
    good = (F.col("n_pairs") >= min_pairs) & (F.col("_sxx") > 0)
    return fits.select("horizon", "fold", "step", "n_pairs", F.when(good, F.col("_b")).otherwise(F.lit(1.0)).alias("elasticity"))


def pooled_slope(pairs: DataFrame, group: tuple[str, ...] = (), min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Slope over all steps together and the variance of its estimate."""
    keys = ["horizon", "fold", *group]
    fits = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.regr_slope("z", "x").alias("slope"), F.regr_sxx("z", "x").alias("sxx"),
        F.regr_syy("z", "x").alias("syy"), F.regr_sxy("z", "x").alias("sxy"),
    )
    good = (F.col("n_pairs") >= min_pairs) & (F.col("sxx") > 0)
    residual = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    variance = residual / F.greatest(F.col("n_pairs") - 2, F.lit(1)) / F.col("sxx")
    return fits.where(good).select(*keys, "n_pairs", "slope", variance.alias("variance"))


def regional_ratios(
    by_region: DataFrame, overall: DataFrame, members: DataFrame, min_members: int = 8, min_regions: int = 10
) -> DataFrame:
    """Shrunk regional slopes over the pooled slope (James-Stein weight of the regions' own estimate).

    ``members`` has ``region, n_members``. Too few regions, or no pooled slope, give no rows.
    """
    large = members.where(F.col("n_members") >= min_members).select("region")
    own = by_region.where((F.col("variance") > 0) & ~F.isnan("slope")).join(large, "region", "left_semi")
    fold = Window.partitionBy("horizon", "fold")
    noise = F.avg("variance").over(fold)
    between = F.var_samp("slope").over(fold) - noise
    weight = F.when(between > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), between / (between + noise)))).otherwise(0.0)
    pooled = overall.where(F.col("slope") != 0).select("horizon", "fold", F.col("slope").alias("pooled"))
    rows = own.withColumn("n_regions", F.count(F.lit(1)).over(fold)).withColumn("weight", weight)
    rows = rows.where(F.col("n_regions") >= min_regions).join(pooled, ["horizon", "fold"])
    shrunk = F.col("weight") * F.col("slope") + (1 - F.col("weight")) * F.col("pooled")
    return rows.select("horizon", "fold", "region", "slope", "weight", "n_regions", (shrunk / F.col("pooled")).alias("ratio"))


def scales(elastic: DataFrame, best: DataFrame) -> DataFrame:
    """``scale = elasticity x explained`` and the log forecast of each step.

    ``best`` has ``horizon, fold, model, explained, path, last``.
    """
    steps = best.select(
        "horizon", "fold", "model", "explained",
        F.posexplode(F.transform("path", lambda v: v - F.col("last"))).alias("k", "log_forecast"),
    ).withColumn("step", F.col("k") + 1).drop("k")
    joined = steps.join(elastic, ["horizon", "fold", "step"], "left")
    value = F.coalesce("elasticity", F.lit(1.0))
    return joined.withColumn("elasticity", value).withColumn("scale", value * F.col("explained"))


def multipliers(scale: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """``exp(ratio x scale x log forecast)`` per fold and step, or per region too."""
    moved = F.col("scale") * F.col("log_forecast")
    if ratios is None:
        return scale.select("horizon", "fold", "step", F.exp(moved).alias("multiplier"))
    joined = scale.join(ratios.select("horizon", "fold", "region", "ratio"), ["horizon", "fold"])
    return joined.select("horizon", "fold", "region", "step", F.exp(F.col("ratio") * moved).alias("multiplier"))


def series_multipliers(series: DataFrame, scale: DataFrame, ratios: DataFrame) -> DataFrame:
    """Multiplier per series and step; a series without a region ratio has ratio 1.

    A series meets at most folds x horizon rows of ``scale``: they fold into one array, so
    the series side is neither shuffled nor multiplied before its region is known.
    """
    path = scale.groupBy("horizon", "fold").agg(
        F.sort_array(F.collect_list(F.struct("step", (F.col("scale") * F.col("log_forecast")).alias("move")))).alias("path")
    )
    packed = path.agg(F.collect_list(F.struct("horizon", "fold", "path")).alias("folds"))
    spread = with_scalars(series, packed).select(*series.columns, F.explode("folds").alias("f")).select(*series.columns, "f.*")
    joined = spread.join(ratios.select("horizon", "fold", "region", "ratio"), ["horizon", "fold", "region"], "left")
    ratio = F.coalesce("ratio", F.lit(1.0))
    return joined.select("series_id", "horizon", "fold", F.explode("path").alias("p"), ratio.alias("ratio")).select(
        "series_id", "horizon", "fold", F.col("p.step").alias("step"), F.exp(F.col("ratio") * F.col("p.move")).alias("multiplier")
    )


def realised_multipliers(federal: DataFrame, scale: DataFrame) -> DataFrame:
    """What the factor explains of an already seen move: ``exp(scale[step] x log_federal[t, step])``."""
    return federal.join(scale.select("horizon", "fold", "step", "scale"), "step").select(
        "horizon", "fold", "t", "step", F.exp(F.coalesce(F.col("scale") * F.col("log_federal"), F.lit(0.0))).alias("multiplier")
    )


def realised_by_series(series: DataFrame, federal: DataFrame, scale: DataFrame, ratios: DataFrame) -> DataFrame:
    """The same for every series, with the ratio of its region: ``exp(ratio x scale[step] x log_federal[t, step])``.

    ``series``: ``series_id, region``. A series without a region, or whose region has no ratio, moves with ratio 1.
    The moves are a few per fold, so they travel as one row and are spread over the series.
    """
    seen = federal.join(scale.select("horizon", "fold", "step", "scale"), "step")
    moves = seen.groupBy("horizon", "fold").agg(F.collect_list(F.struct("t", "step", (F.col("scale") * F.col("log_federal")).alias("move"))).alias("moves"))
    every = moves.agg(F.collect_list(F.struct("horizon", "fold", "moves")).alias("folds"))
    spread = with_scalars(series.select("series_id", "region"), every).select("series_id", "region", F.inline("folds"))
    own = spread.join(ratios.select("horizon", "fold", "region", "ratio"), ["horizon", "fold", "region"], "left")
    return own.select("series_id", "horizon", "fold", F.coalesce("ratio", F.lit(1.0)).alias("ratio"), F.inline("moves")).select(
        "series_id", "horizon", "fold", "t", "step", F.exp(F.coalesce(F.col("ratio") * F.col("move"), F.lit(0.0))).alias("multiplier"))


def factor_report(scale: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    out = scale.groupBy("horizon", "fold").agg(
        F.max("model").alias("model"),
        F.max("explained").alias("shrinkage"),
        F.sum("n_pairs").alias("n_pairs"),
        F.transform(F.sort_array(F.collect_list(F.struct("step", "elasticity"))), lambda x: x["elasticity"]).alias("elasticity"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("step", F.exp(F.col("scale") * F.col("log_forecast")).alias("m")))),
            lambda x: x["m"],
        ).alias("multipliers"),
    )
    if ratios is None:
        return out.withColumn("n_regions", F.lit(0).cast("bigint")).withColumn("pooling", F.lit(0.0))
    regional = ratios.groupBy("horizon", "fold").agg(F.count(F.lit(1)).alias("n_regions"), F.max("weight").alias("pooling"))
    joined = out.join(regional, ["horizon", "fold"], "left")
    return joined.withColumn("n_regions", F.coalesce("n_regions", F.lit(0).cast("bigint"))).withColumn(
        "pooling", F.coalesce("pooling", F.lit(0.0))
    )
