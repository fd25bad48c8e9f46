"""Comparisons between models, runs and versions of the score table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions.frames import union_all, with_scalars
from panelwright.functions.quantiles import exact_quantiles
from panelwright.functions.tdist import t_interval
from panelwright.operators.metrics import r2_median, r2_pool, refused

PAIR = ("horizon", "fold", "series_id")


def fold_r2(scores: DataFrame) -> DataFrame:
    """Pooled R², median R² and MAE per fold and model."""
    keys = ["horizon", "fold", "model"]
    means = scores.where(~refused()).groupBy(*keys).agg(F.avg("mae").alias("mae"))
    return means.join(r2_pool(scores, keys), keys, "left").join(r2_median(scores, keys), keys, "left")


def both_ways_lead(fold_table: DataFrame) -> DataFrame:
    """The model ahead on both R² in a fold, if there is one."""
    fold = Window.partitionBy("horizon", "fold")
    ahead = (F.col("r2_pool") == F.max("r2_pool").over(fold)) & (F.col("r2_median") == F.max("r2_median").over(fold))
    marked = fold_table.withColumn("leads", ahead)
    return marked.groupBy("horizon", "fold").agg(F.max(F.when(F.col("leads"), F.col("model"))).alias("leader"))


def fold_ranks(scores: DataFrame) -> DataFrame:
    """Place of each model inside a fold and its change from the previous fold."""
    means = scores.where(~refused()).groupBy("horizon", "fold", "model").agg(F.avg("mae").alias("mae"))
    place = F.rank().over(Window.partitionBy("horizon", "fold").orderBy("mae"))
    ranked = means.withColumn("place", place)
    previous = F.lag("place").over(Window.partitionBy("horizon", "model").orderBy("fold"))
    return ranked.withColumn("change", F.col("place") - previous)


def _beside_reference(scores: DataFrame, reference: str) -> DataFrame:
    """Every scored row with the reference error of its pair.

    The few models of one pair fold into a map, so the reference needs no self-join.
    """
    rows = scores.where(~refused())
    packed = rows.groupBy(*PAIR).agg(F.map_from_entries(F.collect_list(F.struct("model", "mae"))).alias("m"))
    based = packed.withColumn("mae_ref", F.try_element_at("m", F.lit(reference))).where(F.col("mae_ref").isNotNull())
    return based.select(*PAIR, "mae_ref", F.size("m").alias("n_models"), F.explode("m").alias("model", "mae")).withColumn(
        "diff", F.col("mae") - F.col("mae_ref")
    )


def paired_vs_reference(scores: DataFrame, reference: str, common_only: bool = False) -> DataFrame:
    """Paired differences to a reference model: normal interval by pair, t interval by fold.

    ``common_only`` keeps the pairs scored by every model.
    """
    rows = _beside_reference(scores, reference)
    if common_only:
        n_models = scores.where(~refused()).groupBy("horizon").agg(F.count_distinct("model").alias("_n"))
        rows = rows.join(n_models, "horizon").where(F.col("n_models") == F.col("_n"))
    rows = rows.where(F.col("model") != reference)
    return _pair_summary(rows, ["horizon", "model"], normal=True)


def _pair_summary(rows: DataFrame, keys: Sequence[str], normal: bool) -> DataFrame:
    keys = list(keys)
    by_fold = rows.groupBy(*keys, "fold").agg(
        F.avg("diff").alias("fold_diff"), (F.avg("mae") < F.avg("mae_ref")).alias("won"),
        F.count(F.lit(1)).alias("_n"), F.sum("diff").alias("_s"),
    )
    folds = by_fold.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("fold_diff").alias("fold_diff_mean"),
        F.stddev_samp("fold_diff").alias("_fold_sd"),
        F.count(F.when(F.col("won"), 1)).alias("folds_won"),
    )
    pairs = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_distinct("series_id").alias("n_series"),
        F.avg("mae").alias("mae"),
        F.avg("mae_ref").alias("mae_ref"),
        F.avg("diff").alias("diff_mean"),
        F.stddev_samp("diff").alias("_pair_sd"),
        F.avg((F.round("diff", 9) < 0).cast("double")).alias("pairs_won_share"),
    )
    out = pairs.join(folds, keys)
    if normal:
        margin = 1.96 * F.col("_pair_sd") / F.sqrt("n_pairs")
        low, high = F.col("diff_mean") - margin, F.col("diff_mean") + margin
    else:
        low, high = t_interval(F.col("diff_mean"), F.col("_pair_sd"), F.col("n_pairs"))
    fold_low, fold_high = t_interval(F.col("fold_diff_mean"), F.col("_fold_sd"), F.col("n_folds"))
    return out.withColumns(
        {"pair_ci_low": low, "pair_ci_high": high, "fold_ci_low": fold_low, "fold_ci_high": fold_high}
    ).drop("_pair_sd", "_fold_sd")


def pair_stats(scores: DataFrame, base: str, treatment: str, subset: DataFrame | None = None) -> DataFrame:
    """Two models over an optional subset of series: t intervals, series improved, folds won."""
    if subset is not None:
        scores = scores.join(subset.select("series_id"), "series_id", "left_semi")
    rows = _beside_reference(scores, base).where(F.col("model") == treatment)
    by_series = rows.groupBy("horizon", "series_id").agg((F.avg("mae") < F.avg("mae_ref")).cast("double").alias("better"))
    improved = by_series.groupBy("horizon").agg(F.avg("better").alias("share_series_improved"))
    return _pair_summary(rows, ["horizon"], normal=False).join(improved, "horizon").drop("pairs_won_share")


def mae_aggregation_check(scores: DataFrame) -> DataFrame:
    """Mean over pairs against the mean of fold means."""
    by_fold = scores.where(~refused()).groupBy("horizon", "model", "fold").agg(
        F.avg("mae").alias("m"), F.sum("mae").alias("s"), F.count(F.lit(1)).alias("k")
    )
    return by_fold.groupBy("horizon", "model").agg(
        (F.sum("s") / F.sum("k")).alias("over_pairs"), F.avg("m").alias("over_folds")
    )


def flat_windows(scores: DataFrame, p: float = 0.1) -> DataFrame:
    """Pairs whose test window hardly varies: their mean R² and share of the summed R²."""
    mean = F.col("y_sum") / F.col("n")
    rows = scores.where(~refused() & F.col("r2").isNotNull()).withColumn(
        "cv", F.sqrt(F.col("sst") / F.col("n")) / F.when(mean != 0, F.abs(mean))
    )
    cuts = exact_quantiles(rows, ["model"], "cv", {"cut": p}, few_groups=True).drop("n")
    flat = F.col("cv") <= F.col("cut")
    return rows.join(F.broadcast(cuts), "model").groupBy("model").agg(
        F.count(F.when(flat, 1)).alias("n_flat"),
        F.avg(F.when(flat, F.col("r2"))).alias("r2_flat"),
        F.avg(F.when(~flat, F.col("r2"))).alias("r2_rest"),
        (F.sum(F.when(flat, F.col("r2"))) / F.sum("r2")).alias("share_of_sum"),
    )


def error_decomposition(points: DataFrame, base: DataFrame) -> DataFrame:
    """MAE as a common bias plus a spread.

    Forecasts are rescaled so that their median ratio to the last training value equals the
    actual one; the error left is the spread. ``base`` has ``series_id, horizon, fold, base``.
    """
    keys = ["model", "horizon", "fold"]
    rows = points.join(base, ["series_id", "horizon", "fold"]).where(F.col("actual").isNotNull())
    rows = rows.withColumn("pred_ratio", F.col("forecast") / F.when(F.col("base") != 0, F.col("base"))).withColumn(
        "act_ratio", F.col("actual") / F.when(F.col("base") != 0, F.col("base"))
    )
    step = [*keys, "step"]
    predicted = exact_quantiles(rows, step, "pred_ratio", {"m_pred": 0.5}, few_groups=True).drop("n")
    actual = exact_quantiles(rows, step, "act_ratio", {"m_act": 0.5}, few_groups=True).drop("n")
    # one row per model, fold and step
    scaled = rows.join(F.broadcast(predicted.join(actual, step)), step)
    moved = F.col("forecast") / F.col("m_pred") * F.col("m_act")
    out = scaled.groupBy(*keys).agg(
        F.avg(F.abs(F.col("forecast") - F.col("actual"))).alias("mae"),
        F.avg(F.abs(moved - F.col("actual"))).alias("spread"),
    )
    return out.withColumn("bias", F.col("mae") - F.col("spread")).withColumn(
        "bias_share", F.col("bias") / F.when(F.col("mae") != 0, F.col("mae"))
    )


def decomposition_means(table: DataFrame) -> DataFrame:
    return table.groupBy("horizon", "model").agg(
        F.avg("bias").alias("bias"), F.avg("spread").alias("spread"), F.avg("mae").alias("mae")
    )


def compare_realisations(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two runs of the same protocol: largest gap and share of exactly equal rows per fold."""
    keys = ["model", "horizon", "fold", "series_id"]
    joined = first.select(*keys, F.col("mae").alias("a")).join(second.select(*keys, F.col("mae").alias("b")), keys)
    return joined.groupBy("model", "horizon", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.abs(F.col("a") - F.col("b"))).alias("max_gap"),
        F.avg((F.col("a") == F.col("b")).cast("double")).alias("share_equal"),
    )


def backfill_parts(old: DataFrame, targets: DataFrame) -> DataFrame:
    """Add the pooled parts to rows that only have ``r2``: ``sse = (1 - r2) * sst``.

    ``targets`` has ``series_id, horizon, fold, sst, n, y_sum, y_sq``. A scored row without
    a target is an error.
    """
    joined = old.join(targets.withColumn("_known", F.lit(True)), ["series_id", "horizon", "fold"], "left")
    unknown = F.col("_known").isNull() & ~refused()
    checked = F.when(
        unknown, F.raise_error(F.concat(F.lit("no target for series "), F.col("series_id"))).cast("double")
    ).otherwise((1.0 - F.col("r2")) * F.col("sst"))
    return joined.withColumn("sse", checked).drop("_known")


def check_known(derived: DataFrame, direct: DataFrame) -> DataFrame:
    """Largest relative deviation of derived SSE from the directly computed one, per model."""
    keys = ["model", "series_id", "horizon", "fold"]
    joined = derived.select(*keys, "sse").join(direct.select(*keys, F.col("sse").alias("direct")), keys)
    scale = F.greatest(F.abs("direct"), F.lit(1e-12))
    return joined.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("sse") - F.col("direct")) / scale).alias("max_deviation")
    )


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of the old columns that a rewrite changed, NULLs compared as values."""
    after = after.select(*before.columns)
    lost = before.exceptAll(after).select(F.lit("lost").alias("side"))
    gained = after.exceptAll(before).select(F.lit("gained").alias("side"))
    return lost.unionByName(gained).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def pool_variance_split(scores: DataFrame, keys: Sequence[str] = ("horizon", "model")) -> DataFrame:
    """Share of the pooled SST between rows and inside test windows."""
    keys = list(keys)
    rows = scores.where(~refused())
    means = rows.groupBy(*keys).agg((F.sum("y_sum") / F.sum("n")).alias("_m"))
    away = F.col("y_sum") / F.col("n") - F.col("_m")
    sums = rows.join(means, keys).groupBy(*keys).agg(
        F.sum("sst").alias("inside"), F.sum(F.col("n") * away * away).alias("between")
    )
    total = F.col("inside") + F.col("between")
    return sums.withColumn("share_between", F.col("between") / F.when(total > 0, total))


def events_in_folds(scores: DataFrame, folds: Column, events: dict[str, int], model: str = "naive_last") -> DataFrame:
    """Naive error of folds whose test window holds an event, beside that of the others."""
    listed = F.array(*[F.struct(F.lit(k).alias("event"), F.lit(t).alias("t")) for k, t in events.items()])
    rows = scores.where((F.col("model") == model) & ~refused())
    means = rows.groupBy("horizon", "fold", "train_end").agg(F.avg("mae").alias("mae"))
    inside = F.filter(listed, lambda e: (e["t"] >= F.col("train_end")) & (e["t"] < F.col("train_end") + F.col("horizon")))
    tagged = means.withColumn("events", F.array_join(F.transform(inside, lambda e: e["event"]), ","))
    whole = Window.partitionBy("horizon")
    quiet = F.avg(F.when(F.col("events") == "", F.col("mae"))).over(whole)
    return tagged.withColumn("mae_quiet_folds", quiet)


def top_indistinguishable(scores: DataFrame, k: int = 5) -> DataFrame:
    """The best ``k`` models of a horizon: does the fold-mean difference to the best include zero?"""
    by_fold = scores.where(~refused()).groupBy("horizon", "model", "fold").agg(F.avg("mae").alias("mae"))
    totals = by_fold.groupBy("horizon", "model").agg(F.avg("mae").alias("mean_mae"))
    placed = totals.withColumn("place", F.row_number().over(Window.partitionBy("horizon").orderBy("mean_mae", "model")))
    top = placed.where(F.col("place") <= k)
    best = F.max(F.when(F.col("place") == 1, F.col("mae"))).over(Window.partitionBy("horizon", "fold"))
    rows = by_fold.join(top, ["horizon", "model"]).withColumn("diff", F.col("mae") - best)
    stats = rows.where(F.col("place") > 1).groupBy("horizon", "model", "place").agg(
        F.avg("diff").alias("diff_mean"), F.stddev_samp("diff").alias("_sd"), F.count(F.lit(1)).alias("n_folds"),
        F.count(F.when(F.col("diff") < 0, 1)).alias("folds_ahead"),
    )
    low, high = t_interval(F.col("diff_mean"), F.col("_sd"), F.col("n_folds"))
    return stats.withColumn("ci_low", low).withColumn("ci_high", high).drop("_sd").withColumn(
        "same", (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)
    )


WEIGHTS = tuple(round(i * 0.05, 2) for i in range(21))


def blend_weights(points: DataFrame, first: str, second: str) -> DataFrame:
    """Per fold the weight of ``first`` that minimised the error on all earlier folds.

    The 21 candidate errors of a row are one array; their sums combine map-side.
    """
    cells = (
        points.where(F.col("model").isin(first, second))
        .groupBy("horizon", "fold", "series_id", "step")
        .agg(
            F.max(F.when(F.col("model") == first, F.col("forecast"))).alias("a"),
            F.max(F.when(F.col("model") == second, F.col("forecast"))).alias("b"),
            F.max("actual").alias("actual"),
        )
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("actual").isNotNull())
    )
    sums = [
        F.sum(F.abs(F.col("actual") - (w * F.col("a") + (1 - w) * F.col("b")))).alias(f"w{i}")
        for i, w in enumerate(WEIGHTS)
    ]
    per_fold = cells.groupBy("horizon", "fold").agg(*sums, F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("horizon").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    candidates = F.array(*[
        F.struct((F.sum(f"w{i}").over(earlier) / F.sum("n").over(earlier)).alias("mae"), F.lit(w).alias("w"))
        for i, w in enumerate(WEIGHTS)
    ])
    best = per_fold.select("horizon", "fold", F.array_min(candidates).alias("best"))
    return best.where(F.col("best.mae").isNotNull()).select(
        "horizon", "fold", F.col("best.w").alias("weight"), F.col("best.mae").alias("mae_before")
    )


def blend(points: DataFrame, weights: DataFrame, first: str, second: str, name: str = "blend") -> DataFrame:
    """Weighted forecasts of two models; weights come from :func:`blend_weights`."""
    cells = points.where(F.col("model").isin(first, second)).groupBy(
        "horizon", "fold", "train_end", "series_id", "step", "t"
    ).agg(
        F.max(F.when(F.col("model") == first, F.col("forecast"))).alias("a"),
        F.max(F.when(F.col("model") == second, F.col("forecast"))).alias("b"),
        F.max("actual").alias("actual"),
    )
    joined = cells.join(F.broadcast(weights), ["horizon", "fold"])
    mixed = F.col("weight") * F.col("a") + (1 - F.col("weight")) * F.col("b")
    return joined.select(
        F.lit(name).alias("model"), "horizon", "fold", "train_end", "series_id", "step", "t",
        mixed.alias("forecast"), "actual",
    )
