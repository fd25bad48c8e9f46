"""Two-stage forecasts: one long aggregate series, spread over the panel by shares."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions import arrays as A
from panelwright.functions.frames import with_scalars
from panelwright.operators import longseries as L
from panelwright.operators.backtest import fold_rows
from panelwright.protocol import Calendar, Fold, fold_array

SHARE_RULES = {"last": 1, "median3": 3, "median6": 6}
Plan = dict[int, Sequence[Fold]]


def _origins(calendar: Calendar, plan: Plan, inner: bool) -> Column:
    """Literal array of all origins: every fold end and, with ``inner``, the month a horizon earlier."""
    entries = []
    for horizon, folds in plan.items():
        for fold in folds:
            for part, end in (("origin", fold.train_end), ("inner", fold.train_end - horizon)):
                if part == "origin" or (inner and end >= 1):
                    entries.append(F.struct(
                        F.lit(calendar.month(end - 1)).alias("origin"), F.lit(horizon).alias("horizon"),
                        F.lit(fold.index).alias("fold"), F.lit(part).alias("part"),
                    ))
    return F.array(*entries)


PATH_KEYS = ("horizon", "fold", "part", "origin")


def aggregate_paths(aggregate: DataFrame, calendar: Calendar, plan: Plan, solvers: Sequence[str] = (), inner: bool = True) -> DataFrame:
    """Forecast of the aggregate from every fold origin and from the inner origin a horizon earlier.

    ``horizon, fold, part, origin, model, explained, path`` (levels), ``log_path``, ``last_log``.
    A few rows per fold: the plan bounds them. All horizons and folds are one job.
    """
    keyed = aggregate.select(F.lit("aggregate").alias("series_key"), "month", "value")
    cut = L.origins_of(keyed, ["series_key"], _origins(calendar, plan, inner))
    best = L.forecast_best(cut, PATH_KEYS, F.col("horizon"), solvers=solvers)
    return best.select(
        *PATH_KEYS, "model", "explained", F.transform("path", lambda v: F.exp(v)).alias("path"),
        F.col("path").alias("log_path"), F.col("last").alias("last_log"), F.lit(None).cast("string").alias("error"),
    )


def known_paths(aggregate: DataFrame, calendar: Calendar, plan: Plan) -> DataFrame:
    """The published aggregate of the horizon months. A missing month is an error of that fold."""
    whole = aggregate.agg(F.map_from_entries(F.collect_list(F.struct("month", "value"))).alias("m"))
    o = whole.select("m", F.explode(_origins(calendar, plan, True)).alias("o")).select("m", "o.*")
    path = F.transform(
        F.sequence(F.lit(1), F.col("horizon")), lambda k: F.try_element_at("m", F.add_months("origin", k))
    )
    o = o.withColumn("path", path).withColumn("_bad", A.has_null(F.col("path")))
    text = F.lit("ValueError: the aggregate of the horizon months is not known")
    return o.select(
        *PATH_KEYS, F.lit("known aggregate").alias("model"),
        F.lit(None).cast("double").alias("explained"), F.when(~F.col("_bad"), F.col("path")).alias("path"),
        F.when(~F.col("_bad"), F.transform("path", lambda v: F.log(v))).alias("log_path"),
        F.log(F.try_element_at("m", F.col("origin"))).alias("last_log"), F.when(F.col("_bad"), text).alias("error"),
    )


def aggregate_array(aggregate: DataFrame, calendar: Calendar) -> DataFrame:
    """One row: the aggregate over the calendar as an array ``f``."""
    points = aggregate.where(calendar.contains(F.col("month"))).select(
        calendar.position(F.col("month")).alias("t"), "value"
    )
    packed = points.agg(F.map_from_entries(F.collect_list(F.struct("t", "value"))).alias("m"))
    grid = F.sequence(F.lit(0), F.lit(calendar.n_months - 1))
    return packed.select(F.transform(grid, lambda t: F.try_element_at("m", t)).alias("f"))


def share(y: Column, f: Column, end: Column, window: int) -> Column:
    """Median of ``y / f`` over the last ``window`` months before ``end``."""
    start = F.greatest(end - window, F.lit(0))
    ratios = F.zip_with(A.window(y, start, F.lit(window)), A.window(f, start, F.lit(window)), lambda a, b: a / F.when(b != 0, b))
    return A.median(F.filter(ratios, lambda x: x.isNotNull()))


def _prepared(series: DataFrame, plan: Plan, paths: DataFrame, agg_array: DataFrame) -> DataFrame:
    rows = with_scalars(fold_rows(series, fold_array(plan)), agg_array)
    wide = paths.groupBy("horizon", "fold").agg(
        F.max(F.when(F.col("part") == "origin", F.struct("model", "path", "error"))).alias("o"),
        F.max(F.when(F.col("part") == "inner", F.struct("path"))).alias("i"),
    )
    # one row per fold of the plan
    return rows.join(F.broadcast(wide), ["horizon", "fold"])


def share_rule_scores(series: DataFrame, plan: Plan, paths: DataFrame, agg_array: DataFrame) -> DataFrame:
    """MAE of each share rule on the inner origin, per fold: ``horizon, fold, rule, ord, mae``."""
    rows = _prepared(series, plan, paths, agg_array)
    end = F.col("train_end") - F.col("horizon")
    usable = (end - 1 >= max(SHARE_RULES.values()) - 1) & F.col("i.path").isNotNull()
    actual = A.window(F.col("y"), end, F.col("horizon"))
    runs = []
    for i, (rule, window) in enumerate(SHARE_RULES.items()):
        s = share(F.col("y"), F.col("f"), end, window)
        off = A.let(s, lambda k: F.zip_with(F.col("i.path"), actual, lambda p, a: F.abs(k * p - a)))
        sums = A.let(F.filter(off, lambda e: e.isNotNull()), lambda e: F.struct(A.total(e).alias("e"), F.size(e).alias("k")))
        runs.append(F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("ord"), sums.alias("s")))
    long = rows.where(usable).select("horizon", "fold", F.inline(F.array(*runs)))
    return long.groupBy("horizon", "fold", "rule", "ord").agg((F.sum("s.e") / F.sum("s.k")).alias("mae"))


def choose_share_rule(scores: DataFrame) -> DataFrame:
    """Best rule per fold; folds without a score are absent and fall back to ``last``."""
    best = scores.where(F.col("mae").isNotNull()).groupBy("horizon", "fold").agg(F.min(F.struct("mae", "ord", "rule")).alias("b"))
    return best.select("horizon", "fold", F.col("b.rule").alias("rule"))


def two_stage(series: DataFrame, plan: Plan, paths: DataFrame, agg_array: DataFrame, name: str = "two_stage") -> DataFrame:
    """Share x aggregate forecast for every series and fold, in the shape the scorer takes."""
    rules = choose_share_rule(share_rule_scores(series, plan, paths, agg_array))
    rows = _prepared(series, plan, paths, agg_array).join(F.broadcast(rules), ["horizon", "fold"], "left")
    rule = F.coalesce("rule", F.lit("last"))
    s = F.lit(None).cast("double")
    for key, window in SHARE_RULES.items():
        s = F.when(rule == key, share(F.col("y"), F.col("f"), F.col("train_end"), window)).otherwise(s)
    rows = rows.withColumn("rule", rule).withColumn("share", s)
    spread = A.let(F.col("share"), lambda k: F.transform("o.path", lambda p: k * p))
    out = rows.withColumn("forecast", spread)
    return out.withColumn("model", F.lit(name)).withColumn("error", F.col("o.error")).withColumn(
        "aggregate_model", F.col("o.model")
    ).drop("o", "i", "f")


# --- news correction of the aggregate -----------------------------------------------------

def aggregate_residuals(aggregate: DataFrame, news_months: DataFrame, paths: DataFrame, horizon: int) -> DataFrame:
    """Walk-forward residuals of the aggregate by ``(fold, month, step)``.

    Positions from 25 on, months with news only, targets up to the origin of the fold.
    """
    origins = paths.where((F.col("part") == "origin") & (F.col("horizon") == horizon)).select("fold", "origin", "model")
    keyed = aggregate.select(F.lit("aggregate").alias("series_key"), "month", "value")
    packed = L.log_history(keyed)
    starts = packed.select("months", F.col("h").alias("full"), F.explode(F.sequence(F.lit(25), F.size("h") - 1)).alias("pos"))
    starts = starts.withColumn("h", F.slice("full", 1, F.col("pos") + 1)).withColumn("month", F.element_at("months", F.col("pos") + 1))
    tried = L.forecast_all(starts, horizon)
    long = tried.select("month", "pos", "full", "months", "model", F.posexplode("path").alias("k", "predicted"))
    target = F.get("months", F.col("pos") + F.col("k") + 1)
    rows = long.withColumn("target", target).withColumn("actual", F.get("full", F.col("pos") + F.col("k") + 1))
    rows = rows.join(origins, "model").where(F.col("target") <= F.col("origin"))
    rows = rows.join(news_months.select("month").distinct(), "month", "left_semi")
    return rows.select("fold", "origin", "month", (F.col("k") + 1).alias("step"), (F.col("actual") - F.col("predicted")).alias("residual"))


def loo_gains(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Leave-one-out gain of a simple regression over predicting zero, in closed form.

    The error of a left-out point is its residual over one minus its leverage. A group in
    which one removal leaves no variation is degenerate and gets minus infinity.
    """
    g = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(g)
    rows = pairs.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    rows = rows.withColumn("_n", n).withColumn("_cx", F.col("_x") - F.avg("_x").over(g)).withColumn("_cy", F.col("_y") - F.avg("_y").over(g))
    rows = rows.withColumn("_sxx", F.sum(F.col("_cx") * F.col("_cx")).over(g)).withColumn("_sxy", F.sum(F.col("_cx") * F.col("_cy")).over(g))
    left = F.col("_sxx") - F.col("_n") / (F.col("_n") - 1) * F.col("_cx") * F.col("_cx")
    leverage = 1.0 / F.col("_n") + F.col("_cx") * F.col("_cx") / F.col("_sxx")
    error = (F.col("_cy") - F.col("_sxy") / F.col("_sxx") * F.col("_cx")) / (1.0 - leverage)
    bad = (F.col("_sxx") <= 0) | (left <= 1e-12 * F.col("_sxx"))
    rows = rows.withColumn("_bad", bad).withColumn("_e", F.when(~bad, error))
    return rows.groupBy(*keys).agg(
        F.max("_n").alias("n_months"),
        F.when(F.max(F.col("_bad").cast("int")) == 1, F.lit(float("-inf")))
        .otherwise(F.avg(F.col("_y") * F.col("_y")) - F.avg(F.col("_e") * F.col("_e"))).alias("gain"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
    )


def news_correction(residuals: DataFrame, news: DataFrame, topics: Sequence[str], min_months: int = 8) -> DataFrame:
    """Per fold and step: the topic with the best positive gain and its log correction at the origin."""
    long = news.select("month", F.explode(F.array(*[
        F.struct(F.lit(t).alias("topic"), F.lit(i).alias("ord"), F.col(t).alias("x")) for i, t in enumerate(topics)
    ])).alias("n")).select("month", "n.*")
    gains = loo_gains(residuals.join(long, "month").where(F.col("x").isNotNull()), ["fold", "origin", "step", "topic", "ord"], "x", "residual")
    usable = gains.where((F.col("n_months") >= min_months) & (F.col("gain") > 0))
    best = usable.groupBy("fold", "origin", "step").agg(
        F.max(F.struct("gain", (-F.col("ord")).alias("o"), "topic", "slope", "intercept")).alias("b")
    ).select("fold", "origin", "step", "b.*")
    here = long.select(F.col("month").alias("origin"), "topic", F.col("x").alias("x0"))
    return best.join(here, ["origin", "topic"]).select(
        "fold", "step", "topic", "gain", (F.col("intercept") + F.col("slope") * F.col("x0")).alias("correction")
    )


def corrected_paths(paths: DataFrame, corrections: DataFrame, horizon: int) -> DataFrame:
    """Aggregate paths of one horizon times ``exp(correction)`` of each corrected step."""
    packed = corrections.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("step", "correction"))).alias("m"))
    rows = paths.where(F.col("horizon") == horizon).join(packed, "fold", "left")
    fix = F.transform("path", lambda v, i: v * F.exp(F.coalesce(F.try_element_at("m", i + 1), F.lit(0.0))))
    moved = F.when((F.col("part") == "origin") & F.col("m").isNotNull(), fix).otherwise(F.col("path"))
    return rows.withColumn("path", moved).drop("m")
