"""Forward forecasts and the tables served from them."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelwright.functions import arrays as A
from panelwright.functions.frames import union_all
from panelwright.functions.quantiles import exact_quantiles
from panelwright.operators import backtest, longseries as L, models, modelstore, two_stage as TS
from panelwright.operators.metrics import refused
from panelwright.operators.modelstore import ModelStore
from panelwright.operators.trees import PanelContext, TreeConfig
from panelwright.protocol import Calendar, Fold, ForwardConfig, fold_array


def forward_plan(calendar: Calendar, horizons: Sequence[int]) -> dict[int, list[Fold]]:
    """One fold per horizon whose training window is the whole panel."""
    n = calendar.n_months
    return {h: [Fold(0, n, n, n + h)] for h in horizons}


def future_months(calendar: Calendar, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.add_months(F.lit(calendar.last), k))


def forecast_forward(series: DataFrame, aggregate: DataFrame, regions: DataFrame, calendar: Calendar, config: ForwardConfig,
                     context: PanelContext | None = None, store: ModelStore | None = None, trees: TreeConfig = TreeConfig()) -> DataFrame:
    """Recommended and comparison models per horizon, plus the known-aggregate rows.

    The aggregate is cut at the origin for every model except the known one. A recommended panel
    learner takes its models from ``store`` and fits there what is missing; it needs the ``context``.
    """
    plan = forward_plan(calendar, config.horizons)
    cut = L.cut_at(aggregate, F.lit(calendar.last))
    agg_array = TS.aggregate_array(cut, calendar)
    recommended = dict(config.recommended)
    by_need = models.needs(sorted(set(recommended.values())))
    if set(by_need.get("aggregate", [])) - {config.comparison} or "solver" in by_need:
        raise ValueError(f"a closed form, a panel learner or {config.comparison} can be recommended, not {recommended}")
    pieces = []

    def own(name: str) -> list[int]:
        return [h for h, m in recommended.items() if m == name]

    rows = backtest.fold_rows(series, fold_array(plan))
    for name in by_need.get("series", []):
        done = backtest.forecast_series(rows.where(F.col("horizon").isin(*own(name))), [name])
        pieces.append(_long(done, calendar).withColumn("recommended", F.lit(True)).withColumn("uses_published_aggregate", F.lit(False)))
    for name in by_need.get("panel", []):
        if context is None or store is None:
            raise ValueError(f"{name} is recommended: it needs the panel context and a model store")
        modelstore.fit_forward(store, context, name, own(name), trees)
        for h in own(name):
            found = modelstore.forecast(store, context, name, h, trees)
            done = found.groupBy("series_id").agg(
                F.transform(F.sort_array(F.collect_list(F.struct("step", "forecast"))), lambda x: x["forecast"]).alias("forecast"))
            # a series without features at the origin has no forecast, and says so
            done = series.select("series_id").join(done, "series_id", "left").select(
                "series_id", F.lit(name).alias("model"), F.lit(h).alias("horizon"), "forecast",
                F.when(F.col("forecast").isNull(), F.lit("not enough history for the features")).alias("error"))
            pieces.append(_long(done, calendar).withColumn("recommended", F.lit(True)).withColumn("uses_published_aggregate", F.lit(False)))
    staged = TS.two_stage(series, plan, TS.aggregate_paths(cut, calendar, plan), agg_array)
    flagged = F.col("horizon").isin(*own("two_stage")) if own("two_stage") else F.lit(False)
    pieces.append(_long(staged, calendar).withColumn("recommended", flagged).withColumn("uses_published_aggregate", F.lit(False)))
    known = TS.two_stage(series, plan, TS.known_paths(aggregate, calendar, plan), agg_array, name=config.known_aggregate)
    pieces.append(_long(known, calendar).withColumn("recommended", F.lit(False)).withColumn("uses_published_aggregate", F.lit(True)))
    return union_all(pieces).join(regions.select("series_id", "region"), "series_id", "left")


def _long(done: DataFrame, calendar: Calendar) -> DataFrame:
    """A refused forecast keeps its months with a NULL value."""
    path = F.coalesce("forecast", F.array_repeat(F.lit(None).cast("double"), F.col("horizon")))
    long = done.select("series_id", "model", "horizon", "error", F.posexplode(path).alias("k", "forecast"))
    return long.select(
        "series_id", "model", "horizon", F.add_months(F.lit(calendar.last), F.col("k") + 1).alias("month"), "forecast", "error"
    )


def aggregate_check(aggregate: DataFrame, calendar: Calendar, horizons: Sequence[int]) -> DataFrame:
    """Stage-one forecast, last value and year-ago value against the published months."""
    plan = forward_plan(calendar, horizons)
    cut = L.cut_at(aggregate, F.lit(calendar.last))
    paths = TS.aggregate_paths(cut, calendar, plan, inner=False)
    own = paths.select("horizon", F.col("model").alias("aggregate_model"), F.posexplode("path").alias("k", "forecast")).select(
        "horizon", F.lit("two_stage").alias("method"), "aggregate_model", "k", "forecast")
    last = paths.select("horizon", F.lit("naive").alias("method"), F.lit("last month").alias("aggregate_model"),
                        F.explode(F.sequence(F.lit(0), F.col("horizon") - 1)).alias("k"), F.exp("last_log").alias("forecast"))
    steps = paths.select("horizon", F.explode(F.sequence(F.lit(0), F.col("horizon") - 1)).alias("k"))
    year_ago = steps.withColumn("month", F.add_months(F.lit(calendar.last), F.col("k") + 1 - 12)).join(cut, "month", "left").select(
        "horizon", F.lit("seasonal_naive").alias("method"), F.lit("year ago").alias("aggregate_model"), "k", F.col("value").alias("forecast"))
    rows = union_all([own, last, year_ago]).withColumn("month", F.add_months(F.lit(calendar.last), F.col("k") + 1))
    joined = rows.join(aggregate.withColumnRenamed("value", "actual"), "month", "left")
    error = (F.col("forecast") - F.col("actual")) / F.when(F.col("actual") != 0, F.col("actual")) * 100.0
    return joined.select("horizon", "method", "aggregate_model", "month", "forecast", "actual", error.alias("error_pct"))


def aggregate_mape(check: DataFrame) -> DataFrame:
    """Mean absolute error in percent: methods as columns."""
    size = F.abs("error_pct")
    return check.groupBy("horizon").agg(*[
        F.avg(F.when(F.col("method") == m, size)).alias(m) for m in ("two_stage", "naive", "seasonal_naive")
    ])


GROWTH = {"median": 0.5, "p10": 0.1, "p90": 0.9}


def growth_stats(forecast: DataFrame, clean: DataFrame) -> DataFrame:
    """Forecast against the same month a year earlier: quantiles over series and months."""
    past = clean.select("series_id", F.add_months("month", 12).alias("month"), F.col("y").alias("year_ago"))
    rows = forecast.join(past, ["series_id", "month"], "left")
    grown = rows.withColumn("growth", F.col("forecast") / F.when(F.col("year_ago") != 0, F.col("year_ago")) - 1.0)
    return exact_quantiles(grown, ["model", "horizon"], "growth", GROWTH, few_groups=True)


def growth_stats_annual(forecast: DataFrame, arrays: DataFrame, months: int = 12) -> DataFrame:
    """Sum of the forecast months against the sum of as many last actual months, per series."""
    ahead = forecast.where(F.col("horizon") == months).groupBy("model", "series_id").agg(F.sum("forecast").alias("ahead"))
    back = arrays.select("series_id", A.total(F.slice("y", -months, months)).alias("back"))
    rows = ahead.join(back, "series_id").withColumn("growth", F.col("ahead") / F.when(F.col("back") != 0, F.col("back")) - 1.0)
    return exact_quantiles(rows, ["model"], "growth", GROWTH, few_groups=True)


def step_horizons(horizons: Sequence[int]) -> Column:
    """Literal array of ``step, horizon``: the smallest horizon that covers each step."""
    covered = [(step, min(h for h in horizons if h >= step)) for step in range(1, max(horizons) + 1)]
    return F.array(*[F.struct(F.lit(s).alias("step"), F.lit(h).alias("horizon")) for s, h in covered])


def forecast_by_step(forecast: DataFrame, calendar: Calendar, horizons: Sequence[int]) -> DataFrame:
    """The recommended value of each step, taken from its covering horizon."""
    months_ahead = F.months_between("month", F.lit(calendar.last)).cast("int")
    covering = F.filter(step_horizons(horizons), lambda p: (p["step"] == months_ahead) & (p["horizon"] == F.col("horizon")))
    rows = forecast.where(F.col("recommended") & (F.size(covering) > 0))
    return rows.select("series_id", "model", "horizon", "month", months_ahead.alias("step"), "forecast")


def forecast_rule(forecast: DataFrame, calendar: Calendar, horizons: Sequence[int]) -> DataFrame:
    """Runs of months served by the same model and horizon. Two recommended models of a horizon are an error."""
    steps = forecast_by_step(forecast, calendar, horizons).select("step", "month", "horizon", "model").distinct()
    per_step = steps.groupBy("step", "month", "horizon").agg(F.max("model").alias("model"), F.count(F.lit(1)).alias("_k"))
    text = F.lit("more than one recommended model for a horizon")
    checked = per_step.withColumn("model", F.when(F.col("_k") > 1, F.raise_error(text)).otherwise(F.col("model")))
    order = Window.orderBy("step")  # at most one row per step
    changed = (F.col("model") != F.lag("model").over(order)) | (F.col("horizon") != F.lag("horizon").over(order))
    marked = checked.withColumn("_new", F.coalesce(changed.cast("int"), F.lit(1)))
    run = marked.withColumn("run", F.sum("_new").over(order))
    return run.groupBy("run", "model", "horizon").agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count(F.lit(1)).alias("n_months")
    ).drop("run")


def series_documents(
    arrays: DataFrame, forecast: DataFrame, scores: DataFrame, calendar: Calendar, horizons: Sequence[int],
    breaks: DataFrame | None = None, known_horizon: int = 3,
) -> DataFrame:
    """One nested record per series: fact, forecast, known-aggregate path, breaks, MAE per model and fold."""
    fact = arrays.select("series_id", F.transform("y", lambda v: F.round(v).cast("int")).alias("fact"))
    def path(rows: DataFrame, name: str) -> DataFrame:
        packed = F.sort_array(F.collect_list(F.struct("month", F.round("forecast").cast("int").alias("v"))))
        return rows.groupBy("series_id").agg(F.transform(packed, lambda x: x["v"]).alias(name))

    ahead = path(forecast_by_step(forecast, calendar, horizons), "forecast")
    known = path(forecast.where(F.col("uses_published_aggregate") & (F.col("horizon") == known_horizon)), "known")
    errors = scores.where(~refused()).groupBy("series_id", "model").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("fold", F.round("mae").cast("int").alias("v")))), lambda x: x["v"]).alias("maes")
    ).groupBy("series_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "maes")))).alias("mae"))
    out = fact.join(ahead, "series_id", "left").join(known, "series_id", "left").join(errors, "series_id", "left")
    if breaks is not None:
        dated = breaks.groupBy("series_id").agg(F.array_sort(F.collect_set(F.date_format("month", "yyyy-MM"))).alias("breaks"))
        out = out.join(dated, "series_id", "left")
    else:
        out = out.withColumn("breaks", F.lit(None).cast("array<string>"))
    return out


def panel_mae_by_fold(scores: DataFrame, folds: Sequence[int]) -> DataFrame:
    means = scores.where(~refused()).groupBy("model", "fold").agg(F.avg("mae").alias("m"))
    return means.groupBy("model").agg(
        *[F.max(F.when(F.col("fold") == f, F.col("m"))).alias(f"fold_{f}") for f in folds], F.avg("m").alias("mean")
    )


def horizon_table(by_horizon: DataFrame, roles: Mapping[str, str], horizons: Sequence[int]) -> DataFrame:
    """MAE of a few roles by horizon, horizons as columns."""
    listed = F.create_map(*[F.lit(v) for pair in ((m, r) for r, m in roles.items()) for v in pair])
    rows = by_horizon.where(F.col("model").isin(*roles.values())).withColumn("role", F.try_element_at(listed, F.col("model")))
    return rows.groupBy("role", "model").agg(*[
        F.max(F.when(F.col("horizon") == h, F.col("mae"))).alias(f"h{h}") for h in horizons
    ])


def series_summary(arrays: DataFrame, by_step: DataFrame, scores: DataFrame, order: Sequence[str], reference: str) -> DataFrame:
    """Forecast mean, growth to the last year, best model of the series and the reference error."""
    ahead = by_step.groupBy("series_id").agg(F.avg("forecast").alias("forecast_mean"), F.count("forecast").alias("n_steps"))
    back = arrays.select("series_id", A.mean(F.slice("y", -12, 12)).alias("last_year"))
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    means = scores.where(~refused() & F.col("model").isin(*order)).groupBy("series_id", "model").agg(F.avg("mae").alias("mae"))
    best = means.groupBy("series_id").agg(
        F.min(F.struct(F.round("mae", 9).alias("mae"), place.alias("place"), "model")).alias("b"),
        F.max(F.when(F.col("model") == reference, F.col("mae"))).alias("reference_mae"),
    )
    out = back.join(ahead, "series_id", "left").join(best, "series_id", "left")
    growth = F.col("forecast_mean") / F.when(F.col("last_year") != 0, F.col("last_year")) - 1.0
    return out.select("series_id", "forecast_mean", growth.alias("growth"), F.col("b.model").alias("best_model"),
                      F.col("b.mae").alias("best_mae"), "reference_mae")


def windows_held(scores: DataFrame, reference: str) -> DataFrame:
    """Per model: folds in which its mean error is below, or above, the reference."""
    means = scores.where(~refused()).groupBy("horizon", "model", "fold").agg(F.avg("mae").alias("m"))
    base = F.max(F.when(F.col("model") == reference, F.col("m"))).over(Window.partitionBy("horizon", "fold"))
    rows = means.withColumn("base", base)
    return rows.groupBy("horizon", "model").agg(
        F.count(F.when(F.col("m") < F.col("base"), 1)).alias("held"), F.count(F.when(F.col("m") > F.col("base"), 1)).alias("lost")
    )


def series_set_difference(forecast: DataFrame, panel: DataFrame) -> DataFrame:
    """Series only in the forecast and only in the panel: both must be 0."""
    a = forecast.select("series_id").distinct().withColumn("_f", F.lit(True))
    b = panel.select("series_id").distinct().withColumn("_p", F.lit(True))
    return a.join(b, "series_id", "full").agg(
        F.count(F.when(F.col("_p").isNull(), 1)).alias("only_forecast"), F.count(F.when(F.col("_f").isNull(), 1)).alias("only_panel")
    )
