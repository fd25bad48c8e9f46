"""All forecasting models by name, and one call that back-tests any of them into one table.

A name says what its model reads: one series (closed form or solver), the long aggregate beside the
panel (two-stage), or the whole panel (trees). The caller names models; the dispatch is by need.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelwright.functions.frames import union_all
from panelwright.operators import backtest, forecasters, solvers, trees, two_stage as TS
from panelwright.operators.trees import PanelContext, TreeConfig
from panelwright.protocol import Fold, fold_array
from panelwright.session import cut_lineage, work_path

TWO_STAGE = ("two_stage", "two_stage_sa", "two_stage_known", "two_stage_news")
#: Solvers that stand for a model of a single short series.
SERIES_SOLVERS = ("ets_damped", "ets_seasonal", "theta", "arima111", "arima011")


def registered() -> dict[str, str]:
    """Need by model name: series, solver, aggregate or panel."""
    return {**{m: "series" for m in forecasters.CLOSED_FORM}, **{m: "solver" for m in SERIES_SOLVERS},
            **{m: "aggregate" for m in TWO_STAGE}, **{m: "panel" for m in trees.VARIANTS}}


def needs(names: Sequence[str]) -> dict[str, list[str]]:
    """Names by need, in order; an unknown or repeated name raises before anything runs."""
    known = registered()
    unknown = sorted(set(names) - set(known))
    if unknown:
        raise KeyError(f"unknown models {unknown}; known: {sorted(known)}")
    if len(set(names)) < len(names):
        raise ValueError(f"models named twice: {sorted({n for n in names if list(names).count(n) > 1})}")
    out: dict[str, list[str]] = {}
    for n in names:
        out.setdefault(known[n], []).append(n)
    return out


def unconfigured(names: Sequence[str]) -> list[str]:
    """Registered models that a run doesn't name."""
    return sorted(set(registered()) - set(names))


def staged(ctx: PanelContext, name: str, plan: Mapping[int, Sequence[Fold]], series: DataFrame | None = None) -> DataFrame:
    """Rows of a two-stage model in the shape the scorer takes."""
    plan = dict(plan)
    aggregate = ctx.stored("adjusted_aggregate" if name == "two_stage_sa" else "aggregate")
    if name == "two_stage_known":
        paths = TS.known_paths(aggregate, ctx.calendar, plan)
    else:
        paths = TS.aggregate_paths(aggregate, ctx.calendar, plan)
    if name == "two_stage_news":
        news, topics = ctx.stored("national_news"), ctx.need("national_topics")
        paths = cut_lineage(paths, "paths")  # a few rows per fold
        fixed = []
        for horizon in plan:
            fix = TS.news_correction(TS.aggregate_residuals(aggregate, news, paths, horizon), news, topics)
            fixed.append(TS.corrected_paths(paths, fix, horizon))
        paths = cut_lineage(union_all(fixed), "corrected")
    return TS.two_stage(ctx.arrays if series is None else series, plan, paths, TS.aggregate_array(aggregate, ctx.calendar), name=name)


def run_models(ctx: PanelContext, names: Sequence[str], plan: Mapping[int, Sequence[Fold]], config: TreeConfig = TreeConfig(),
               sample: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Score rows of all named models on the same series and folds, as one table partitioned by model.

    Models that need one series share one scan of the panel. Each need is written as it is done, so a
    failure later loses none of it; the table is read back from ``path``.
    """
    chosen = needs(names)
    scored = ctx.arrays if sample is None else ctx.arrays.join(sample.select("series_id"), "series_id", "left_semi")
    path = path or work_path(scored.sparkSession, "scores")

    def write(rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("model").parquet(path)

    rows = backtest.fold_rows(scored, fold_array(dict(plan)))
    if "series" in chosen:
        write(backtest.score_rows(backtest.forecast_series(rows, chosen["series"])))
    if "solver" in chosen:
        write(backtest.score_rows(solvers.forecast_series(rows, tuple(chosen["solver"]))))
    for name in chosen.get("aggregate", []):
        write(backtest.score_rows(staged(ctx, name, plan, scored)))
    for name in chosen.get("panel", []):
        write(trees.evaluate_panel(ctx, name, plan, config, sample))
    spark = scored.sparkSession
    stored = spark.read.parquet(path)
    return stored.withColumn("model", F.col("model").cast("string")).select(*backtest.SCORE_KEYS, *[c for c in stored.columns if c not in backtest.SCORE_KEYS])
