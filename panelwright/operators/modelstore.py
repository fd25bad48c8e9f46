"""Fitted panel learners in a folder that the driver and all executors share.

A model is fitted once for a variant, origin and step (and horizon, where the common factor depends on it), saved, and
read back for every later forecast. Its entry is written after the trees, in a folder of its own, so a fit
that was interrupted leaves no entry and is done again.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, replace

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from panelwright.functions.frames import union_all
from panelwright.operators import longseries as L, trees
from panelwright.operators.trees import PanelContext, StepModel, TreeConfig, Vectors
from panelwright.protocol import Fold
from panelwright.session import cut_lineage

ENTRY = "variant string, horizon int, step int, train_end int, origin string, config string, columns string, pretrained boolean, folder string, flagged string"


class ModelStore:
    """Models of one panel by variant, horizon (0: any), step, origin and settings."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def entries(self) -> DataFrame:
        """What is stored: one row for each model."""
        try:
            return self.spark.read.schema(ENTRY).json(f"{self.path}/entries/*")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], ENTRY)

    def known(self, variant: str, config: TreeConfig) -> dict[tuple[int, int, int], dict]:
        """Entries of a variant by (horizon, step, train_end): a handful of rows."""
        rows = self.entries().where((F.col("variant") == variant) & (F.col("config") == settings(config))).collect()
        return {(r["horizon"], r["step"], r["train_end"]): r.asDict() for r in sorted(rows, key=lambda r: r["folder"], reverse=True)}

    def save(self, variant: str, horizon: int, step: int, ctx: PanelContext, config: TreeConfig, table: Vectors, model: StepModel) -> None:
        name = f"{variant}-{horizon}-{step}-{uuid.uuid4().hex}"
        folder = f"{self.path}/models/{name}"
        model.trees.save(f"{folder}/trees")
        if model.base is not None:
            model.base.save(f"{folder}/base")
        row = (variant, horizon, step, ctx.calendar.n_months, ctx.calendar.last.isoformat(), settings(config), json.dumps(table.columns), model.base is not None, folder, json.dumps(table.flagged))
        self.spark.createDataFrame([row], ENTRY).coalesce(1).write.json(f"{self.path}/entries/{name}")  # a folder each: fits end side by side

    def load(self, entry: dict) -> StepModel:
        base = GBTRegressionModel.load(f"{entry['folder']}/base") if entry["pretrained"] else None
        return StepModel(GBTRegressionModel.load(f"{entry['folder']}/trees"), base)


def settings(config: TreeConfig) -> str:
    """What a fit depends on; how many run at once is no part of it."""
    return json.dumps({k: v for k, v in asdict(config).items() if k != "fits_at_once"}, sort_keys=True)


def at_origin(ctx: PanelContext) -> PanelContext:
    """The context without anything after the last month of the panel."""
    last = F.lit(ctx.calendar.last)
    return replace(
        ctx, aggregate=None if ctx.aggregate is None else L.cut_at(ctx.aggregate, last),
        long_series=None if ctx.long_series is None else ctx.long_series.where(F.col("month") <= last),
        external=None if ctx.external is None else ctx.external.where(F.col("month") <= last),
        news=None if ctx.news is None else ctx.news.where(F.col("month") <= last))


def fit_forward(store: ModelStore, ctx: PanelContext, name: str, horizons: Sequence[int], config: TreeConfig) -> list[tuple[int, int]]:
    """Fit and store what is missing for forecasts from the end of the panel; returns the fitted (horizon, step).

    The target of a step doesn't depend on the horizon unless the common factor is divided out, so one
    model serves a step of all horizons.
    """
    spec, end = trees.variant(name), ctx.calendar.n_months
    by_horizon = spec.factor or spec.regional
    wanted = [(h, s) for h in sorted(horizons) for s in range(1, h + 1)] if by_horizon else [(0, s) for s in range(1, max(horizons) + 1)]
    have = store.known(name, config)
    missing = [k for k in wanted if (*k, end) not in have]
    if not missing:
        return []
    ctx = at_origin(ctx)
    table = trees.panel_vectors(ctx, spec, max(horizons))
    long = trees.pretrain_vectors(ctx, spec, table.columns, end, max(horizons))
    past = {h: cut_lineage(trees.fold_factor(ctx, {h: [Fold(0, end, end, end + h)]}, spec.regional)[0], "factor") for h in {h for h, _ in missing}} if by_horizon else {}

    def task(horizon: int, step: int):
        def run() -> None:
            model = trees.fit_step(table.rows, step, end, config, trees.moved(past.get(horizon), 0, step), long)
            store.save(name, horizon, step, ctx, config, table, model)

        return run

    trees.side_by_side(store.spark, [task(*k) for k in missing], table.fits_at_once(config.fits_at_once))
    return missing


def forecast(store: ModelStore, ctx: PanelContext, name: str, horizon: int, config: TreeConfig, fitted_at: int | None = None) -> DataFrame:
    """``series_id, step, forecast`` from the end of the panel, by stored models.

    ``fitted_at``: number of months of the panel that the models have seen; by default the latest that is stored and not
    later than the panel, so models of an earlier origin go on serving later ones.
    """
    spec, end = trees.variant(name), ctx.calendar.n_months
    have = store.known(name, config)
    key = horizon if spec.factor or spec.regional else 0
    complete = [e for e in {e for _, _, e in have} if all((key, s, e) in have for s in range(1, horizon + 1)) and e <= end]
    if fitted_at is None and complete:
        fitted_at = max(complete)
    if fitted_at not in complete:
        raise LookupError(f"no stored models of {name!r} for {horizon} steps ahead at month {fitted_at or end}; fit_forward makes them")
    sources = [ctx.clean, ctx.arrays, ctx.category_clean, ctx.external, ctx.regions, ctx.news]
    ctx = at_origin(ctx)
    entries = {s: have[key, s, fitted_at] for s in range(1, horizon + 1)}
    table, columns = trees.feature_table(ctx, spec, 1)
    for e in entries.values():
        if json.loads(e["columns"]) != columns:
            raise ValueError(f"the stored models of {name!r} take {e['columns']}, the panel has {columns}")
    ahead = None
    if key:
        ahead = cut_lineage(trees.fold_factor(ctx, {horizon: [Fold(0, end, end, end + horizon)]}, spec.regional)[1], "factor").drop("fold")

    def origin(flagged: str | None) -> DataFrame:
        """Vectors of the last month with the flags a model was fitted with, written once for all horizons; None: all columns have one."""
        here = table.where(F.col("t") == end - 1)
        return ctx.once(f"origin {spec} {columns} {flagged} {end}", sources, lambda: trees.vectors(here, columns, flagged and json.loads(flagged))).at(end - 1)

    by_flags: dict[str | None, dict[int, StepModel]] = {}
    for step, e in entries.items():
        by_flags.setdefault(e["flagged"], {})[step] = store.load(e)
    return union_all([trees.predicted(models, origin(flagged), ahead) for flagged, models in by_flags.items()])
