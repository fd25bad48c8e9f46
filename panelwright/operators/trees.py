"""The panel learner: one boosted-tree regressor per step on panel features.

The frames stay distributed. Feature vectors are assembled and written once for a table; the fits
over folds and steps don't depend on each other, so a few threads of the driver submit them side by
side, each to a scheduler pool of its own (``spark.scheduler.mode`` FAIR makes the pools count), and the
cluster is not idle between the short stages of a single fit. Trees reject NaN, so every nullable
feature is a value and a flag.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import RLock
from typing import TypeVar

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from panelwright.functions.frames import union_all
from panelwright.operators import factor, features as X, two_stage as TS
from panelwright.operators.backtest import score_rows
from panelwright.protocol import Calendar, Fold, fold_array
from panelwright.session import cut_lineage, ensure_checkpoint_dir


T = TypeVar("T")
#: Vectors take little room in a file and much more as tree points, so a task's share of a table is bounded by rows.
ROWS_PER_FILE = 20_000
#: Rows of all fits that run side by side: a fit holds its rows as tree points, and a big table keeps the cluster busy by itself.
ROWS_AT_ONCE = 16_000_000
#: Trees of a fold stay on the driver until its forecasts are scored, so a longer plan is scored and written in parts.
FOLDS_AT_ONCE = 8


@dataclass(frozen=True)
class TreeConfig:
    rounds: int = 300
    step_size: float = 0.05
    depth: int = 5  # about 31 leaves
    min_leaf: int = 40
    bins: int = 64
    seed: int = 20260920
    fits_at_once: int = 4


@dataclass(frozen=True)
class Variant:
    external: bool = False
    factor: bool = False
    pretrain: bool = False
    categories: bool = False
    regional: bool = False
    stack: bool = False
    news: bool = False


VARIANTS: dict[str, Variant] = {
    "panel_trees": Variant(),
    "panel_trees_ext": Variant(external=True),
    "panel_trees_factor": Variant(factor=True),
    "panel_trees_pretrain": Variant(pretrain=True),
    "panel_trees_cat": Variant(categories=True),
    "panel_trees_all": Variant(external=True, factor=True, categories=True),
    "panel_trees_region": Variant(factor=True, regional=True),
    "panel_trees_stack": Variant(stack=True),
    "panel_trees_stack_factor": Variant(stack=True, factor=True),
    "panel_trees_news": Variant(news=True),
}


def variant(name: str) -> Variant:
    if name not in VARIANTS:
        raise KeyError(f"unknown panel model {name!r}; known: {sorted(VARIANTS)}")
    return VARIANTS[name]


@dataclass
class PanelContext:
    """Everything a panel model may read, by name."""

    calendar: Calendar
    clean: DataFrame  # series_id, t, y; as ``features.cells`` of the arrays nothing has to be shuffled
    arrays: DataFrame  # series_id, y
    aggregate: DataFrame | None = None  # month, value
    category_clean: DataFrame | None = None  # series_id, category, t, y; or y as arrays, where ``clean`` is cells of arrays
    categories: Sequence[str] = ()
    external: DataFrame | None = None  # month, growth columns
    long_series: DataFrame | None = None  # series_key, month, value
    regions: DataFrame | None = None  # series_id, region
    news: DataFrame | None = None  # region, month, topics
    topics: Sequence[str] = ()
    adjusted_aggregate: DataFrame | None = None  # month, value, seasonally adjusted
    national_news: DataFrame | None = None  # month, national topics
    national_topics: Sequence[str] | None = None
    min_members: int = 8
    notes: list[str] = field(default_factory=list)
    #: What was made once, by name and the frames it was made of; a context replaced from this one goes on using it.
    kept: dict = field(default_factory=dict, repr=False, compare=False)
    lock: RLock = field(default_factory=RLock, repr=False, compare=False)

    def need(self, name: str):
        value = getattr(self, name)
        if value is None:
            raise RuntimeError(f"the panel model needs {name!r} in its context")
        return value

    def once(self, name: str, sources: Sequence[DataFrame | None], build: Callable[[], T]) -> T:
        """What ``build`` makes of the sources: made at first use and kept."""
        key = (name, *map(id, sources))
        with self.lock:
            if key not in self.kept:
                self.kept[key] = (build(), sources)  # the sources are held, so no other frame gets their ids
            return self.kept[key][0]

    def stored(self, name: str) -> DataFrame:
        """A needed table, written at first use: the scans behind it happen once for all models and folds."""
        table = self.need(name)
        return self.once(name, [table], lambda: cut_lineage(table, name.replace("_", "-")))


def feature_table(ctx: PanelContext, spec: Variant, horizon: int) -> tuple[DataFrame, list[str]]:
    """All rows ``series_id, t`` with features and targets ahead; built once for every fold."""
    parts = ctx.stored("category_clean") if spec.categories or spec.stack else None
    packed = parts is not None and X.whole(parts)
    clean, columns = ctx.clean.select("series_id", "t", "y", *[c for c in ctx.clean.columns if c == X.WHOLE]), list(X.LAG_COLUMNS)
    if spec.categories:
        shares = X.category_shares(ctx.arrays if packed else ctx.clean, parts, ctx.categories)
        columns += [c for c in shares.columns if c not in ("series_id", "t")]
        if packed:  # series meet their shares as arrays, before they have a row per month
            clean = X.cells(ctx.arrays.select("series_id", "y").join(shares, "series_id", "left"))
    rows = X.lag_features(X.with_targets(clean, horizon))
    if spec.categories and not packed:
        rows = rows.join(shares, ["series_id", "t"], "left")
    if spec.external:
        outside = ctx.stored("external")
        rows = rows.withColumn("month", ctx.calendar.month_at(F.col("t"))).join(F.broadcast(outside), "month", "left").drop("month")  # one row per month
        columns += [c for c in outside.columns if c != "month"]
    if spec.news:
        rows = X.news_features(rows, ctx.stored("regions"), ctx.stored("news"), ctx.topics, ctx.calendar)
        columns += [f"news_{t}" for t in ctx.topics]
    if spec.stack:
        keys = ("series_id", "category")
        own = X.cells(parts.select(*keys, "y"), keys) if packed else parts.select(*keys, "t", "y")
        extra = X.lag_features(X.with_targets(own, horizon, keys), keys).drop("category")
        rows = X.stacked(rows, extra)
        columns.append("is_total")
    return rows, columns


def fold_factor(ctx: PanelContext, plan: dict[int, Sequence[Fold]], regional: bool) -> tuple[DataFrame, DataFrame]:
    """Realised multipliers of past moves and forecast multipliers, for all folds of one horizon."""
    horizon = max(plan)
    folds = fold_array(plan)
    aggregate = ctx.stored("aggregate")
    federal = factor.log_federal(aggregate, ctx.calendar, horizon)
    # a row for each month and step, the same for every fold and variant
    medians = ctx.once(f"medians {horizon}", [ctx.arrays], lambda: cut_lineage(factor.median_log_ratios(ctx.arrays, horizon), "medians"))
    pairs = factor.training_pairs(medians, federal, folds)
    paths = TS.aggregate_paths(aggregate, ctx.calendar, plan, inner=False)
    best = paths.select("horizon", "fold", "model", "explained", F.col("log_path").alias("path"), F.col("last_log").alias("last"))
    scale = cut_lineage(factor.scales(factor.elasticity(pairs), best), "scale")
    seen = federal.join(scale.select("horizon", "fold", "step", "scale"), "step")
    if not regional:
        past = seen.select("fold", "t", "step", F.exp(F.col("scale") * F.col("log_federal")).alias("multiplier"))
        return past, factor.multipliers(scale).select("fold", "step", "multiplier")
    regions = ctx.stored("regions")
    by_region = factor.pooled_slope(factor.training_pairs(
        factor.median_log_ratios(ctx.arrays.join(regions, "series_id"), horizon, ("region",)), federal, folds), ("region",))
    members = ctx.arrays.join(regions, "series_id").groupBy("region").agg(F.count(F.lit(1)).alias("n_members"))
    ratios = cut_lineage(factor.regional_ratios(by_region, factor.pooled_slope(pairs), members, min_members=ctx.min_members), "ratios")
    series = ctx.arrays.select("series_id").join(regions.select("series_id", "region"), "series_id", "left")
    past = factor.realised_by_series(series, federal, scale, ratios).drop("horizon")
    ahead = factor.series_multipliers(series, scale, ratios)
    return past, ahead.select("series_id", "fold", "step", "multiplier")


def factor_tables(ctx: PanelContext, plan: dict[int, Sequence[Fold]], regional: bool) -> tuple[DataFrame, DataFrame]:
    """The same, written once for all models that divide it out."""
    sources = [ctx.arrays, ctx.aggregate, ctx.regions if regional else None]
    return ctx.once(f"factor {regional} {ctx.min_members} {plan}", sources, lambda: tuple(cut_lineage(x, "factor") for x in fold_factor(ctx, plan, regional)))


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], T]], width: int) -> list[T]:
    """Results of independent tasks that run Spark jobs; at most ``width`` run at once. The first error is raised."""
    def pooled(number: int, task: Callable[[], T]) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{number % width}")
        return task()

    with ThreadPoolExecutor(max(1, width)) as threads:
        futures = [threads.submit(inheritable_thread_target(spark)(pooled), n, task) for n, task in enumerate(tasks)]
        return [f.result() for f in futures]


@dataclass
class Vectors:
    """A written feature table: ``series_id, t, y, y_1 .., features`` and ``is_total`` where series are stacked."""

    rows: DataFrame
    columns: list[str]
    flagged: list[str]

    def fits_at_once(self, most: int) -> int:
        """How many fits on the table may run side by side; counting reads the footers of its files only."""
        return max(1, min(most, ROWS_AT_ONCE // max(1, self.rows.count())))

    def at(self, t: int) -> DataFrame:
        """The rows of the series themselves at one month."""
        here = self.rows.where(F.col("t") == t)
        return here.where("is_total = 1.0") if "is_total" in self.rows.columns else here


def flagged_columns(ctx: PanelContext, spec: Variant, columns: Sequence[str]) -> list[str]:
    """The columns that need a flag of missing values.

    Lag features of series without holes are never missing. Their flags would be 0 in every row: no tree splits on them, but every
    fit would read, hold and count them. Long series may have holes of their own, so all columns are flagged where they are fitted first.
    """
    series = [ctx.arrays, *([ctx.stored("category_clean")] if spec.stack else [])]
    if spec.pretrain or X.WHOLE not in ctx.clean.columns or not all(X.whole(s) for s in series):
        return list(columns)
    known = all(ctx.once("without holes", [s], lambda s=s: X.without_holes(s)) for s in series)
    return [c for c in columns if not (known and c in X.LAG_COLUMNS)]


def panel_vectors(ctx: PanelContext, spec: Variant, horizon: int) -> Vectors:
    """The vectors of all rows of the panel for every fold of a horizon."""
    table, columns = feature_table(ctx, spec, horizon)
    return vectors(table, columns, flagged_columns(ctx, spec, columns))


def vectors(table: DataFrame, columns: Sequence[str], flagged: Sequence[str] | None = None) -> Vectors:
    """Feature vectors of a table, assembled and written once for all fits; ``flagged``: columns with a flag of missing values, by default all."""
    with_flags, inputs = X.with_missing_flags(table, columns, flagged)
    kept = [c for c in table.columns if c in ("series_id", "t", "y", "is_total") or c.startswith("y_")]
    done = VectorAssembler(inputCols=inputs, outputCol="features").transform(with_flags).select(*kept, "features")
    return Vectors(cut_lineage(done, "vectors", ROWS_PER_FILE), list(columns), list(columns if flagged is None else flagged))


@dataclass
class StepModel:
    """Trees of one step; ``base`` are those of long series that were fitted first."""

    trees: GBTRegressionModel
    base: GBTRegressionModel | None = None

    def ratios(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``ratio``: what the level of the step is to the level of the row."""
        out = self.trees.transform(rows)
        if self.base is None:
            return out
        return self.base.transform(out.withColumnRenamed("ratio", "_rest")).withColumn("ratio", F.col("ratio") + F.col("_rest")).drop("_rest")


def _boosted(rows: DataFrame, config: TreeConfig, target: str, rounds: int) -> GBTRegressionModel:
    ensure_checkpoint_dir(rows.sparkSession)
    return GBTRegressor(
        featuresCol="features", labelCol=target, predictionCol="ratio", maxIter=max(rounds, 1), stepSize=config.step_size,
        maxDepth=config.depth, minInstancesPerNode=config.min_leaf, maxBins=config.bins, seed=config.seed, checkpointInterval=10,
    ).fit(rows.select("features", target))


def fit_step(rows: DataFrame, step: int, train_end: int, config: TreeConfig, multipliers: DataFrame | None = None, long: DataFrame | None = None) -> StepModel:
    """Trees of one step on all rows whose target lies before ``train_end``.

    ``multipliers``: realised common moves to divide out. ``long``: rows of long series, on which half of the
    rounds are fitted; the other half is fitted on what these leave unexplained.
    """
    train = X.ratio_target(rows, step, train_end, multipliers)
    if train.isEmpty():
        raise ValueError(f"no training rows for step {step}")
    if long is None:
        return StepModel(_boosted(train, config, "target", config.rounds))
    half = config.rounds // 2
    seen = long.where(F.col(f"y_{step}").isNotNull()).withColumn("target", F.col(f"y_{step}") / F.col("y"))
    base = _boosted(seen, config, "target", half)
    left = base.transform(train).withColumn("rest", F.col("target") - F.col("ratio")).drop("ratio")
    return StepModel(_boosted(left, config, "rest", config.rounds - half), base)


def pretrain_vectors(ctx: PanelContext, spec: Variant, columns: Sequence[str], train_end: int, horizon: int) -> DataFrame | None:
    """Vectors of the long series up to an origin; features they don't have are missing."""
    if not spec.pretrain:
        return None
    long = X.pretrain_rows(ctx.stored("long_series"), ctx.calendar.month(train_end - 1), horizon)
    missing = [c for c in columns if c not in long.columns]
    return vectors(long.withColumns({c: F.lit(None).cast("double") for c in missing}), columns).rows


def moved(past: DataFrame | None, fold: int, step: int) -> DataFrame | None:
    """Realised multipliers of one fold and step."""
    return None if past is None else past.where((F.col("fold") == fold) & (F.col("step") == step)).drop("fold", "step")


def predicted(models: Mapping[int, StepModel], rows: DataFrame, ahead: DataFrame | None = None) -> DataFrame:
    """``series_id, step, forecast`` of the models by step on rows of one month; ``ahead``: multipliers of the common factor.

    All steps are read off the same rows, so their table is scanned once.
    """
    for step, m in models.items():
        rows = m.ratios(rows).withColumnRenamed("ratio", f"_ratio_{step}")
    levels = [F.struct(F.lit(step).alias("step"), (F.col("y") * F.col(f"_ratio_{step}")).alias("forecast")) for step in models]
    out = rows.select("series_id", F.inline(F.array(*levels)))
    if ahead is not None:
        keys = [k for k in ("series_id", "step") if k in ahead.columns]
        out = out.join(ahead, keys, "left").withColumn("forecast", F.col("forecast") * F.coalesce("multiplier", F.lit(1.0))).drop("multiplier")
    return out


def _fold_fits(ctx: PanelContext, spec: Variant, table: Vectors, folds: Sequence[Fold], config: TreeConfig, past: DataFrame | None) -> list[dict[int, StepModel] | Exception]:
    """Models by step of each fold, or why the fold has none. All folds and steps are fitted side by side."""
    longs = {f.index: pretrain_vectors(ctx, spec, table.columns, f.train_end, f.horizon) for f in folds}

    def task(fold: Fold, step: int) -> Callable[[], StepModel | Exception]:
        def run() -> StepModel | Exception:
            try:
                return fit_step(table.rows, step, fold.train_end, config, moved(past, fold.index, step), longs[fold.index])
            except (ValueError, RuntimeError) as why:
                return why

        return run

    keys = [(f, step) for f in folds for step in range(1, f.horizon + 1)]
    done = dict(zip([(f.index, s) for f, s in keys], side_by_side(table.rows.sparkSession, [task(*k) for k in keys], table.fits_at_once(config.fits_at_once))))
    out: list[dict[int, StepModel] | Exception] = []
    for f in folds:
        own = {s: done[f.index, s] for s in range(1, f.horizon + 1)}
        out.append(next((m for m in own.values() if isinstance(m, Exception)), own))
    return out


def fit_predict(ctx: PanelContext, spec: Variant, table: Vectors, folds: Sequence[Fold], config: TreeConfig,
                past: DataFrame | None = None, ahead: DataFrame | None = None) -> list[DataFrame | Exception]:
    """``series_id, step, forecast`` of each fold: a regressor per step, fitted on the whole panel; or why there is none."""
    out: list[DataFrame | Exception] = []
    for fold, models in zip(folds, _fold_fits(ctx, spec, table, folds, config, past)):
        here = None if ahead is None else ahead.where(F.col("fold") == fold.index).drop("fold")
        out.append(models if isinstance(models, Exception) else predicted(models, table.at(fold.train_end - 1), here))
    return out


def evaluate_panel(ctx: PanelContext, name: str, plan: Mapping[int, Sequence[Fold]], config: TreeConfig,
                   sample: DataFrame | None = None) -> DataFrame:
    """Score rows: fitted on the full panel per fold, scored on the sample. A failed fold gives refusals with the reason."""
    from panelwright.operators.backtest import fold_rows

    spec = variant(name)
    scored = ctx.arrays if sample is None else ctx.arrays.join(sample.select("series_id"), "series_id", "left_semi")
    parts = []
    for horizon, folds in plan.items():
        table = panel_vectors(ctx, spec, horizon)
        past = ahead = None
        if spec.factor or spec.regional:
            past, ahead = factor_tables(ctx, {horizon: folds}, spec.regional)
        for k in range(0, len(folds), FOLDS_AT_ONCE):
            some, done = folds[k : k + FOLDS_AT_ONCE], []
            for fold, found in zip(some, fit_predict(ctx, spec, table, some, config, past, ahead)):
                rows = fold_rows(scored, fold_array({horizon: [fold]})).withColumn("model", F.lit(name))
                if isinstance(found, Exception):
                    reason = f"{type(found).__name__}: {found}"[:120]
                    done.append(score_rows(rows.withColumn("forecast", F.lit(None).cast("array<double>")).withColumn("error", F.lit(reason))))
                    continue
                packed = found.groupBy("series_id").agg(
                    F.transform(F.sort_array(F.collect_list(F.struct("step", "forecast"))), lambda x: x["forecast"]).alias("forecast"))
                joined = rows.join(packed, "series_id", "left").withColumn("error", F.lit(None).cast("string"))
                done.append(score_rows(joined))
            parts += [cut_lineage(union_all(done), "fold-scores")] if len(folds) > FOLDS_AT_ONCE else done
    return union_all(parts)
