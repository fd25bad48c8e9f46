"""The panel learner, its stored models, the registry and the forward forecast."""
import dataclasses
import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from panelwright.operators import backtest, models, modelstore, serving, sweep, trees
from panelwright.operators.modelstore import ModelStore
from panelwright.plans import tree_queries
from panelwright.protocol import Calendar, Fold, ForwardConfig, fold_array, rolling_origin
from panelwright.session import work_path

CAL = Calendar(date(2020, 1, 1), 44)
QUICK = trees.TreeConfig(rounds=4, depth=3, min_leaf=2)
GROWTH = 1.03


def month(t):
    return CAL.month(t)


@pytest.fixture(scope="module")
def ctx(spark):
    """Twelve series that grow alike, month by month; the aggregate goes on after the panel."""
    rows = [(f"s{k}", t, (100.0 + 10 * k) * GROWTH**t) for k in range(12) for t in range(CAL.n_months)]
    clean = spark.createDataFrame(rows, "series_id string, t int, y double").cache()
    arrays = clean.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("y"))
    aggregate = spark.createDataFrame([(month(t), 1000.0 * GROWTH**t * (1 + 0.01 * math.sin(t))) for t in range(CAL.n_months + 12)], "month date, value double")
    parts = clean.select("series_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("category"), "t", (F.col("y") / 2).alias("y"))
    industry = spark.createDataFrame([(f"i{k}", month(t), 50.0 * GROWTH**t + k) for k in range(8) for t in range(CAL.n_months + 6)], "series_key string, month date, value double")
    return trees.PanelContext(calendar=CAL, clean=clean, arrays=arrays.cache(), aggregate=aggregate, category_clean=parts, categories=("A", "B"), long_series=industry,
                              regions=spark.createDataFrame([(f"s{k}", None if k % 2 else "east") for k in range(12)], "series_id string, region string"))


def test_fits_side_by_side_equal_fits_one_by_one(ctx):
    folds = rolling_origin(CAL.n_months, 2, 2)
    table = trees.vectors(*trees.feature_table(ctx, trees.Variant(), 2))
    wide = trees.fit_predict(ctx, trees.Variant(), table, folds, QUICK)
    single = trees.fit_predict(ctx, trees.Variant(), table, folds, dataclasses.replace(QUICK, fits_at_once=1))
    for a, b in zip(wide, single):
        found = {(r.series_id, r.step): r.forecast for r in a.collect()}
        assert found == {(r.series_id, r.step): r.forecast for r in b.collect()} and len(found) == 24
    # every ratio in the panel is the same, so trees can only say that ratio
    last = {r.series_id: r.y for r in ctx.clean.where(F.col("t") == folds[1].train_end - 1).collect()}
    assert all(abs(v - last[s] * GROWTH**step) < 1e-6 * v for (s, step), v in found.items())


def test_an_origin_without_rows_is_a_refusal(ctx):
    rows = trees.evaluate_panel(ctx, "panel_trees", {2: [Fold(0, 5, 5, 7), Fold(1, 40, 40, 42)]}, QUICK).collect()
    assert {r.fold: r.error for r in rows} == {0: "ValueError: no training rows for step 1", 1: None} and len(rows) == 24


def test_pretrained_trees(ctx):
    rows = trees.evaluate_panel(ctx, "panel_trees_pretrain", {1: [Fold(0, 43, 43, 44)]}, QUICK).collect()
    assert len(rows) == 12 and all(r.error is None and r.mae < 1.0 for r in rows)


def test_regions_without_a_ratio_change_nothing(ctx, spark):
    """Series without a region, and regions below the least number of members, move with the country."""
    plan = {2: [Fold(0, 40, 40, 42)]}
    plain_past, plain_ahead = trees.fold_factor(ctx, plan, regional=False)
    for regions in (ctx.regions, ctx.regions.withColumn("region", F.lit(None).cast("string"))):
        past, ahead = trees.fold_factor(dataclasses.replace(ctx, regions=regions, min_members=99), plan, regional=True)
        want = {(r.fold, r.step): r.multiplier for r in plain_ahead.collect()}
        got = ahead.collect()
        assert len(got) == 12 * len(want) and all(abs(r.multiplier - want[r.fold, r.step]) < 1e-12 for r in got)
        seen = {(r.t, r.step): r.multiplier for r in plain_past.collect()}
        assert all(abs(r.multiplier - seen[r.t, r.step]) < 1e-12 for r in past.collect())


def test_stored_models_are_fitted_once_and_serve_later_origins(ctx, spark, monkeypatch):
    store = ModelStore(spark, work_path(spark, "store"))
    with pytest.raises(LookupError):
        modelstore.forecast(store, ctx, "panel_trees_cat", 1, QUICK)
    assert modelstore.fit_forward(store, ctx, "panel_trees_cat", [1, 3], QUICK) == [(0, 1), (0, 2), (0, 3)]
    assert modelstore.fit_forward(store, ctx, "panel_trees_cat", [3], QUICK) == []  # nothing is fitted again
    first = {(r.series_id, r.step): r.forecast for r in modelstore.forecast(store, ctx, "panel_trees_cat", 3, QUICK).collect()}
    again = ModelStore(spark, store.path)
    assert {(r.series_id, r.step): r.forecast for r in modelstore.forecast(again, ctx, "panel_trees_cat", 3, QUICK).collect()} == first
    table = trees.vectors(*trees.feature_table(modelstore.at_origin(ctx), trees.variant("panel_trees_cat"), 3))
    direct = trees.fit_predict(modelstore.at_origin(ctx), trees.variant("panel_trees_cat"), table, [Fold(0, 44, 44, 47)], QUICK)[0]
    assert {(r.series_id, r.step): r.forecast for r in direct.collect()} == pytest.approx(first)

    # two months later the models of the earlier origin go on serving, without a fit
    rows = ctx.clean.unionByName(ctx.clean.where("t = 43").withColumn("t", F.explode(F.array(F.lit(44), F.lit(45)))).withColumn("y", F.col("y") * F.pow(F.lit(GROWTH), F.col("t") - 43)))
    parts = rows.select("series_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("category"), F.col("t").cast("int").alias("t"), (F.col("y") / 2).alias("y"))
    later = dataclasses.replace(ctx, calendar=Calendar(CAL.start, 46), clean=rows, category_clean=parts)
    monkeypatch.setattr(trees, "fit_step", lambda *a, **k: pytest.fail("fitted again"))
    found = modelstore.forecast(again, later, "panel_trees_cat", 2, QUICK).collect()
    level = {r.series_id: r.y for r in rows.where("t = 45").collect()}
    assert len(found) == 24 and all(abs(r.forecast - level[r.series_id] * GROWTH**r.step) < 1e-6 * r.forecast for r in found)
    with pytest.raises(LookupError):
        modelstore.forecast(again, later, "panel_trees_cat", 2, dataclasses.replace(QUICK, rounds=5))


def test_an_interrupted_fit_is_done_again(ctx, spark, monkeypatch):
    store = ModelStore(spark, work_path(spark, "store"))
    real = trees.fit_step

    def broken(rows, step, *a, **k):
        if step == 2:
            raise RuntimeError("lost")
        return real(rows, step, *a, **k)

    monkeypatch.setattr(trees, "fit_step", broken)
    with pytest.raises(RuntimeError):
        modelstore.fit_forward(store, ctx, "panel_trees", [2], QUICK)
    monkeypatch.setattr(trees, "fit_step", real)
    assert (0, 2) in modelstore.fit_forward(store, ctx, "panel_trees", [2], QUICK)
    assert modelstore.forecast(store, ctx, "panel_trees", 2, QUICK).count() == 24


def test_forward_forecast_with_the_learner(ctx, spark):
    config = ForwardConfig(horizons=(1, 3, 12), recommended=((1, "panel_trees_cat"), (3, "seasonal_drift"), (12, "two_stage")))
    store = ModelStore(spark, work_path(spark, "store"))
    args = (ctx.arrays, ctx.aggregate, ctx.regions, CAL)
    rows = serving.forecast_forward(*args, config, ctx, store, QUICK).collect()
    closed = ForwardConfig(horizons=(1, 3, 12), recommended=((1, "seasonal_drift"), (3, "seasonal_drift"), (12, "two_stage")))
    plain = serving.forecast_forward(*args, closed).collect()
    key = lambda r: (r.series_id, r.model, r.horizon, r.month)
    learnt = [r for r in rows if r.model == "panel_trees_cat"]
    assert len(learnt) == 12 and all(r.recommended and not r.uses_published_aggregate and r.horizon == 1 for r in learnt)
    assert sorted(map(tuple, (r for r in rows if r not in learnt)), key=str) == sorted(map(tuple, (r for r in plain if (r.model, r.horizon) != ("seasonal_drift", 1))), key=str)
    assert len({key(r) for r in rows}) == len(rows)
    with pytest.raises(ValueError):
        serving.forecast_forward(*args, config)
    with pytest.raises(KeyError):
        serving.forecast_forward(*args, ForwardConfig(recommended=((1, "prophecy"),)))


def test_nothing_after_the_origin_reaches_the_learner(ctx, spark):
    spoilt = dataclasses.replace(
        ctx, aggregate=ctx.aggregate.withColumn("value", F.when(F.col("month") > F.lit(CAL.last), F.col("value") * 1000).otherwise(F.col("value"))),
        long_series=ctx.long_series.withColumn("value", F.when(F.col("month") > F.lit(CAL.last), F.col("value") * 1000).otherwise(F.col("value"))))
    for name in ("panel_trees_factor", "panel_trees_pretrain"):
        found = []
        for c in (ctx, spoilt):
            store = ModelStore(spark, work_path(spark, "store"))
            modelstore.fit_forward(store, c, name, [2], QUICK)
            found.append({(r.series_id, r.step): r.forecast for r in modelstore.forecast(store, c, name, 2, QUICK).collect()})
        assert found[0] == found[1] and len(found[0]) == 24


def test_one_run_over_all_needs(ctx, spark):
    names = ["naive_last", "drift", "theta", "two_stage", "two_stage_known", "panel_trees"]
    plan = {2: rolling_origin(CAL.n_months, 2, 2)}
    rows = models.run_models(ctx, names, plan, QUICK).collect()
    assert {(r.model, r.fold) for r in rows} == {(m, f) for m in names for f in range(2)} and len(rows) == 6 * 2 * 12
    closed = backtest.score_series(ctx.arrays, fold_array(plan), ["naive_last", "drift"]).collect()
    assert sorted(tuple(r) for r in rows if r.model in ("naive_last", "drift")) == sorted(map(tuple, closed))
    few = models.run_models(ctx, ["naive_last", "panel_trees"], {1: [Fold(0, 43, 43, 44)]}, QUICK, sample=ctx.arrays.limit(3))
    assert few.groupBy("model").count().where("count = 3").count() == 2


def test_the_registry_knows_its_models():
    assert models.needs(["drift", "panel_trees", "ets_damped", "two_stage_news"]) == {
        "series": ["drift"], "panel": ["panel_trees"], "solver": ["ets_damped"], "aggregate": ["two_stage_news"]}
    with pytest.raises(KeyError, match="prophecy"):
        models.needs(["drift", "prophecy"])
    with pytest.raises(ValueError, match="twice"):
        models.needs(["drift", "drift"])
    rest = models.unconfigured(["drift", "panel_trees"])
    assert "drift" not in rest and "panel_trees_news" in rest and len(rest) == len(models.registered()) - 2
    assert {m for _, m in ForwardConfig().recommended} | {ForwardConfig().comparison, ForwardConfig().known_aggregate} <= set(models.registered())


def whole_fits(config):
    """The protocol's settings, however many fits run at once."""
    return modelstore.settings(config) == modelstore.settings(trees.TreeConfig()) and (config.rounds, config.depth) == (300, 5)


def test_the_registered_forward_forecast_fits_the_protocols_trees(ctx, monkeypatch):
    asked = []
    monkeypatch.setattr(tree_queries, "context", lambda spark, sf, national=False: ctx)
    monkeypatch.setattr(tree_queries, "work_path", lambda spark, name: name)
    monkeypatch.setattr(serving, "forecast_forward", lambda *args: asked.append(args[-1]))
    tree_queries.forecast_forward(None, "")
    assert whole_fits(asked[0])


def test_the_registered_evaluation_fits_the_protocols_trees(ctx, monkeypatch):
    asked = []
    monkeypatch.setattr(tree_queries, "context", lambda spark, sf, national=False: ctx)
    monkeypatch.setattr(trees, "evaluate_panel", lambda *args: asked.append(args))
    tree_queries.evaluate_panel(None, "")
    (_, name, plan, config), = asked
    assert name == "panel_trees" and whole_fits(config) and [len(f) for f in plan.values()] == [3]


def test_a_long_plan_is_scored_in_parts(ctx, monkeypatch):
    plan = {2: rolling_origin(CAL.n_months, 2, 3)}
    whole = trees.evaluate_panel(ctx, "panel_trees", plan, QUICK)
    written = []
    real = trees.cut_lineage
    monkeypatch.setattr(trees, "cut_lineage", lambda df, name="cut", *a: written.append(name) or real(df, name, *a))
    monkeypatch.setattr(trees, "FOLDS_AT_ONCE", 2)
    parts = trees.evaluate_panel(ctx, "panel_trees", plan, QUICK)
    assert written.count("fold-scores") == 2 and parts.count() == 3 * 12
    assert sorted(map(str, parts.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_the_registered_sweep_takes_every_origin_and_six_variants(ctx, monkeypatch):
    asked = []
    monkeypatch.setattr(tree_queries, "context", lambda spark, sf, national=False: ctx)
    monkeypatch.setattr(sweep, "length_sweep", lambda *args: asked.append(args))
    tree_queries.sweep(None, "")
    (_, names, plan, config), = asked
    assert len(set(names)) == 6 and set(names) <= set(trees.VARIANTS) and whole_fits(config)
    assert [(f.train_end, f.test_end) for f in plan[3]] == [(t, t + 3) for t in range(12, 77)] and list(plan) == [3]


def test_the_registered_run_takes_all_models(ctx, monkeypatch):
    asked = []
    monkeypatch.setattr(tree_queries, "context", lambda spark, sf, national=False: ctx)
    monkeypatch.setattr(tree_queries.metrics, "summarise", lambda rows, by: rows)
    monkeypatch.setattr(models, "run_models", lambda *args: asked.append(args))
    tree_queries.all_models(None, "")
    (_, names, _, config), = asked
    assert models.unconfigured(names) == [] and whole_fits(config)
