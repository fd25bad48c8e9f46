"""What the panel learner reads is made once, without a shuffle of months, and in files of bounded rows."""
import json
import math
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from panelwright.operators import factor, features as X, modelstore, prep, trees
from panelwright.protocol import Calendar, Fold
from panelwright.session import work_path

CAL = Calendar(date(2020, 1, 1), 30)
QUICK = trees.TreeConfig(rounds=1, depth=2, min_leaf=2)
LEVEL = [100.0 * 1.02**t * (1 + 0.1 * math.sin(t)) for t in range(CAL.n_months)]


@pytest.fixture(scope="module")
def ctx(spark):
    """Series as arrays, categories A and B of each, and B of the last one unknown."""
    arrays = spark.createDataFrame([(f"s{k}", [(k + 1) * y for y in LEVEL]) for k in range(6)], "series_id string, y array<double>").cache()
    parts = spark.createDataFrame([(f"s{k}", c, [share * (k + 1) * y for y in LEVEL]) for k in range(6) for c, share in (("A", 0.25), ("B", 0.75)) if (k, c) != (5, "B")],
                                  "series_id string, category string, y array<double>").cache()
    aggregate = spark.createDataFrame([(CAL.month(t), 1000.0 * y) for t, y in enumerate(LEVEL)], "month date, value double")
    regions = spark.createDataFrame([(f"s{k}", "east") for k in range(6)], "series_id string, region string")
    return trees.PanelContext(calendar=CAL, clean=X.cells(arrays), arrays=arrays, aggregate=aggregate, category_clean=parts, categories=("A", "B"), regions=regions)


def by_rows(ctx):
    """The same context with a row for each month."""
    rows = lambda df, *keys: df.select(*keys, F.posexplode("y").alias("t", "y"))
    return replace(ctx, clean=rows(ctx.arrays, "series_id"), category_clean=rows(ctx.category_clean, "series_id", "category"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_of_arrays_need_no_shuffle_of_months(ctx):
    table, _ = trees.feature_table(ctx, trees.Variant(), 3)
    assert "Exchange" not in plan(table) and "Window" not in plan(table)
    assert "Window" not in plan(trees.feature_table(ctx, trees.Variant(categories=True, stack=True), 3)[0])


@pytest.mark.parametrize("spec", [trees.Variant(), trees.Variant(categories=True), trees.Variant(stack=True)])
def test_features_of_arrays_are_those_of_rows(ctx, spec):
    (whole, columns), (rows, same) = trees.feature_table(ctx, spec, 2), trees.feature_table(by_rows(ctx), spec, 2)
    assert columns == same and set(whole.columns) == set(rows.columns)
    found, want = (sorted((tuple(r[c] for c in sorted(whole.columns)) for r in df.collect()), key=repr) for df in (whole, rows))
    assert found == want and len(found) >= 6 * (CAL.n_months - 5)


def test_moments_leave_out_what_is_missing(spark):
    rows = spark.createDataFrame([("a", t, None if t == 6 else float(10 + t * t)) for t in range(9)], "series_id string, t int, y double")
    found = {r.t: r for r in X.lag_features(rows).collect()}
    seen = [10.0 + t * t for t in (3, 4, 5, 7, 8)]
    mean = sum(seen) / 5
    assert set(found) == {5, 7, 8} and found[8].mean_ratio_6 == pytest.approx(mean / 74)
    assert found[8].std_ratio_6 == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in seen) / 5) / 74)
    assert found[7].ratio_lag_2 is None and found[7].mean_ratio_3 == pytest.approx((35 + 59) / 2 / 59)


def test_a_table_of_the_context_is_written_once(ctx):
    first = ctx.stored("category_clean")
    assert ctx.stored("category_clean") is first and modelstore.at_origin(ctx).stored("category_clean") is first
    other = replace(ctx, aggregate=ctx.aggregate.where("value > 0"))
    assert other.stored("aggregate") is not ctx.stored("aggregate")


def test_medians_and_the_factor_are_made_once(ctx, monkeypatch):
    calls, real = [], factor.median_log_ratios
    monkeypatch.setattr(factor, "median_log_ratios", lambda *a, **k: calls.append(a) or real(*a, **k))
    folds = {1: [Fold(0, 29, 29, 30)]}
    fresh = replace(ctx, kept={})
    first = trees.factor_tables(fresh, folds, False)
    assert trees.factor_tables(fresh, folds, False) is first and len(calls) == 1
    trees.fold_factor(fresh, {1: [Fold(0, 28, 28, 29)]}, False)
    assert len(calls) == 1  # medians don't depend on the origin


def test_files_of_vectors_hold_few_rows(ctx, monkeypatch):
    monkeypatch.setattr(trees, "ROWS_PER_FILE", 10)
    rows = trees.vectors(*trees.feature_table(ctx, trees.Variant(), 1)).rows
    sizes = [r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 6 * (CAL.n_months - 5) and max(sizes) <= 10


def test_all_steps_are_read_off_one_scan(ctx):
    table = trees.vectors(*trees.feature_table(ctx, trees.Variant(), 2))
    models = {s: trees.fit_step(table.rows, s, 28, QUICK) for s in (1, 2)}
    found = trees.predicted(models, table.at(27))
    assert plan(found).count("FileScan") == 1
    one_by_one = {(r.series_id, s): r.y * r.ratio for s, m in models.items() for r in m.ratios(table.at(27)).collect()}
    assert {(r.series_id, r.step): r.forecast for r in found.collect()} == one_by_one and len(one_by_one) == 12


@pytest.mark.parametrize("max_gap", [0, 1, 2, 3])
def test_kept_series_are_filled_inside_their_arrays(spark, max_gap):
    patterns = ["X" * 12, "XX..XXXXXXXX", "XX...XXXXXXX", ".XXXXXXXXXXX", "XXXXXXXXXXX.", "X.X.X..X...X", "X.X.X.XXX.XX", "..XX.XX.XX.."]
    cal = Calendar(date(2020, 1, 1), 12)
    values = [(p, cal.month(t), 3.0 * t * t + 1) for p in patterns for t, c in enumerate(p) if c == "X"] + [("null", cal.month(t), None if t == 4 else 2.0 * t) for t in range(12)]
    panel = spark.createDataFrame(values, "series_id string, month date, value double")
    want = prep.clean_arrays(panel, ["series_id"], cal, max_gap, keep_all=True).where("kept").drop("kept")
    found = prep.clean_arrays(panel, ["series_id"], cal, max_gap)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "Window" not in plan(found)


def test_lag_features_of_whole_series_have_no_flags(ctx, spark):
    """Flags that are 0 in every row are left out, and the trees are the same without them."""
    slim = trees.panel_vectors(ctx, trees.Variant(categories=True), 1)
    shares = [c for c in slim.columns if c not in X.LAG_COLUMNS]
    assert slim.flagged == shares and len(shares) == 4
    assert slim.rows.first()["features"].size == len(X.LAG_COLUMNS) + 2 * len(shares)
    full = trees.vectors(*trees.feature_table(ctx, trees.Variant(categories=True), 1))
    said = [{r.series_id: r.ratio for r in trees.fit_step(v.rows, 1, 28, QUICK).ratios(v.at(27)).collect()} for v in (slim, full)]
    assert said[0] == said[1] and len(said[0]) == 6


@pytest.mark.parametrize("odd", [None, float("nan"), float("inf")])
def test_one_odd_month_brings_the_flags_back(ctx, spark, odd):
    arrays = spark.createDataFrame([("a", LEVEL), ("b", [odd if t == 9 else y for t, y in enumerate(LEVEL)])], "series_id string, y array<double>")
    holed = replace(ctx, clean=X.cells(arrays), arrays=arrays)
    assert trees.panel_vectors(holed, trees.Variant(), 1).flagged == list(X.LAG_COLUMNS)
    assert trees.flagged_columns(ctx, trees.Variant(), X.LAG_COLUMNS) == []
    assert trees.flagged_columns(ctx, trees.Variant(pretrain=True), X.LAG_COLUMNS) == list(X.LAG_COLUMNS)
    parts = ctx.category_clean.withColumn("y", F.transform("y", lambda v, i: F.when(i != 9, v).otherwise(F.lit(odd).cast("double"))))
    assert trees.flagged_columns(replace(ctx, category_clean=parts), trees.Variant(stack=True), X.LAG_COLUMNS) == list(X.LAG_COLUMNS)


def test_fewer_fits_run_side_by_side_on_more_rows(ctx, monkeypatch):
    table = trees.panel_vectors(ctx, trees.Variant(), 1)  # 150 rows
    widths = []
    real = trees.side_by_side
    monkeypatch.setattr(trees, "side_by_side", lambda spark, tasks, width: widths.append(width) or real(spark, tasks, width))
    for rows in (1000, 450, 10):
        monkeypatch.setattr(trees, "ROWS_AT_ONCE", rows)
        trees.fit_predict(ctx, trees.Variant(), table, [Fold(0, 28, 28, 29)], QUICK)
    assert widths == [4, 3, 1]


def test_stored_models_keep_their_flags_and_share_the_vectors_of_the_origin(ctx, spark, monkeypatch):
    store = modelstore.ModelStore(spark, work_path(spark, "store"))
    monkeypatch.setattr(trees, "flagged_columns", lambda ctx, spec, columns: list(columns))
    modelstore.fit_forward(store, ctx, "panel_trees", [1], QUICK)
    monkeypatch.undo()
    modelstore.fit_forward(store, ctx, "panel_trees", [2], QUICK)
    flags = {r.step: len(json.loads(r.flagged)) for r in store.entries().collect()}
    assert flags == {1: len(X.LAG_COLUMNS), 2: 0}
    calls, real = [], trees.vectors
    monkeypatch.setattr(trees, "vectors", lambda *a: calls.append(a) or real(*a))
    found = {h: {(r.series_id, r.step): r.forecast for r in modelstore.forecast(store, ctx, "panel_trees", h, QUICK).collect()} for h in (1, 2)}
    assert len(calls) == 2  # one for each set of flags, not for each horizon
    direct = trees.fit_predict(ctx, trees.Variant(), trees.panel_vectors(ctx, trees.Variant(), 2), [Fold(0, 30, 30, 32)], QUICK)[0]
    want = {(r.series_id, r.step): r.forecast for r in direct.collect()}
    assert found[2] == want and found[1] == {k: v for k, v in want.items() if k[1] == 1} and len(want) == 12
