from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import backtest, compare, folds as guard, longseries as L, metrics, solvers, two_stage as TS
from panelwright.protocol import Calendar, fold_array, rolling_origin
from panelwright.sources import sinks

CAL = Calendar(date(2020, 1, 1), 36)
PLAN = {3: rolling_origin(36, 3, 3)}


def series(spark, n=4, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(36)
    rows = [(f"s{i}", [float(v) for v in 1000 + 100 * i + 5 * (i + 1) * t + 50 * np.sin(t / 12 * 2 * np.pi) + rng.normal(size=36)]) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, y array<double>"), {k: np.array(v) for k, v in rows}


def test_closed_forms_against_their_definitions(spark):
    df, y = series(spark)
    done = backtest.forecast_series(backtest.fold_rows(df, fold_array(PLAN)), ["naive_last", "seasonal_naive", "drift", "seasonal_drift"])
    for r in done.collect():
        h = y[r["series_id"]][: r["train_end"]]
        n, i = len(h), np.arange(1, 4)
        last_year = np.array([h[-12 + (k - 1) % 12] for k in i])
        k = min(12, n - 12)
        step = (h[-k:].mean() - h[-(12 + k) : -12].mean()) / 12
        want = {"naive_last": np.full(3, h[-1]), "seasonal_naive": last_year, "drift": h[-1] + (h[-1] - h[0]) / (n - 1) * i,
                "seasonal_drift": last_year + step * i}[r["model"]]
        assert r["forecast"] == pytest.approx(want)


def test_row_metrics_against_numpy(spark):
    df, y = series(spark)
    for r in backtest.score_series(df, fold_array(PLAN), ["drift"]).collect():
        h = y[r["series_id"]]
        train, test = h[: r["train_end"]], h[r["train_end"] : r["train_end"] + 3]
        p = train[-1] + (train[-1] - train[0]) / (len(train) - 1) * np.arange(1, 4)
        assert r["mae"] == pytest.approx(np.abs(test - p).mean())
        assert r["r2"] == pytest.approx(1 - ((test - p) ** 2).sum() / ((test - test.mean()) ** 2).sum())
        assert r["mase"] == pytest.approx(np.abs(test - p).mean() / np.abs(np.diff(train)).mean())
        assert r["smape"] == pytest.approx((np.abs(test - p) / ((np.abs(test) + np.abs(p)) / 2)).mean() * 100)
        assert r["y_sq"] == pytest.approx((test**2).sum()) and r["n"] == 3


def test_failed_fit_is_a_row_with_a_reason(spark):
    df, _ = series(spark, 2)
    broken = df.withColumn("y", F.when(F.col("series_id") == "s1", F.transform("y", lambda v, i: F.when(i != 5, v))).otherwise(F.col("y")))
    rows = backtest.score_series(broken, fold_array(PLAN), ["naive_last"]).collect()
    assert {(r["series_id"], r["error"] is not None) for r in rows} == {("s0", False), ("s1", True)}
    summary = metrics.summarise(backtest.score_series(broken, fold_array(PLAN), ["naive_last"])).first()
    assert summary["n_refused"] == 3 and summary["n_series"] == 1


def test_pooled_r2_is_the_pool_over_all_points(spark):
    df, y = series(spark)
    scores = backtest.score_series(df, fold_array(PLAN), ["naive_last"])
    got = metrics.r2_pool(scores, ["model"]).first()["r2_pool"]
    actual = np.concatenate([h[e : e + 3] for h in y.values() for e in (27, 30, 33)])
    predicted = np.concatenate([np.full(3, h[e - 1]) for h in y.values() for e in (27, 30, 33)])
    assert got == pytest.approx(1 - ((actual - predicted) ** 2).sum() / ((actual - actual.mean()) ** 2).sum())


def test_solvers_never_lose_to_a_grid_point_and_follow_a_trend():
    rng = np.random.default_rng(3)
    y = (100 + 2.0 * np.arange(40))[:, None] + rng.normal(size=(40, 5)) * 0.1
    for kind in ("ets_damped", "arima111", "theta", "arima011"):
        out = solvers.solve(kind, y, 3)
        assert out.shape == (3, 5)
        assert np.abs(out[0] - 180).max() < (6 if kind in ("theta", "arima011") else 2), kind
    season = np.tile(np.sin(np.arange(12)), 6)[:, None] + np.zeros((72, 2)) + 10
    for kind in ("ets", "sarima"):
        assert solvers.solve(kind, season, 12) == pytest.approx(season[:12], abs=0.05), kind
    with pytest.raises(ValueError):
        solvers.solve("ets_seasonal", y[:8], 2)


def test_solver_failures_become_reasons(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0, None, 3.0],)], "train array<double>").withColumn("horizon", F.lit(2))
    rows = solvers.forecast_series(df, ("ets_seasonal",)).collect()
    assert all(r["forecast"] is None and r["error"] for r in rows)
    assert any("too few points" in r["error"] for r in rows)


def long_series(spark, months=40, factor=1.0):
    t = np.arange(months)
    values = 100 * np.exp(0.01 * t) * (1 + 0.2 * np.sin(t / 12 * 2 * np.pi))
    rows = [(CAL.month(int(k)), float(v * (factor if k >= 33 else 1))) for k, v in zip(t, values)]
    return spark.createDataFrame(rows, "month date, value double")


def test_future_of_the_aggregate_does_not_matter(spark):
    df, _ = series(spark)
    plan = {3: PLAN[3][-1:]}  # origin at month 33

    def run(agg):
        paths = TS.aggregate_paths(agg, CAL, plan)
        done = TS.two_stage(df, plan, paths, TS.aggregate_array(L.cut_at(agg, F.lit(CAL.month(32))), CAL))
        return {r["series_id"]: r["forecast"] for r in done.select("series_id", "forecast").collect()}

    clean, spoiled = run(long_series(spark)), run(long_series(spark, factor=1000.0))
    assert clean == spoiled and all(len(v) == 3 for v in clean.values())


def test_known_aggregate_reads_the_future_and_fails_without_it(spark):
    df, _ = series(spark)
    plan = {3: PLAN[3][-1:]}
    agg = long_series(spark, 36)
    full = TS.two_stage(df, plan, TS.known_paths(agg, CAL, plan), TS.aggregate_array(agg, CAL)).collect()
    assert all(r["forecast"] is not None for r in full)
    short = agg.where(F.col("month") < F.lit(CAL.month(35)))
    rows = TS.two_stage(df, plan, TS.known_paths(short, CAL, plan), TS.aggregate_array(short, CAL)).collect()
    assert all(r["forecast"] is None and "not known" in r["error"] for r in rows)


def test_loo_gain_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=12), rng.normal(size=12)
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)] + [("b", 1.0, 2.0)] * 4, "k string, x double, y double")
    got = {r["k"]: r["gain"] for r in TS.loo_gains(df, ["k"], "x", "y").collect()}
    errors = []
    for i in range(12):
        m = np.arange(12) != i
        slope, intercept = np.polyfit(x[m], y[m], 1)
        errors.append((y[i] - intercept - slope * x[i]) ** 2)
    assert got["a"] == pytest.approx((y**2).mean() - np.mean(errors))
    assert got["b"] == float("-inf")


def test_guards(spark):
    df, _ = series(spark)
    stored = backtest.score_series(df, fold_array(PLAN), ["drift"])
    guard.check_same_panel(stored, stored)
    with pytest.raises(ValueError, match="only stored"):
        guard.check_same_panel(stored, stored.where("series_id <> 's0'"))
    with pytest.raises(ValueError, match="other folds"):
        guard.check_same_panel(stored, stored.where("fold <> 2"))
    with pytest.raises(ValueError, match="empty"):
        guard.check_same_panel(stored, stored.where("false"))


def test_upsert_and_archive(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("b", 3, 3.0)], "model string, horizon int, mae double")
    fresh = spark.createDataFrame([("a", 1, 9.0)], "model string, horizon int, mae double")
    cleared = spark.createDataFrame([("b", 3)], "model string, horizon int")
    merged = sinks.upsert(old, fresh, ["model", "horizon"], explicit=cleared)
    assert sorted(map(tuple, merged.collect())) == [("a", 1, 9.0), ("b", 1, 2.0)]
    target = sinks.archive_replaced(old, fresh, ["model", "horizon"], str(tmp_path / "a"), stamp="x")
    assert [r["mae"] for r in spark.read.parquet(target).collect()] == [1.0]
    with pytest.raises(Exception):
        sinks.archive_replaced(old, fresh, ["model", "horizon"], str(tmp_path / "a"), stamp="x")
    check = sinks.write_and_verify(old, str(tmp_path / "s")).first()
    assert tuple(check) == (0, 0, 3, 3)


def test_paired_interval(spark):
    rows = [("a", 3, f, s, float(f + len(s)), None) for f in range(3) for s in ("x", "yy")]
    rows += [("b", 3, f, s, float(f + len(s)) - 0.5 * (f + 1), None) for f in range(3) for s in ("x", "yy")]
    df = spark.createDataFrame(rows, "model string, horizon int, fold int, series_id string, mae double, error string")
    r = compare.paired_vs_reference(df, "a").first()
    assert r["diff_mean"] == pytest.approx(-1.0) and r["folds_won"] == 3 and r["pairs_won_share"] == 1.0
    assert r["fold_ci_high"] - r["fold_diff_mean"] == pytest.approx(4.302652729749464 * 0.5 / np.sqrt(3))


def test_decomposition_makes_its_series_once(spark, sf, monkeypatch):
    from panelwright.plans import backtest_queries as Q, inputs as I
    from panelwright.session import shared_tables

    built, arrays = [], I.category_arrays
    monkeypatch.setattr(I, "category_arrays", lambda *a, **k: built.append(1) or arrays(*a, **k))
    with shared_tables():
        found = Q.decomposition(spark, sf)
    plan = found._jdf.queryExecution().toString()
    assert len(built) == 1 and "lineitem" not in plan
    assert found.count() > 0
