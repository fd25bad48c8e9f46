import dataclasses
import itertools
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import cpbench as B, detectors as D, realtime as R
from panelwright.protocol import BenchConfig, Calendar

CAL = Calendar(date(2023, 1, 1), 24)


def panel(spark, n=6, shift=1.3, at=14, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = (1000 + 200 * i) * (1 + 0.01 * rng.normal(size=24))
        y[at:] *= shift
        rows.append((f"s{i}", i, [float(v) for v in y]))
    return spark.createDataFrame(rows, "series_id string, ordinal int, y array<double>"), rows


def brute(cost, pen, n):
    best = None
    for k in range(n // 3):
        for cut in itertools.combinations(range(3, n - 2), k):
            ends = [0, *cut, n]
            if min(b - a for a, b in zip(ends, ends[1:])) < 3:
                continue
            value = sum(cost[a, b] for a, b in zip(ends, ends[1:])) + pen * k
            if best is None or value < best[0] - 1e-12:
                best = (value, cut)
    return best[1]


@pytest.mark.parametrize("detector", ["pelt", "kernel_rbf"])
def test_exact_partition_is_optimal(detector):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4, 12))
    z[1, 6:] += 4
    cost = D._l2_cost(z) if detector == "pelt" else D._rbf_cost(z)
    for pen in (0.3, 1.0, 3.0):
        mask = D.breaks(detector, z, [pen])
        for b in range(4):
            assert tuple(np.flatnonzero(mask[b, 0])) == brute(cost[b], pen * z[b].var() if detector == "pelt" else pen, 12)


@pytest.mark.parametrize("detector", list(D.SEGMENTERS))
def test_every_detector_finds_a_planted_break(detector):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(3, 40)) * 0.1
    z[:, 20:] += 5
    mask = D.breaks(detector, z, [1.0])
    assert all(20 in np.flatnonzero(mask[b, 0]) for b in range(3))


def test_flags_take_a_fraction_of_a_run_per_window_and_penalty():
    import time

    z = np.random.default_rng(8).normal(size=(32, 79))
    grid = [0.001 * 1e5 ** (i / 59) for i in range(60)]
    for detector, penalties in [(d, grid[::10]) for d in D.SEGMENTERS] + [("kernel_rbf", grid)]:
        began = time.process_time()
        got = D.flags(detector, z, penalties, 0)
        took = time.process_time() - began
        began = time.process_time()
        for t in (30, 60, 78):
            mask = D.breaks(detector, z[:, : t + 1], penalties)
            assert (got[:, :, t] == mask[:, :, t - D.RECENT :].any(2)).all(), (detector, t)
        # 71 windows cost less than 20 runs of the detector on long prefixes
        assert took < 20 / 3 * (time.process_time() - began) + 0.05, (detector, took)


def test_breaks_near_the_ends_of_a_growing_series():
    z = np.random.default_rng(10).normal(size=60)
    z[25:] += 2
    sizes = list(range(6, 61))
    first = [max(s - 1 - k % 6, 0) for k, s in enumerate(sizes)]
    for detector in D.SEGMENTERS:
        got = D.breaks_near_ends(detector, z, 1.0, sizes, first)
        assert got == [bool(D.breaks(detector, z[None, :s], [1.0])[0, 0, k:].any()) for s, k in zip(sizes, first)], detector
        assert detector != "pelt" or any(got)


def test_first_flags_are_the_first_of_all_flags(spark):
    rng = np.random.default_rng(9)
    y = rng.normal(10.0, 1.0, size=(40, 30))
    y[::2, 14:] += 4
    df = spark.createDataFrame([(i, [float(v) for v in row], i % 2 == 0) for i, row in enumerate(y)] + [(40, [1.0] * 4, True), (41, None, False)], "i int, z array<double>, first boolean")
    for detector in D.SEGMENTERS:
        every, some = (D.flag_column(F.col("z"), F.lit(0), detector, [0.5, 1.0, 3.0], first) for first in (False, F.col("first")))
        rows = df.select("i", "first", every.alias("a"), some.alias("b")).collect()
        assert len(rows) == 42 and all(r.a is None and r.b is None for r in rows if r.i >= 40)
        for r in rows[:40]:
            assert r.b == ([m[:1] for m in r.a] if r.first else r.a), (detector, r.i)


def test_flags_are_the_detector_on_every_prefix():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(2, 22))
    z[:, 12:] += 3
    for detector in D.SEGMENTERS:
        got = D.flags(detector, z, [0.5, 2.0], 1)
        for t in range(D.MIN_HISTORY, 23):
            mask = D.breaks(detector, z[:, :t], [0.5, 2.0])
            want = mask[:, :, max(t - D.RECENT - 1, 0) :].any(2)
            assert (got[:, :, t] == want).all(), (detector, t)


def cusum_by_hand(y):
    base = y[:6]
    mu = np.median(base)
    mad = np.median(np.abs(base - mu))
    sigma = 1.4826 * mad if mad > 0 else (np.std(base) or 1.0)
    pos = neg = 0.0
    for i in range(6, len(y)):
        pos, neg = max(0, pos + y[i] - mu - 0.5 * sigma), min(0, neg + y[i] - mu + 0.5 * sigma)
        if pos > 5 * sigma or -neg > 5 * sigma:
            return i
    return None


def test_cusum_matches_its_definition(spark):
    rng = np.random.default_rng(7)
    data = [[float(v) for v in rng.normal(size=n) + np.r_[np.zeros(n // 2), np.full(n - n // 2, s)]] for n in (7, 8, 20) for s in (0, 2, 6)]
    data.append([1.0] * 12)
    rows = spark.createDataFrame([(i, y) for i, y in enumerate(data)], "i int, y array<double>").select("i", D.cusum(F.col("y")).alias("a")).collect()
    for r in rows:
        y = np.array(data[r["i"]])
        assert r["a"] == (cusum_by_hand(y) if len(y) >= 8 else None)


def test_preparation_is_causal(spark):
    df, rows = panel(spark)
    for mode in D.PREPARE:
        whole = df.select("series_id", D.prepare(F.col("y"), mode).alias("z"))
        short = df.select("series_id", D.prepare(F.slice("y", 1, 15), mode).alias("s"))
        for r in whole.join(short, "series_id").collect():
            assert r["z"][: len(r["s"])] == pytest.approx(r["s"])
    with pytest.raises(KeyError):
        D.prepare(F.col("y"), "nothing")


def test_bench_scoring_rules(spark):
    config = dataclasses.replace(BenchConfig(), detectors=("cusum",), modes=("raw",), positions=(14,), kinds=("level",), magnitudes=(4.0,))
    rows = [
        ("on time", [], [16]), ("late", [], [20]), ("early", [], [9]), ("twin", [16], [16]), ("silent", [], []),
    ]
    flat = []
    for name, twin, own in rows:
        flat.append((name, "none", 0.0, None, "raw", "cusum", None, None, twin, 0))
        flat.append((name, "level", 4.0, 14, "raw", "cusum", None, None, own, 0))
    df = spark.createDataFrame(flat, "series_id string, kind string, magnitude double, position int, mode string, detector string, "
                                     "penalty double, penalty_effective double, months array<int>, n_failed int")
    bench = B.score(df, config.max_delay, config.twin_rule)
    got = {r["series_id"]: r for r in bench.where("kind <> 'none'").collect()}
    assert got["on time"]["detected"] and got["on time"]["delay"] == 2
    assert got["late"]["late"] and not got["late"]["detected"]
    assert got["early"]["false_alarm"] and not got["early"]["detected"]
    assert got["twin"]["twin_flag_at_signal"] and not got["twin"]["detected"]
    assert not got["silent"]["detected"] and got["silent"]["signal"] is None
    s = B.summarise(bench).first()
    assert s["penalty"] is None and s["detected_pct"] == 20.0 and s["clean_alarms_pct"] == 20.0
    assert s["n_late"] == 1 and s["n_twin_vetoed"] == 1 and s["youden_j"] == 0.0


def test_variance_noise_is_shared_and_standard(spark):
    df = spark.range(4000).select(B.noise(1, F.lit(0), F.lit(8), F.col("id")).alias("a"), B.noise(1, F.lit(0), F.lit(8), F.col("id")).alias("b"))
    r = df.agg(F.avg("a").alias("m"), F.stddev("a").alias("s"), F.max(F.abs(F.col("a") - F.col("b"))).alias("d")).first()
    assert abs(r["m"]) < 0.06 and abs(r["s"] - 1) < 0.05 and r["d"] == 0


def test_hysteresis_and_event_windows(spark):
    df = spark.createDataFrame([("a", [8, 9, 12, 16, 17]), ("b", [14]), ("c", [])], "series_id string, months array<int>").withColumn("n_failed", F.lit(0))
    assert {(r["series_id"], r["t"]) for r in R.episode_rows(df).collect()} == {("a", 8), ("a", 16), ("b", 14)}
    monthly = R.monthly_shares(df, CAL)
    assert monthly.count() == 24
    got = {r["event"]: r for r in R.event_table(df, monthly, [8, 13], CAL, threshold=30.0).collect()}
    assert got[date(2023, 9, 1)]["crossed_month"] == date(2023, 9, 1)
    assert got[date(2024, 2, 1)]["delay"] == 1 and got[date(2024, 2, 1)]["share_in_window"] == pytest.approx(200 / 3)
    with pytest.raises(ValueError):
        R.event_table(df, monthly, [30], CAL, 1.0)
    with pytest.raises(ValueError):
        R.rank_view(monthly, [3])


def test_common_shift_is_the_consensus_month(spark):
    df, _ = panel(spark)
    breaks = R.offline_breaks(df, "pelt", "ratio", [1.0], CAL)
    top = R.consensus_months(R.offline_shares(breaks, df, CAL), 1).first()
    assert top["t"] in (14, 15)
    low, high = R.allowed_range(24, "ratio")
    assert R.window_checks(breaks, 24, "ratio").first()["n_outside"] == 0 and (low, high) == (4, 21)
    with pytest.raises(ValueError):
        R.check_window(breaks, 24, "ratio")


def test_unknown_kernel_penalty_is_refused(spark):
    df, _ = panel(spark, 2)
    with pytest.raises(ValueError):
        B.flag_sets(B.prepared(df.select("series_id", "y"), ["raw"]), ["kernel_rbf"], [1.0])


def test_kernel_partitions_only_what_can_have_a_break_near_the_end(monkeypatch):
    """Where no cut near the end gains the penalty, no partition is asked for; elsewhere flags are those of every prefix."""
    draw = np.random.default_rng(5)
    z = np.concatenate([draw.normal(size=(4, 30)), np.r_[np.zeros(15), np.full(15, 9.0)] + draw.normal(size=(4, 30)) / 9])
    asked, columns = [], D._kernel_columns
    monkeypatch.setattr(D, "_kernel_columns", lambda gram, size: asked.append(gram.shape[1]) or columns(gram, size))
    found = D.flags("kernel_rbf", z, [2.5, 3.5], 0)
    assert sum(asked) < len(z) * (30 - D.MIN_HISTORY) / 3
    monkeypatch.undo()
    for t in range(D.MIN_HISTORY, 30):
        near = D.breaks("kernel_rbf", z[:, : t + 1], [2.5, 3.5])[:, :, t - D.RECENT :].any(2)
        assert (found[:, :, t] == near).all()
    assert found.any()


def test_flags_are_dealt_out_by_number(spark, sf):
    from panelwright.plans import break_queries as Q

    plan = Q.flag_months_all(spark, sf)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan or "RepartitionByExpression" in plan
