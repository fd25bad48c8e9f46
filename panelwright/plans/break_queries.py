"""Registered queries: change points, bench and live signals."""
from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from panelwright.operators import cpbench as B, detectors as D, realtime as R
from panelwright.plans import inputs as I, oracle as O
from panelwright.plans.oracle import r
from panelwright.plans.registry import query
from panelwright.plans.rounding import rounded
from panelwright.protocol import BenchConfig
from panelwright.session import cut_lineage

FULL = BenchConfig()
# every series, the detector and the disturbances that SQL can follow
CUSUM = dataclasses.replace(FULL, detectors=("cusum",), kinds=("level", "trend"))


def _series(spark, sf):
    return I.total_arrays(spark, sf).select("series_id", "y")


def _ordinals(spark, sf):
    return _series(spark, sf).withColumn("ordinal", F.lit(0))


# --- the SQL side -----------------------------------------------------------------------

CURVES = O.TOTAL_CLEAN + """,
sig AS (SELECT series_id, CASE WHEN stddev_pop(d) > 0 THEN stddev_pop(d) ELSE 1.0 END AS sigma FROM (
  SELECT series_id, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS d FROM clean) WHERE d IS NOT NULL GROUP BY 1),
inj(kind, magnitude, position) AS (
  SELECT k, m, p FROM (VALUES ('level'), ('trend')) a(k), (VALUES (1.0::DOUBLE), (2.0), (4.0)) b(m), (VALUES (8), (14), (17), (20)) c(p)
  UNION ALL SELECT 'none', 0.0, NULL),
curve AS (
  SELECT series_id, kind, magnitude, position, t,
         CASE WHEN kind = 'none' OR t < position THEN y WHEN kind = 'level' THEN y + sigma * magnitude
              ELSE y + sigma * magnitude * (t - position) / greatest(79 - position - 1, 1) * 3.0 END AS y
  FROM clean JOIN sig USING (series_id) CROSS JOIN inj)"""
ZED = """,
zed AS (
  SELECT series_id, kind, magnitude, position, 'raw' AS mode, 0 AS off, t, y AS z FROM curve
  UNION ALL
  SELECT series_id, kind, magnitude, position, 'ratio', 1, t - 1, coalesce((y - p) / nullif(p, 0), 0) FROM (
    SELECT *, lag(y) OVER (PARTITION BY series_id, kind, magnitude, position ORDER BY t) AS p FROM curve) WHERE t >= 1
  UNION ALL
  SELECT series_id, kind, magnitude, position, 'deseason', 0, t,
         y - coalesce(avg(y) OVER (PARTITION BY series_id, kind, magnitude, position, t % 12 ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      avg(y) OVER (PARTITION BY series_id, kind, magnitude, position ORDER BY t ROWS UNBOUNDED PRECEDING)) FROM curve),
cids AS (SELECT row_number() OVER () AS cid, * FROM (SELECT DISTINCT series_id, kind, magnitude, position, mode, off FROM zed)),
zz AS (SELECT cid, t, z FROM zed JOIN cids ON zed.series_id = cids.series_id AND zed.kind = cids.kind AND zed.magnitude = cids.magnitude
  AND zed.position IS NOT DISTINCT FROM cids.position AND zed.mode = cids.mode),
mu AS (SELECT cid, median(z) AS mu, stddev_pop(z) AS sd FROM zz WHERE t < 6 GROUP BY 1),
sc AS (SELECT cid, mu, CASE WHEN mad > 0 THEN 1.4826 * mad WHEN sd > 0 THEN sd ELSE 1.0 END AS sigma
  FROM (SELECT mu.cid, any_value(mu) AS mu, any_value(sd) AS sd, median(abs(z - mu)) AS mad FROM mu JOIN zz ON zz.cid = mu.cid AND t < 6 GROUP BY 1)),
run AS (
  SELECT cid, 5 AS t, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS neg FROM sc
  UNION ALL
  SELECT run.cid, run.t + 1, greatest(0.0, pos + (z - mu) - 0.5 * sigma), least(0.0, neg + (z - mu) + 0.5 * sigma)
  FROM run JOIN zz ON zz.cid = run.cid AND zz.t = run.t + 1 JOIN sc ON sc.cid = run.cid),
alarm AS (SELECT run.cid, min(run.t) AS a FROM run JOIN sc ON sc.cid = run.cid WHERE run.t >= 6 AND (pos > 5 * sigma OR -neg > 5 * sigma) GROUP BY 1),
flags AS (
  SELECT cids.*, CAST(t AS INTEGER) AS t FROM alarm JOIN cids USING (cid) CROSS JOIN range(8, 79) AS g(t)
  WHERE t >= greatest(8, 7 + off, a + off) AND t <= a + off + 3)"""
ONE = CURVES.replace("UNION ALL SELECT 'none', 0.0, NULL", "UNION ALL SELECT 'none', 0.0, NULL")
BENCH = CURVES + ZED + """,
sig1 AS (SELECT cid, min(t) AS signal FROM flags GROUP BY 1),
tw AS (SELECT series_id, mode, t FROM flags WHERE kind = 'none'),
b0 AS (SELECT cids.*, signal, EXISTS (SELECT 1 FROM tw WHERE tw.series_id = cids.series_id AND tw.mode = cids.mode AND tw.t = signal) AS twin FROM cids LEFT JOIN sig1 USING (cid)),
bench AS (
  SELECT 'cusum' AS detector, mode, kind, magnitude, position, series_id, CAST(signal AS INTEGER) AS signal,
         CASE WHEN kind = 'none' THEN FALSE ELSE coalesce(signal >= position AND signal - position <= 3 AND NOT twin, FALSE) END AS detected,
         CASE WHEN kind <> 'none' AND signal >= position AND signal - position <= 3 AND NOT twin THEN CAST(signal - position AS INTEGER) END AS delay,
         CASE WHEN kind = 'none' THEN signal IS NOT NULL ELSE coalesce(signal < position, FALSE) END AS false_alarm,
         kind <> 'none' AND coalesce(twin AND signal IS NOT NULL, FALSE) AS twin_flag_at_signal,
         kind <> 'none' AND coalesce(signal >= position AND signal - position > 3, FALSE) AS late
  FROM b0)"""


def with_sql(ctes, select):
    return f"WITH RECURSIVE {ctes}\n{select}"


# only the untouched curves, for the live panel
CLEANONLY = CURVES.replace("SELECT k, m, p FROM (VALUES ('level'), ('trend')) a(k), (VALUES (1.0::DOUBLE), (2.0), (4.0)) b(m), (VALUES (8), (14), (17), (20)) c(p)\n  UNION ALL SELECT 'none', 0.0, NULL", "SELECT 'none', 0.0::DOUBLE, CAST(NULL AS INTEGER)") + ZED


# --- preparation ------------------------------------------------------------------------

for _id, _mode in (("cp_1", "raw"), ("cp_2", "ratio"), ("cp_3", "deseason")):
    query(f"{_id}_preprocess_{_mode}", with_sql(CLEANONLY, f"SELECT series_id, CAST(t AS INTEGER) AS t, {r('z')} AS z FROM zed WHERE mode = '{_mode}'"))(
        lambda spark, sf, m=_mode: rounded(
            _series(spark, sf).select("series_id", F.posexplode(D.prepare(F.col("y"), m)).alias("t", "z"))))


# --- detectors on the whole series --------------------------------------------------------

for _id, _name in (("cp_4", "pelt"), ("cp_5", "binseg"), ("cp_6", "window"), ("cp_7", "bottomup"), ("cp_8", "kernel_rbf")):
    query(f"{_id}_detect_{_name}")(
        lambda spark, sf, d=_name: R.offline_breaks(_series(spark, sf), d, "ratio", FULL.penalties, I.CALENDAR))


@query("cp_6_window_discrepancy", with_sql(CLEANONLY, f"""
SELECT a.series_id, CAST(a.t AS INTEGER) AS t, {r('3 * (pow(l - m, 2) + pow(h - m, 2))')} AS discrepancy FROM (
  SELECT series_id, t, avg(z) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l, avg(z) OVER (w ROWS BETWEEN 0 PRECEDING AND 2 FOLLOWING) AS h,
         avg(z) OVER (w ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS m, count(*) OVER (w ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS k
  FROM zed WHERE mode = 'ratio' WINDOW w AS (PARTITION BY series_id ORDER BY t)) a WHERE k = 6"""))
def discrepancy(spark, sf):
    """The curve behind the window detector: cost of two half windows against one."""
    from pyspark.sql import Window

    z = _series(spark, sf).select("series_id", F.posexplode(D.prepare(F.col("y"), "ratio")).alias("t", "z"))
    w = Window.partitionBy("series_id").orderBy("t")
    low, high, both = (w.rowsBetween(a, b) for a, b in ((-3, -1), (0, 2), (-3, 2)))
    rows = z.withColumns({"l": F.avg("z").over(low), "h": F.avg("z").over(high), "m": F.avg("z").over(both), "k": F.count("z").over(both)})
    value = 3 * (F.pow(F.col("l") - F.col("m"), 2) + F.pow(F.col("h") - F.col("m"), 2))
    return rounded(rows.where(F.col("k") == 6).select("series_id", "t", value.alias("discrepancy")))


@query("cp_9_detect_cusum", with_sql(CLEANONLY, "SELECT series_id, mode, CAST(a AS INTEGER) AS alarm FROM cids LEFT JOIN alarm USING (cid)"))
def cusum(spark, sf):
    rows = B.prepared(_series(spark, sf), FULL.modes)
    return rows.select("series_id", "mode", D.cusum(F.col("z")).alias("alarm"))


@query("cp_10_inject", with_sql(CURVES, f"SELECT series_id, kind, {r('magnitude', 1)} AS magnitude, position, CAST(t AS INTEGER) AS t, {r('y')} AS y FROM curve"))
def inject(spark, sf):
    out = B.curves(_ordinals(spark, sf), CUSUM)
    return rounded(out.select("series_id", "kind", "magnitude", "position", F.posexplode("y").alias("t", "y")))


@query("cp_10_inject_variance")
def inject_variance(spark, sf):
    out = B.curves(_ordinals(spark, sf), dataclasses.replace(FULL, kinds=("variance",)))
    return out.select("series_id", "kind", "magnitude", "position", F.posexplode("y").alias("t", "y"))


@query("cp_11_flag_months", with_sql(CLEANONLY, "SELECT series_id, mode, t FROM flags"))
def flag_months(spark, sf):
    flagged = B.flag_sets(B.prepared(_series(spark, sf), FULL.modes), ["cusum"], [])
    return flagged.select("series_id", "mode", F.explode("months").alias("t"))


@query("cp_11_flag_months_all_detectors")
def flag_months_all(spark, sf):
    grid = kernel_grid(calibration(spark, sf).collect())  # one row for each penalty
    # few bytes and much work in a series: dealt out by number, not by size
    rows = B.prepared(_series(spark, sf).repartition(_partitions(spark), "series_id"), FULL.modes)
    flagged = B.flag_sets(rows, FULL.detectors, FULL.penalties, grid)
    return flagged.select("series_id", "mode", "detector", "penalty", F.explode("months").alias("t"))


@query("cp_12_streaming_signal", with_sql(CLEANONLY, "SELECT cids.series_id, cids.mode, min(t) AS signal FROM cids LEFT JOIN flags USING (cid) GROUP BY 1, 2"))
def streaming_signal(spark, sf):
    flagged = B.flag_sets(B.prepared(_series(spark, sf), FULL.modes), ["cusum"], [])
    return flagged.select("series_id", "mode", F.get("months", F.lit(0)).alias("signal"))


#: The kernel penalty is calibrated once, in the live mode, and holds for all modes.
LIVE_MODE = "ratio"


def _partitions(spark):
    return spark.sparkContext.defaultParallelism * 2


def calibration(spark, sf):
    clean = B.prepared(_ordinals(spark, sf), (LIVE_MODE,)).repartition(_partitions(spark), "series_id", "mode")
    return B.calibrate_kernel(clean, FULL.penalties, FULL.kernel_grid)


def kernel_grid(rows):
    """``mode -> raw penalties`` in grid order, from the few calibration rows: the same for every mode."""
    found = {x["penalty"]: x["kernel_pen"] for x in rows}
    return {m: [found[p] for p in FULL.penalties] for m in FULL.modes}


@query("cp_13_calibrate_kernel_penalty")
def calibrate(spark, sf):
    return calibration(spark, sf)


@query("cp_14_effective_penalty")
def effective(spark, sf):
    modes = spark.createDataFrame([(m,) for m in FULL.modes], "mode string")
    chosen = F.broadcast(modes).crossJoin(calibration(spark, sf).select("penalty", "kernel_pen"))  # modes times penalties
    plain = [F.struct(F.lit(d).alias("detector"), F.lit(p).alias("penalty")) for d in FULL.detectors if d not in ("cusum", "kernel_rbf") for p in FULL.penalties]
    others = modes.select("mode", F.inline(F.array(*plain))).withColumn("penalty_effective", F.col("penalty"))
    own = modes.select("mode", F.lit("cusum").alias("detector"), F.lit(None).cast("double").alias("penalty"), F.lit(None).cast("double").alias("penalty_effective"))
    kernel = chosen.select("mode", F.lit("kernel_rbf").alias("detector"), "penalty", F.col("kernel_pen").alias("penalty_effective"))
    return others.unionByName(own).unionByName(kernel)


# --- bench --------------------------------------------------------------------------------

BENCH_COLUMNS = f"detector, mode, kind, {r('magnitude', 1)} AS magnitude, position, series_id, signal, detected, delay, false_alarm, twin_flag_at_signal, late"


def cusum_bench(spark, sf):
    return B.run_bench(_ordinals(spark, sf), CUSUM)


@query("cp_15_run_bench", with_sql(BENCH, f"SELECT {BENCH_COLUMNS} FROM bench"))
def run_bench(spark, sf):
    return rounded(cusum_bench(spark, sf).drop("penalty", "penalty_effective", "n_failed"))


def full_bench(spark, sf):
    grid = kernel_grid(calibration(spark, sf).collect())  # one row for each penalty
    return B.run_bench(_ordinals(spark, sf), FULL, grid, partitions=_partitions(spark))


@query("cp_15_run_bench_all_detectors")
def run_bench_all(spark, sf):
    return B.summarise(full_bench(spark, sf))


def bench_summary(by: str = "") -> str:
    k = "detector, mode" + (f", {by}" if by else "")
    return f"""
sp AS (
  SELECT {k}, avg(CASE WHEN detected THEN 100.0 ELSE 0 END) AS detected_pct, quantile_cont(delay, 0.5) AS delay_median, avg(delay) AS delay_mean,
         avg(CASE WHEN detected THEN CASE WHEN delay = 0 THEN 100.0 ELSE 0 END END) AS zero_delay_pct, count(*) AS n_spoiled,
         count(*) FILTER (WHERE late) AS n_late, count(*) FILTER (WHERE signal >= position AND NOT late AND NOT detected) AS n_twin_vetoed
  FROM bench WHERE kind <> 'none' GROUP BY {k}),
cl AS (SELECT detector, mode, avg(CASE WHEN false_alarm THEN 100.0 ELSE 0 END) AS clean_alarms_pct, count(*) AS n_clean FROM bench WHERE kind = 'none' GROUP BY 1, 2),
summ AS (SELECT sp.*, clean_alarms_pct, n_clean, detected_pct - clean_alarms_pct AS youden_j FROM sp JOIN cl USING (detector, mode))"""


SUMMARY = f"""{r('detected_pct')} AS detected_pct, {r('delay_median')} AS delay_median, {r('delay_mean')} AS delay_mean, {r('zero_delay_pct')} AS zero_delay_pct,
  n_spoiled, n_late, n_twin_vetoed, {r('clean_alarms_pct')} AS clean_alarms_pct, n_clean, {r('youden_j')} AS youden_j"""


@query("cp_16_summarise_bench", with_sql(BENCH + "," + bench_summary(), f"SELECT detector, mode, {SUMMARY} FROM summ"))
def summarise(spark, sf):
    return rounded(B.summarise(cusum_bench(spark, sf)).drop("penalty", "n_failed"))


@query("cp_17_by_magnitude", with_sql(BENCH + "," + bench_summary("magnitude"), f"SELECT detector, mode, {r('magnitude', 1)} AS magnitude, {SUMMARY} FROM summ"))
def by_magnitude(spark, sf):
    return rounded(B.summarise(cusum_bench(spark, sf), ["magnitude"]).drop("penalty", "n_failed"))


@query("cp_17_by_position", with_sql(BENCH + "," + bench_summary("position"), f"SELECT detector, mode, position, {SUMMARY} FROM summ"))
def by_position(spark, sf):
    return rounded(B.summarise(cusum_bench(spark, sf), ["position"]).drop("penalty", "n_failed"))


@query("cp_18_select_penalty")
def select_penalty(spark, sf):
    return B.select_penalty(B.summarise(full_bench(spark, sf)))


TURN = dataclasses.replace(CUSUM, positions=(8, 11, 12, 20))


@query("cp_19_warnings", with_sql(BENCH.replace("(8), (14), (17), (20)", "(8), (11), (12), (20)"), """
SELECT 'injection in December or January' AS warning, CAST(position AS VARCHAR) AS "where", count(*) AS n FROM bench
WHERE kind <> 'none' AND position % 12 IN (11, 0) GROUP BY 2"""))
def warnings(spark, sf):
    # four summaries read the bench: its detectors run once
    bench = cut_lineage(B.run_bench(_ordinals(spark, sf), TURN).drop("series_id", "twin_flag_at_signal", "penalty_effective"), "bench")
    return B.warnings(bench, B.select_penalty(B.summarise(bench)), None, FULL.penalties)


# --- breaks of the whole series -----------------------------------------------------------

OFF = CLEANONLY + """,
br AS (SELECT series_id, CAST(a + off AS INTEGER) AS t FROM alarm JOIN cids USING (cid) WHERE mode = 'ratio'),
ns AS (SELECT count(DISTINCT series_id) AS n FROM clean),
osh AS (SELECT CAST(g.t AS INTEGER) AS t, count(br.series_id) AS n_breaks, count(br.series_id) * 100.0 / any_value(n) AS share
  FROM ns CROSS JOIN range(0, 79) AS g(t) LEFT JOIN br ON br.t = g.t GROUP BY 1)"""


def cusum_breaks(spark, sf):
    return R.offline_breaks(_series(spark, sf), "cusum", "ratio", [], I.CALENDAR)


@query("fwd_10_document_breaks", with_sql(OFF, """SELECT c.series_id, string_agg(strftime(CAST(DATE '1995-01-01' + to_months(br.t) AS DATE), '%Y-%m'), ',' ORDER BY br.t) AS breaks
FROM (SELECT DISTINCT series_id FROM clean) c LEFT JOIN br USING (series_id) GROUP BY 1"""))
def document_breaks(spark, sf):
    """The breaks that stand in the series documents; NULL for a series without one."""
    from panelwright.plans.factor_queries import _documents

    return _documents(spark, sf).select("series_id", F.array_join("breaks", ",").alias("breaks"))


@query("cp_20_offline_breaks", with_sql(OFF, "SELECT series_id, t, CAST(DATE '1995-01-01' + to_months(t) AS DATE) AS month FROM br"))
def offline(spark, sf):
    return cusum_breaks(spark, sf).drop("penalty")


@query("cp_20_offline_breaks_pelt")
def offline_pelt(spark, sf):
    return R.offline_breaks(_series(spark, sf), "pelt", "ratio", FULL.penalties, I.CALENDAR)


@query("cp_21_offline_shares", with_sql(OFF, f"SELECT t, n_breaks, {r('share')} AS share FROM osh"))
def offline_shares(spark, sf):
    out = R.offline_shares(cusum_breaks(spark, sf), _series(spark, sf), I.CALENDAR)
    return rounded(out.select("t", "n_breaks", "share"))


LIVE = CLEANONLY + """,
fl AS (SELECT series_id, t, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) AS gap FROM flags WHERE mode = 'raw'),
ep AS (SELECT series_id, t FROM fl WHERE gap IS NULL OR gap > 3),
ns AS (SELECT count(DISTINCT series_id) AS n FROM clean),
mon AS (SELECT CAST(g.t AS INTEGER) AS t, count(ep.series_id) AS n_signals, any_value(n) AS n_series, count(ep.series_id) * 100.0 / any_value(n) AS share
  FROM ns CROSS JOIN range(0, 79) AS g(t) LEFT JOIN ep ON ep.t = g.t GROUP BY 1)"""
EVENTS = (9, 12, 21)


def live_flags(spark, sf):
    return R.panel_flags(_series(spark, sf), "cusum", "raw", None)


@query("cp_22_realtime_signals", with_sql(LIVE, "SELECT series_id, t FROM ep"))
def realtime_signals(spark, sf):
    return R.episode_rows(live_flags(spark, sf))


@query("cp_22_realtime_signals_pelt")
def realtime_pelt(spark, sf):
    return R.episode_rows(R.panel_flags(_series(spark, sf), "pelt", "ratio", 1.0))


@query("cp_23_panel_realtime", with_sql(LIVE, f"SELECT t, CAST(DATE '1995-01-01' + to_months(t) AS DATE) AS month, {r('share')} AS share, n_signals, n_series FROM mon"))
def panel_realtime(spark, sf):
    return rounded(R.monthly_shares(live_flags(spark, sf), I.CALENDAR))


@query("cp_24_realtime_events", with_sql(LIVE, f"""
SELECT CAST(DATE '1995-01-01' + to_months(a) AS DATE) AS event, CAST(DATE '1995-01-01' + to_months(min(CASE WHEN share >= 3 THEN t END)) AS DATE) AS crossed_month,
       CAST(min(CASE WHEN share >= 3 THEN t END) - a AS INTEGER) AS delay, {r('max(share)')} AS max_share,
       {r('(SELECT count(DISTINCT series_id) FROM ep WHERE ep.t >= a AND ep.t < z) * 100.0 / any_value(n_series)')} AS share_in_window
FROM (VALUES (9, 12), (12, 21), (21, 79)) AS w(a, z) JOIN mon ON t >= a AND t < z GROUP BY a, z"""))
def realtime_events(spark, sf):
    flagged = live_flags(spark, sf)
    return rounded(R.event_table(flagged, R.monthly_shares(flagged, I.CALENDAR), EVENTS, I.CALENDAR, threshold=3.0))


@query("cp_25_realtime_rank", with_sql(LIVE, f"""
SELECT CAST(DATE '1995-01-01' + to_months(t) AS DATE) AS month, t IN (9, 12, 21) AS is_event, {r('share')} AS share,
       {r('rank() OVER (ORDER BY share DESC) + (count(*) OVER (PARTITION BY share) - 1) / 2.0')} AS rank, count(*) OVER () AS n_months,
       {r('bg')} AS background_median, CASE WHEN bg <> 0 THEN {r('share / bg')} END AS ratio_to_background
FROM mon CROSS JOIN (SELECT median(share) AS bg FROM mon WHERE t >= 8 AND t NOT IN (9, 12, 21)) WHERE t >= 8"""))
def realtime_rank(spark, sf):
    return rounded(R.rank_view(R.monthly_shares(live_flags(spark, sf), I.CALENDAR), EVENTS))


@query("cp_26_consensus_months", with_sql(OFF, f"SELECT t, n_breaks, {r('share')} AS share FROM osh ORDER BY osh.share DESC, osh.t LIMIT 3"))
def consensus(spark, sf):
    out = R.consensus_months(R.offline_shares(cusum_breaks(spark, sf), _series(spark, sf), I.CALENDAR), 3)
    return rounded(out.select("t", "n_breaks", "share"))


@query("cp_27_break_overlap", with_sql(OFF, f"""
SELECT CAST(coalesce(sum(a), 0) AS BIGINT) AS n_first, CAST(coalesce(sum(b), 0) AS BIGINT) AS n_second, count(*) FILTER (WHERE a = 1 AND b = 1) AS n_both,
       count(*) FILTER (WHERE a = 1 AND d = 1) AS n_first_and_december, {r('CASE WHEN sum(a) > 0 THEN count(*) FILTER (WHERE a = 1 AND b = 1) / sum(a) END')} AS share_both
FROM (SELECT series_id, max(CASE WHEN t = 11 THEN 1 ELSE 0 END) AS a, max(CASE WHEN t = 11 OR t = 23 THEN 1 ELSE 0 END) AS b,
  max(CASE WHEN t % 12 = 11 THEN 1 ELSE 0 END) AS d FROM (SELECT series_id, t FROM br) GROUP BY 1)""").replace("t = 11 OR t = 23", "t = 23"))
def overlap(spark, sf):
    return rounded(R.break_overlap(cusum_breaks(spark, sf), 11, 23))


@query("cp_28_december_cut", with_sql(BENCH, f"""
SELECT detector, mode, count(*) FILTER (WHERE detected) AS n_detected, count(*) FILTER (WHERE detected AND signal % 12 = 11) AS n_december,
       {r('count(*) FILTER (WHERE detected AND signal % 12 = 11) * 100.0 / nullif(count(*) FILTER (WHERE detected), 0)')} AS december_pct,
       {r('avg(CASE WHEN detected AND signal % 12 <> 11 THEN 100.0 ELSE 0 END)')} AS detected_without_pct FROM bench WHERE kind <> 'none' GROUP BY 1, 2"""))
def december(spark, sf):
    return rounded(B.december_cut(cusum_bench(spark, sf)).drop("penalty"))


@query("cp_28_december_groups", with_sql(BENCH, "SELECT CAST(signal % 12 + 1 AS INTEGER) AS month_no, position, delay, count(*) AS n FROM bench WHERE detected GROUP BY 1, 2, 3"))
def december_groups(spark, sf):
    return B.december_groups(cusum_bench(spark, sf))


NODEC = BENCH.replace("bench AS (", "bench0 AS (") + """,
bench AS (SELECT * REPLACE (detected AND NOT coalesce(signal % 12 = 11, FALSE) AS detected, CASE WHEN NOT coalesce(detected AND signal % 12 = 11, FALSE) THEN delay END AS delay) FROM bench0)"""


@query("cp_28_without_december", with_sql(NODEC + "," + bench_summary(), f"SELECT detector, mode, {r('detected_pct')} AS detected_pct, {r('clean_alarms_pct')} AS clean_alarms_pct, {r('youden_j')} AS youden_j FROM summ"))
def without_december(spark, sf):
    out = B.summarise(B.without_december(cusum_bench(spark, sf)))
    return rounded(out.select("detector", "mode", "detected_pct", "clean_alarms_pct", "youden_j"))


@query("cp_29_kind_by_position", with_sql(BENCH, f"""
SELECT detector, mode, kind, {', '.join(f"{r(f'avg(CASE WHEN position = {p} THEN CASE WHEN {c} THEN 100.0 ELSE 0 END END)')} AS {n}_{p}" for p in FULL.positions for n, c in (('detected', 'detected'), ('early', 'false_alarm')))}
FROM bench WHERE kind <> 'none' GROUP BY 1, 2, 3"""))
def kind_by_position(spark, sf):
    return rounded(B.kind_by_position(cusum_bench(spark, sf), FULL.positions).drop("penalty"))


@query("cp_30_first_alarm_mode", with_sql(BENCH, """
SELECT detector, mode, signal, n FROM (SELECT detector, mode, signal, count(*) AS n FROM bench WHERE kind = 'none' AND signal IS NOT NULL GROUP BY 1, 2, 3)
QUALIFY rank() OVER (PARTITION BY detector, mode ORDER BY n DESC) = 1"""))
def first_alarm(spark, sf):
    return B.first_alarm_mode(cusum_bench(spark, sf)).drop("penalty")


@query("cp_31_transform_test", with_sql(BENCH + "," + bench_summary(), f"""
SELECT a.detector, {r('a.youden_j')} AS j_a, {r('b.youden_j')} AS j_b, {r('a.clean_alarms_pct')} AS alarms_a, {r('b.clean_alarms_pct')} AS alarms_b,
       {r('a.youden_j - b.youden_j')} AS gain, a.youden_j > b.youden_j AND a.clean_alarms_pct < b.clean_alarms_pct AS wins
FROM summ a JOIN summ b USING (detector) WHERE a.mode = 'ratio' AND b.mode = 'raw'"""))
def transform_test(spark, sf):
    return rounded(B.transform_test(B.summarise(cusum_bench(spark, sf))).drop("penalty"))


@query("cp_31_transform_verdict")
def transform_verdict(spark, sf):
    return B.transform_verdict(B.transform_test(B.summarise(full_bench(spark, sf))))


RATE_EVENTS = ("1996-03-01", "1998-10-01", "2000-02-01")


@query("cp_32_rate_change_rank", f"""WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_tax) AS value FROM lineitem GROUP BY 1),
c AS (SELECT *, value - lag(value) OVER (ORDER BY month) AS change FROM m),
k AS (SELECT *, rank() OVER (ORDER BY round(abs(change), 9) DESC) AS rank, count(*) OVER () AS n_months, change = max(change) OVER () AS is_max, change = min(change) OVER () AS is_min FROM c WHERE change IS NOT NULL)
SELECT month, {r('value')} AS value, {r('change')} AS change, CAST(rank AS INTEGER) AS rank, n_months, is_max, is_min FROM k WHERE month IN ('1996-03-01', '1998-10-01', '2000-02-01')""")
def rate_change(spark, sf):
    from datetime import date

    from panelwright.sources.readers import read_aggregate

    rate = read_aggregate(I.table(spark, sf, "lineitem"), {}, "l_shipdate", "l_tax")
    return rounded(R.rate_change_rank(rate, [date.fromisoformat(e) for e in RATE_EVENTS]))


@query("cp_33_region_break_shares", with_sql(OFF + "," + O.REGIONS, f"""
SELECT region, CAST(g.t AS INTEGER) AS t, {r('count(br.series_id) * 1.0 / any_value(n_series)')} AS break_share, any_value(n_series) AS n_series
FROM (SELECT region, count(*) AS n_series FROM regions GROUP BY 1) m CROSS JOIN range(4, 77) AS g(t)
LEFT JOIN (SELECT br.series_id, br.t, region FROM br JOIN regions USING (series_id)) br USING (region, t) GROUP BY 1, 2"""))
def region_shares(spark, sf):
    low, high = R.allowed_range(I.CALENDAR.n_months, "ratio")
    out = R.region_break_shares(cusum_breaks(spark, sf), I.regions(spark, sf).select("series_id", "region"), I.CALENDAR, low, high)
    return rounded(out.drop("month"))


@query("cp_34_window_checks", with_sql(OFF, """
SELECT count(*) AS n_breaks, count(*) FILTER (WHERE t < 4 OR t > 76) AS n_outside, count(*) FILTER (WHERE t = 4) AS n_first_edge, count(*) FILTER (WHERE t = 76) AS n_last_edge FROM br"""))
def window_checks(spark, sf):
    return R.window_checks(cusum_breaks(spark, sf), I.CALENDAR.n_months, "ratio")


@query("snk_2_write_breaks", with_sql(OFF, "SELECT 'v2' AS protocol, series_id, t FROM br"))
def write_breaks(spark, sf):
    from panelwright.sources.sinks import with_protocol

    return cut_lineage(with_protocol(cusum_breaks(spark, sf).select("series_id", "t"), FULL.protocol), "breaks")


@query("src_9_read_protocol_tables")
def protocol_tables(spark, sf):
    from panelwright.sources.readers import read_protocol_tables
    from panelwright.sources.sinks import with_protocol

    stored = cut_lineage(with_protocol(offline_pelt(spark, sf), FULL.protocol), "protocol")
    return read_protocol_tables(stored, FULL.protocol, FULL.penalties)
