"""Registered queries: long series, common factor, two-stage, features, serving."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import backtest, factor, features as X, longseries as L, metrics, realtime, serving, two_stage as TS
from panelwright.plans import inputs as I, oracle as O
from panelwright.plans.backtest_queries import summary_sql
from panelwright.plans.oracle import r
from panelwright.plans.registry import query
from panelwright.plans.rounding import rounded
from panelwright.protocol import ForwardConfig, fold_array
from panelwright.session import written_once

PLAN3 = {I.BACKTEST.horizon: I.BACKTEST.folds}
PLANH = I.HORIZONS.folds
ORIGINS = (40, 60, 79)
H = 6

# --- long series ----------------------------------------------------------------------

LONG = O.AGGREGATE + "," + O.INDUSTRY + """,
longs AS (SELECT 'aggregate' AS series_key, month, value FROM agg UNION ALL SELECT series_key, month, value FROM industry),
lp AS (SELECT series_key, month, row_number() OVER (PARTITION BY series_key ORDER BY month) - 1 AS pos, ln(value) AS h FROM longs),
ld AS (SELECT *, h - lag(h) OVER (PARTITION BY series_key ORDER BY pos) AS d FROM lp),
cuts AS (SELECT series_key, pos + 1 AS n, h AS last FROM lp WHERE pos + 1 >= 25),
ks AS (SELECT k FROM range(0, 12) AS g(k)),
med AS (
  SELECT c.series_key, c.n, k, quantile_cont(d, 0.5) AS m FROM cuts c CROSS JOIN ks
  JOIN ld ON ld.series_key = c.series_key AND ld.pos >= 1 AND ld.pos < c.n AND ld.pos % 12 = (c.n + k) % 12 GROUP BY 1, 2, 3),
paths AS (
  SELECT c.series_key, c.n, k, 'random_walk' AS model, 2 AS ord, c.last AS p, c.last FROM cuts c CROSS JOIN ks
  UNION ALL
  SELECT c.series_key, c.n, k, 'seasonal_naive', 0, c.last + (a.h - b.h), c.last FROM cuts c CROSS JOIN ks
  JOIN lp a ON a.series_key = c.series_key AND a.pos = c.n - 12 + k JOIN lp b ON b.series_key = c.series_key AND b.pos = c.n - 13
  UNION ALL
  SELECT c.series_key, c.n, k, 'seasonal_median', 1, c.last + sum(m) OVER (PARTITION BY c.series_key, c.n ORDER BY k), c.last
  FROM cuts c JOIN med USING (series_key, n))"""


def chosen(horizons: str) -> str:
    """``choice(series_key, n, hz, model, explained)`` for every cut; ``horizons`` is a VALUES list."""
    return f"""
hz(hz) AS (VALUES {horizons}),
trial AS (
  SELECT c.series_key, c.n, hz, p.model, p.ord, avg(pow(p.p - a.h, 2)) AS mse
  FROM cuts c CROSS JOIN hz JOIN paths p ON p.series_key = c.series_key AND p.k < hz AND p.n BETWEEN greatest(36 + hz, c.n - 24) AND c.n - hz
  JOIN lp a ON a.series_key = c.series_key AND a.pos = p.n + p.k GROUP BY 1, 2, 3, 4, 5),
choice AS (
  SELECT c.series_key, c.n, hz.hz, coalesce(t.model, 'random_walk') AS model,
         CASE WHEN t.model IS NULL THEN 0 ELSE greatest(0, least(1, 1 - t.mse / t.rw)) END AS explained
  FROM cuts c CROSS JOIN hz LEFT JOIN (
    SELECT *, max(CASE WHEN model = 'random_walk' THEN mse END) OVER (PARTITION BY series_key, n, hz) AS rw
    FROM trial QUALIFY row_number() OVER (PARTITION BY series_key, n, hz ORDER BY mse, ord) = 1) t
  ON t.series_key = c.series_key AND t.n = c.n AND t.hz = hz.hz)"""


def long_series(spark, sf):
    whole = I.aggregate(spark, sf).select(F.lit("aggregate").alias("series_key"), "month", "value")
    return whole.unionByName(I.industry(spark, sf))


def cut_histories(spark, sf):
    origins = F.array(*[F.struct(F.lit(I.CALENDAR.month(n - 1)).alias("origin"), F.lit(n).alias("n")) for n in ORIGINS])
    return L.origins_of(long_series(spark, sf), ["series_key"], origins)


def _agg(model):
    def run(spark, sf):
        tried = L.forecast_all(cut_histories(spark, sf), H).where(F.col("model") == model)
        out = tried.select("series_key", "n", F.posexplode("path").alias("k", "forecast"))
        return rounded(out)
    return run


for _id, _model in (("agg_1", "seasonal_naive"), ("agg_2", "seasonal_median"), ("agg_5", "random_walk")):
    query(f"{_id}_{_model}", f"""WITH {LONG}
SELECT series_key, CAST(n AS INTEGER) AS n, CAST(k AS INTEGER) AS k, {r('p')} AS forecast FROM paths
WHERE n IN (40, 60, 79) AND k < {H} AND model = '{_model}'""")(_agg(_model))


@query("agg_3_ets")
def agg_ets(spark, sf):
    tried = L.forecast_all(cut_histories(spark, sf), H, solvers=("ets",)).where(F.col("model") == "ets")
    return tried.select("series_key", "n", F.posexplode("path").alias("k", "forecast"))


@query("agg_4_sarima")
def agg_sarima(spark, sf):
    tried = L.forecast_all(cut_histories(spark, sf), H, solvers=("sarima",)).where(F.col("model") == "sarima")
    return tried.select("series_key", "n", F.posexplode("path").alias("k", "forecast"))


@query("agg_6_choose_model", f"""WITH {LONG}, {chosen('(6)')}
SELECT series_key, CAST(n AS INTEGER) AS n, model, {r('explained')} AS explained FROM choice WHERE n IN (40, 60, 79)""")
def choose_model(spark, sf):
    return rounded(L.choose_model(cut_histories(spark, sf), ["series_key", "n"], H))


@query("agg_6_choose_model_all_candidates")
def choose_with_solvers(spark, sf):
    return L.choose_model(cut_histories(spark, sf), ["series_key", "n"], H, solvers=("ets", "sarima"))


# --- common factor --------------------------------------------------------------------

FED = O.AGGREGATE + f""",
fcal AS (SELECT {O.t_of('month')} AS t, value AS f FROM agg WHERE month BETWEEN DATE '1995-01-01' AND {O.LAST}),
fed AS (SELECT a.t, CAST(s AS INTEGER) AS step, ln(b.f / a.f) AS lf FROM fcal a CROSS JOIN range(1, 4) AS g(s) JOIN fcal b ON b.t = a.t + s)"""


def medians(group: str = "", join: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"""
rat AS (SELECT {g}a.series_id, a.t, CAST(s AS INTEGER) AS step, b.y / a.y AS ratio FROM clean a CROSS JOIN range(1, 4) AS g(s)
  JOIN clean b ON b.series_id = a.series_id AND b.t = a.t + s {join}),
mlr AS (SELECT {g}t, step, ln(quantile_cont(ratio, 0.5)) AS z FROM rat GROUP BY ALL),
pairs AS (SELECT {g}horizon, fold, train_end, t, step, lf AS x, z FROM mlr JOIN fed USING (t, step) JOIN folds ON t + step < train_end)"""


CF = O.TOTAL_CLEAN + "," + FED + "," + O.FOLDS3 + "," + medians()


def _arrays(spark, sf):
    return I.stored_arrays(spark, sf)


def _federal(spark, sf):
    return factor.log_federal(I.stored_aggregate(spark, sf), I.CALENDAR, 3)


def _pairs(spark, sf):
    return factor.training_pairs(factor.median_log_ratios(_arrays(spark, sf), 3), _federal(spark, sf), I.folds())


@query("cf_1_log_federal", f"WITH {FED} SELECT t, step, {r('lf')} AS log_federal FROM fed")
def log_federal(spark, sf):
    return rounded(_federal(spark, sf))


@query("cf_2_elasticity", f"""WITH {CF}
SELECT CAST(horizon AS INTEGER) AS horizon, fold, step, count(*) AS n_pairs, {r('regr_slope(z, x)')} AS elasticity FROM pairs GROUP BY 1, 2, 3""")
def elasticity(spark, sf):
    return rounded(factor.elasticity(_pairs(spark, sf)))


POOLED = """
ps AS (SELECT horizon, fold, count(*) AS n_pairs, regr_slope(z, x) AS slope,
  (regr_syy(z, x) - pow(regr_sxy(z, x), 2) / regr_sxx(z, x)) / greatest(count(*) - 2, 1) / regr_sxx(z, x) AS variance FROM pairs GROUP BY 1, 2)"""


@query("cf_3_pooled_slope", f"""WITH {CF}, {POOLED}
SELECT CAST(horizon AS INTEGER) AS horizon, fold, n_pairs, {r('slope')} AS slope, {r('variance')} AS variance FROM ps""")
def pooled_slope(spark, sf):
    return rounded(factor.pooled_slope(_pairs(spark, sf)))


# the test tables hold 2 to 8 suppliers per nation, so two are enough here (the default is eight)
MIN_MEMBERS = 2
CFR = O.TOTAL_CLEAN + "," + O.REGIONS + "," + FED + "," + O.FOLDS3 + "," + medians("region", "JOIN regions r ON r.series_id = a.series_id") + f""",
rs AS (SELECT region, horizon, fold, count(*) AS n_pairs, regr_slope(z, x) AS slope,
  (regr_syy(z, x) - pow(regr_sxy(z, x), 2) / regr_sxx(z, x)) / greatest(count(*) - 2, 1) / regr_sxx(z, x) AS variance FROM pairs GROUP BY 1, 2, 3),
big AS (SELECT region FROM regions JOIN (SELECT DISTINCT series_id FROM clean) USING (series_id) GROUP BY 1 HAVING count(*) >= {MIN_MEMBERS}),
allm AS (SELECT t, step, ln(quantile_cont(ratio, 0.5)) AS z FROM rat GROUP BY 1, 2),
allp AS (SELECT horizon, fold, regr_slope(z, lf) AS pooled FROM allm JOIN fed USING (t, step) JOIN folds ON t + step < train_end GROUP BY 1, 2),
own AS (SELECT *, avg(variance) OVER w AS noise, var_samp(slope) OVER w - avg(variance) OVER w AS btw, count(*) OVER w AS n_regions
  FROM rs SEMI JOIN big USING (region) WHERE variance > 0 WINDOW w AS (PARTITION BY horizon, fold)),
ratios AS (SELECT horizon, fold, region, slope, CASE WHEN btw > 0 THEN greatest(0, least(1, btw / (btw + noise))) ELSE 0 END AS weight, n_regions, pooled
  FROM own JOIN allp USING (horizon, fold) WHERE n_regions >= 10),
rr AS (SELECT *, (weight * slope + (1 - weight) * pooled) / pooled AS ratio FROM ratios)"""


def _ratios(spark, sf):
    regions = I.regions(spark, sf).select("series_id", "region")
    arrays = _arrays(spark, sf).join(regions, "series_id")
    by_region = factor.pooled_slope(
        factor.training_pairs(factor.median_log_ratios(arrays, 3, ("region",)), _federal(spark, sf), I.folds()), ("region",))
    members = arrays.groupBy("region").agg(F.count(F.lit(1)).alias("n_members"))
    return factor.regional_ratios(by_region, factor.pooled_slope(_pairs(spark, sf)), members, min_members=MIN_MEMBERS)


@query("cf_4_regional_ratios", f"""WITH {CFR}
SELECT CAST(horizon AS INTEGER) AS horizon, fold, region, {r('slope')} AS slope, {r('weight')} AS weight, n_regions, {r('ratio')} AS ratio FROM rr""")
def regional_ratios(spark, sf):
    return rounded(_ratios(spark, sf))


SCALES = f"""
sc AS (
  SELECT f.horizon, f.fold, p.k + 1 AS step, ch.model, ch.explained, p.p - p.last AS lfc
  FROM folds f JOIN choice ch ON ch.series_key = 'aggregate' AND ch.n = f.train_end AND ch.hz = f.horizon
  JOIN paths p ON p.series_key = 'aggregate' AND p.n = f.train_end AND p.model = ch.model AND p.k < f.horizon)"""
CFS = CFR + "," + LONG.replace(O.AGGREGATE + ",", "", 1) + "," + chosen("(3)") + "," + SCALES + """,
el AS (SELECT horizon, fold, step, count(*) AS n_pairs, regr_slope(z, lf) AS elasticity FROM allm JOIN fed USING (t, step) JOIN folds ON t + step < train_end GROUP BY 1, 2, 3),
scale AS (SELECT sc.*, n_pairs, elasticity, elasticity * explained AS scale FROM sc JOIN el USING (horizon, fold, step))"""


def _scale(spark, sf):
    paths = written_once("paths", lambda: TS.aggregate_paths(I.stored_aggregate(spark, sf), I.CALENDAR, PLAN3, inner=False))
    best = paths.select("horizon", "fold", "model", "explained", F.col("log_path").alias("path"), F.col("last_log").alias("last"))
    return factor.scales(factor.elasticity(_pairs(spark, sf)), best)


@query("cf_5_multipliers", f"""WITH {CFS}
SELECT CAST(horizon AS INTEGER) AS horizon, fold, region, CAST(step AS INTEGER) AS step, {r('exp(ratio * scale * lfc)')} AS multiplier FROM scale JOIN rr USING (horizon, fold)""")
def multipliers(spark, sf):
    return rounded(factor.multipliers(_scale(spark, sf), _ratios(spark, sf)))


@query("cf_5_series_multipliers", f"""WITH {CFS}
SELECT s.series_id, CAST(horizon AS INTEGER) AS horizon, fold, CAST(step AS INTEGER) AS step, {r('exp(coalesce(ratio, 1) * scale * lfc)')} AS multiplier
FROM (SELECT DISTINCT series_id FROM clean) s JOIN regions USING (series_id) CROSS JOIN scale LEFT JOIN rr USING (horizon, fold, region)""")
def series_multipliers(spark, sf):
    series = _arrays(spark, sf).select("series_id").join(I.regions(spark, sf).select("series_id", "region"), "series_id")
    return rounded(factor.series_multipliers(series, _scale(spark, sf), _ratios(spark, sf)))


@query("cf_6_realised_multiplier", f"""WITH {CFS}
SELECT CAST(horizon AS INTEGER) AS horizon, fold, t, CAST(step AS INTEGER) AS step, {r('exp(scale * lf)')} AS multiplier FROM fed JOIN scale USING (step)""")
def realised(spark, sf):
    return rounded(factor.realised_multipliers(_federal(spark, sf), _scale(spark, sf)))


@query("cf_6_realised_by_series", f"""WITH {CFS}
SELECT s.series_id, CAST(horizon AS INTEGER) AS horizon, fold, t, CAST(step AS INTEGER) AS step, {r('exp(coalesce(ratio, 1) * scale * lf)')} AS multiplier
FROM (SELECT DISTINCT series_id FROM clean) s JOIN regions USING (series_id) CROSS JOIN scale JOIN fed USING (step) LEFT JOIN rr USING (horizon, fold, region)""")
def realised_by_series(spark, sf):
    series = _arrays(spark, sf).select("series_id").join(I.regions(spark, sf).select("series_id", "region"), "series_id")
    return rounded(factor.realised_by_series(series, _federal(spark, sf), _scale(spark, sf), _ratios(spark, sf)))


@query("cf_7_factor_report", f"""WITH {CFS}
SELECT CAST(horizon AS INTEGER) AS horizon, fold, max(model) AS model, {r('max(explained)')} AS shrinkage, CAST(sum(n_pairs) AS BIGINT) AS n_pairs,
       {r('max(CASE WHEN step = 1 THEN elasticity END)')} AS elasticity_1, {r('max(CASE WHEN step = 3 THEN exp(scale * lfc) END)')} AS multiplier_3,
       (SELECT count(*) FROM rr x WHERE x.fold = scale.fold) AS n_regions, {r('coalesce((SELECT max(weight) FROM rr x WHERE x.fold = scale.fold), 0)')} AS pooling
FROM scale GROUP BY horizon, fold""")
def report(spark, sf):
    out = factor.factor_report(_scale(spark, sf), _ratios(spark, sf))
    return rounded(out.select("horizon", "fold", "model", "shrinkage", "n_pairs", F.col("elasticity")[0].alias("elasticity_1"),
                              F.col("multipliers")[2].alias("multiplier_3"), "n_regions", "pooling"))


# --- two-stage ------------------------------------------------------------------------

def staged(aggregate: str = "agg", known: bool = False, folds: str = O.FOLDSH) -> str:
    """``stage(horizon, fold, train_end, part, k, p)`` and ``shares`` per rule, then ``ts``."""
    if known:
        stage = """
stage AS (
  SELECT f.horizon, f.fold, f.train_end, part, CAST(k AS INTEGER) AS k, a.value AS p
  FROM folds f CROSS JOIN (VALUES ('origin', 0), ('inner', 1)) AS w(part, back) CROSS JOIN range(0, 12) AS g(k)
  JOIN agg a ON a.month = CAST(DATE '1995-01-01' + to_months(CAST(f.train_end - back * f.horizon + k AS INTEGER)) AS DATE) WHERE k < f.horizon)"""
    else:
        stage = """
stage AS (
  SELECT f.horizon, f.fold, f.train_end, part, p.k, exp(p.p) AS p
  FROM folds f CROSS JOIN (VALUES ('origin', 0), ('inner', 1)) AS w(part, back)
  JOIN choice ch ON ch.series_key = 'aggregate' AND ch.n = f.train_end - back * f.horizon AND ch.hz = f.horizon
  JOIN paths p ON p.series_key = 'aggregate' AND p.n = ch.n AND p.model = ch.model AND p.k < f.horizon)"""
    return f"""{folds},
fcal AS (SELECT {O.t_of('month')} AS t, value AS f FROM {aggregate} WHERE month BETWEEN DATE '1995-01-01' AND {O.LAST}), {stage},
rules(rule, w, ord) AS (VALUES ('last', 1, 0), ('median3', 3, 1), ('median6', 6, 2)),
share AS (
  SELECT f.horizon, f.fold, part, rule, ord, c.series_id, quantile_cont(c.y / fc.f, 0.5) AS s
  FROM folds f CROSS JOIN (VALUES ('origin', 0), ('inner', 1)) AS w(part, back) CROSS JOIN rules
  JOIN clean c ON c.t < f.train_end - back * f.horizon AND c.t >= f.train_end - back * f.horizon - rules.w JOIN fcal fc ON fc.t = c.t GROUP BY ALL),
rulescore AS (
  SELECT s.horizon, s.fold, s.rule, s.ord, avg(abs(s.s * st.p - c.y)) AS mae FROM share s JOIN stage st ON st.horizon = s.horizon AND st.fold = s.fold AND st.part = 'inner'
  JOIN clean c ON c.series_id = s.series_id AND c.t = st.train_end - st.horizon + st.k WHERE s.part = 'inner' GROUP BY 1, 2, 3, 4),
rule AS (SELECT horizon, fold, rule, mae FROM rulescore QUALIFY row_number() OVER (PARTITION BY horizon, fold ORDER BY mae, ord) = 1),
ts AS (
  SELECT s.series_id, s.horizon, s.fold, st.train_end, r.rule, st.k + 1 AS step, s.s * st.p AS forecast
  FROM share s JOIN rule r USING (horizon, fold, rule) JOIN stage st ON st.horizon = s.horizon AND st.fold = s.fold AND st.part = 'origin' WHERE s.part = 'origin')"""


HZ = "(1), (3), (6), (12)"
TSQ = O.TOTAL_CLEAN + "," + LONG + "," + chosen(HZ) + "," + staged()
TSK = O.TOTAL_CLEAN + "," + O.AGGREGATE + "," + staged(known=True)


def _paths(spark, sf, known=False, where=None):
    agg = I.stored_aggregate(spark, sf) if where is None else where
    return TS.known_paths(agg, I.CALENDAR, PLANH) if known else TS.aggregate_paths(agg, I.CALENDAR, PLANH)


def _agg_array(spark, sf):
    return TS.aggregate_array(I.stored_aggregate(spark, sf), I.CALENDAR)


@query("ts_1_shares", f"""WITH {TSK}
SELECT series_id, CAST(horizon AS INTEGER) AS horizon, fold, rule, {r('s * 1000')} AS share FROM share WHERE part = 'origin'""")
def shares(spark, sf):
    from panelwright.functions.frames import with_scalars

    rows = with_scalars(backtest.fold_rows(_arrays(spark, sf), I.horizon_folds()), _agg_array(spark, sf))
    cells = F.inline(F.array(*[
        F.struct(F.lit(k).alias("rule"), (TS.share(F.col("y"), F.col("f"), F.col("train_end"), w) * 1000).alias("share"))
        for k, w in TS.SHARE_RULES.items()]))
    return rounded(rows.select("series_id", "horizon", "fold", cells))


@query("ts_2_share_rule", f"""WITH {TSQ}
SELECT CAST(s.horizon AS INTEGER) AS horizon, s.fold, s.rule, {r('s.mae')} AS mae, s.rule = r.rule AS chosen FROM rulescore s JOIN rule r USING (horizon, fold)""")
def share_rule(spark, sf):
    scores = TS.share_rule_scores(_arrays(spark, sf), PLANH, _paths(spark, sf), _agg_array(spark, sf))
    best = TS.choose_share_rule(scores).withColumnRenamed("rule", "best")
    out = scores.join(best, ["horizon", "fold"]).withColumn("chosen", F.col("rule") == F.col("best"))
    return rounded(out.select("horizon", "fold", "rule", "mae", "chosen"))


TS_COLUMNS = f"series_id, CAST(horizon AS INTEGER) AS horizon, fold, rule, CAST(step AS INTEGER) AS step, {r('forecast')} AS forecast"


def _long(done):
    return rounded(done.select("series_id", "horizon", "fold", "rule", F.posexplode("forecast").alias("k", "forecast"))
                   .select("series_id", "horizon", "fold", "rule", (F.col("k") + 1).alias("step"), "forecast"))


@query("ts_3_two_stage", f"WITH {TSQ} SELECT {TS_COLUMNS} FROM ts")
def two_stage(spark, sf):
    return _long(TS.two_stage(_arrays(spark, sf), PLANH, _paths(spark, sf), _agg_array(spark, sf)))


# the seasonally adjusted stand-in: the aggregate of one return flag, a smoother series
SA = """agg AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1000000.0 AS value
  FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)"""


def adjusted_aggregate(spark, sf):
    from panelwright.operators.prep import monthly_panel
    from panelwright.sources.readers import read_panel

    raw = read_panel(I.transactions(spark, sf).where(F.col("category") == "N"), "M")
    return monthly_panel(raw, [], unit=1_000_000.0)


@query("ts_4_two_stage_sa", f"WITH {(O.TOTAL_CLEAN + ',' + LONG + ',' + chosen(HZ) + ',' + staged()).replace(O.AGGREGATE.strip(), SA)} SELECT {TS_COLUMNS} FROM ts")
def two_stage_sa(spark, sf):
    agg = adjusted_aggregate(spark, sf)
    return _long(TS.two_stage(_arrays(spark, sf), PLANH, TS.aggregate_paths(agg, I.CALENDAR, PLANH), TS.aggregate_array(agg, I.CALENDAR),
                              name="two_stage_sa"))


@query("ts_5_two_stage_known", f"WITH {TSK} SELECT {TS_COLUMNS} FROM ts")
def two_stage_known(spark, sf):
    return _long(TS.two_stage(_arrays(spark, sf), PLANH, _paths(spark, sf, known=True), _agg_array(spark, sf), name="two_stage_known"))


# --- features -------------------------------------------------------------------------

FEATURES = """
feat AS (
  SELECT series_id, t, y,
         lag(y, 1) OVER w / y AS ratio_lag_2, lag(y, 2) OVER w / y AS ratio_lag_3, lag(y, 3) OVER w / y AS ratio_lag_4,
         lag(y, 4) OVER w / y AS ratio_lag_5, lag(y, 5) OVER w / y AS ratio_lag_6, ln(y) AS level_log,
         avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS 2 PRECEDING) / y AS mean_ratio_3,
         stddev_pop(y) OVER (PARTITION BY series_id ORDER BY t ROWS 2 PRECEDING) / y AS std_ratio_3,
         avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS 5 PRECEDING) / y AS mean_ratio_6,
         stddev_pop(y) OVER (PARTITION BY series_id ORDER BY t ROWS 5 PRECEDING) / y AS std_ratio_6,
         CAST(t % 12 + 1 AS INTEGER) AS month_no
  FROM clean WINDOW w AS (PARTITION BY series_id ORDER BY t))"""
FEATURE_LIST = ", ".join(f"{r(c)} AS {c}" for c in X.LAG_COLUMNS if c != "month_no") + ", month_no"


def _clean(spark, sf):
    return I.total_clean(spark, sf).select("series_id", "t", "y")


@query("gb_1_lag_features", f"WITH {O.TOTAL_CLEAN}, {FEATURES} SELECT series_id, t, {FEATURE_LIST} FROM feat WHERE t >= 5 AND y > 0")
def lag_features(spark, sf):
    return rounded(X.lag_features(_clean(spark, sf)).select("series_id", "t", *X.LAG_COLUMNS))


@query("gb_2_ratio_target", f"""WITH {CFS}, tgt AS (SELECT series_id, t, y, lead(y, 2) OVER (PARTITION BY series_id ORDER BY t) AS y2 FROM clean)
SELECT series_id, tgt.t, {r('y2 / y / exp(scale * lf)')} AS target
FROM tgt JOIN scale ON scale.fold = 0 AND scale.step = 2 JOIN fed ON fed.t = tgt.t AND fed.step = 2 WHERE tgt.t >= 5 AND tgt.t <= 70 - 2 - 1 AND y > 0""")
def ratio_target(spark, sf):
    rows = X.lag_features(X.with_targets(_clean(spark, sf), 3))
    seen = factor.realised_multipliers(_federal(spark, sf), _scale(spark, sf)).where((F.col("fold") == 0) & (F.col("step") == 2))
    return rounded(X.ratio_target(rows, 2, 70, seen.select("t", "multiplier")).select("series_id", "t", "target"))


CATCLEAN = O.SPENDING + "," + O.cleaned("spending", "category", "c_")


@query("gb_3_category_shares", f"""WITH {O.TOTAL_CLEAN}, {CATCLEAN},
sh AS (
  SELECT a.series_id, a.t, {', '.join(f"max(CASE WHEN c.category = '{c}' THEN c.y END) / any_value(a.y) AS s_{c}" for c in I.CATEGORIES)}
  FROM clean a LEFT JOIN c_clean c ON c.series_id = a.series_id AND c.t = a.t GROUP BY 1, 2)
SELECT series_id, t, {', '.join(f"{r(f's_{c}')} AS share_{c}" for c in I.CATEGORIES)},
  {', '.join(f"CASE WHEN lag(s_{c}, 6) OVER w > 0 THEN {r(f's_{c} / lag(s_{c}, 6) OVER w - 1')} END AS dshare_{c}" for c in I.CATEGORIES)}
FROM sh WINDOW w AS (PARTITION BY series_id ORDER BY t)""")
def category_shares(spark, sf):
    return rounded(X.category_shares(_clean(spark, sf), _category_clean(spark, sf), I.CATEGORIES))


def _category_clean(spark, sf):
    from panelwright.operators.prep import clean_panel

    return clean_panel(I.spending(spark, sf), ["series_id", "category"], I.CALENDAR)


@query("gb_4_stacked_categories", f"""WITH {O.TOTAL_CLEAN}, {CATCLEAN},
u AS (SELECT series_id, t, y, 'total' AS part, 1.0 AS is_total FROM clean UNION ALL SELECT series_id, t, y, category, 0.0 FROM c_clean SEMI JOIN (SELECT DISTINCT series_id FROM clean) USING (series_id)),
f AS (SELECT *, lag(y, 5) OVER (PARTITION BY series_id, part ORDER BY t) AS y5, lead(y, 1) OVER (PARTITION BY series_id, part ORDER BY t) AS y1 FROM u)
SELECT series_id, t, part, CAST(is_total AS DOUBLE) AS is_total, {r('y5 / y')} AS ratio_lag_6, {r('y1 / y')} AS target FROM f WHERE t >= 5 AND t <= 70 - 2 AND y > 0""")
def stacked(spark, sf):
    total = X.ratio_target(X.lag_features(X.with_targets(_clean(spark, sf), 1)), 1, 70).withColumn("part", F.lit("total"))
    keys = ("series_id", "category")
    cats = X.lag_features(X.with_targets(_category_clean(spark, sf), 1, keys), keys)
    known = _arrays(spark, sf).select("series_id")
    cats = X.ratio_target(cats, 1, 70).withColumnRenamed("category", "part").join(known, "series_id", "left_semi")
    return rounded(X.stacked(total, cats).select("series_id", "t", "part", "is_total", "ratio_lag_6", "target"))


EXT = """ext AS (
  SELECT 'spending' AS name, month, value FROM agg
  UNION ALL SELECT 'price', CAST(date_trunc('month', o_orderdate) AS DATE), avg(o_totalprice) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2
  UNION ALL SELECT 'rate', CAST(date_trunc('month', l_shipdate) AS DATE), avg(l_tax) FROM lineitem WHERE l_returnflag = 'N' GROUP BY 2),
chg AS (SELECT a.name, a.month, k, CASE WHEN a.name = 'rate' THEN a.value - b.value ELSE a.value / b.value - 1 END AS c
  FROM ext a CROSS JOIN (VALUES (1), (3), (12)) AS g(k) JOIN ext b ON b.name = a.name AND a.month = CAST(b.month + to_months(CAST(k AS INTEGER)) AS DATE) WHERE b.value <> 0)"""
EXT_NAMES = ("spending", "price", "rate")


@query("gb_5_external_features", f"""WITH {O.AGGREGATE}, {EXT}
SELECT month, {', '.join(f"{r(f"max(CASE WHEN name = '{n}' AND k = {k} THEN c END)")} AS {n}_d{k}" for n in EXT_NAMES for k in (1, 3, 12))} FROM chg GROUP BY 1""")
def external(spark, sf):
    from panelwright.plans.prep_queries import external_frame

    return rounded(X.external_features(external_frame(spark, sf), EXT_NAMES, ("rate",)))


@query("gb_7_pretrain_rows", f"""WITH {O.INDUSTRY},
c AS (SELECT series_key AS series_id, month, value AS y, CAST(row_number() OVER (PARTITION BY series_key ORDER BY month) - 1 AS INTEGER) AS t FROM industry WHERE month <= DATE '2000-10-01'),
f AS (SELECT *, lag(y, 5) OVER w AS y5, lead(y, 3) OVER w AS y3 FROM c WINDOW w AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, t, CAST(month(month) AS INTEGER) AS month_no, {r('y5 / y')} AS ratio_lag_6, {r('y3 / y')} AS target FROM f WHERE t >= 5 AND y > 0 AND y3 IS NOT NULL""")
def pretrain(spark, sf):
    rows = X.pretrain_rows(I.industry(spark, sf), I.CALENDAR.month(69), 3)
    out = rows.where(F.col("y_3").isNotNull()).withColumn("target", F.col("y_3") / F.col("y"))
    return rounded(out.select("series_id", "t", "month_no", "ratio_lag_6", "target"))


# --- forward and serving --------------------------------------------------------------

# closed forms, so that SQL can check the rows; plans/tree_queries.py has the forecast with the panel learner
FORWARD = ForwardConfig(recommended=((1, "seasonal_drift"), (3, "seasonal_drift"), (6, "seasonal_drift"), (12, "two_stage")))
FWDF = "fplan(horizon) AS (VALUES (1), (3), (6), (12)), folds AS (SELECT horizon, 0 AS fold, 79 AS train_end FROM fplan)"
LONGCUT = LONG.replace("FROM agg UNION ALL", f"FROM agg WHERE month <= {O.LAST} UNION ALL")
FWD = O.TOTAL_CLEAN + "," + LONGCUT + "," + chosen(HZ) + "," + staged(folds=FWDF) + f""",
sd AS (
  SELECT series_id, avg(CASE WHEN t >= 67 THEN y END) AS mr, avg(CASE WHEN t >= 55 AND t < 67 THEN y END) AS me FROM clean GROUP BY 1),
knownp AS (
  SELECT horizon, CAST(k AS INTEGER) AS k, a.value AS p FROM fplan CROSS JOIN range(0, 12) AS g(k) LEFT JOIN agg a ON a.month = CAST(DATE '2001-08-01' + to_months(CAST(k AS INTEGER)) AS DATE) WHERE k < horizon),
kok AS (SELECT horizon, count(p) = count(*) AS ok FROM knownp GROUP BY 1),
kst AS (
  SELECT f.horizon, CAST(k AS INTEGER) AS k, a.value AS p FROM fplan f CROSS JOIN range(0, 12) AS g(k)
  JOIN agg a ON a.month = CAST(DATE '1995-01-01' + to_months(CAST(79 - f.horizon + k AS INTEGER)) AS DATE) WHERE k < f.horizon),
krs AS (
  SELECT s.horizon, s.rule, s.ord, avg(abs(s.s * st.p - c.y)) AS mae FROM share s JOIN kst st ON st.horizon = s.horizon
  JOIN clean c ON c.series_id = s.series_id AND c.t = 79 - st.horizon + st.k WHERE s.part = 'inner' GROUP BY 1, 2, 3),
krule AS (SELECT horizon, rule FROM krs QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY mae, ord) = 1),
fwd AS (
  SELECT c.series_id, 'seasonal_drift' AS model, horizon, k + 1 AS step, c.y + (mr - me) / 12 * (k + 1) AS forecast, TRUE AS recommended, FALSE AS pub, NULL AS error
  FROM fplan CROSS JOIN range(0, 12) AS g(k) JOIN clean c ON c.t = 67 + k JOIN sd USING (series_id) WHERE k < horizon AND horizon < 12
  UNION ALL SELECT series_id, 'two_stage', horizon, step, forecast, horizon = 12, FALSE, NULL FROM ts
  UNION ALL
  SELECT s.series_id, 'two_stage_known', s.horizon, kp.k + 1, CASE WHEN ok THEN s.s * kp.p END, FALSE, TRUE,
         CASE WHEN NOT ok THEN 'ValueError: the aggregate of the horizon months is not known' END
  FROM share s JOIN krule USING (horizon, rule) JOIN knownp kp ON kp.horizon = s.horizon JOIN kok ON kok.horizon = s.horizon WHERE s.part = 'origin'),
fwdm AS (SELECT fwd.*, CAST(DATE '2001-07-01' + to_months(CAST(step AS INTEGER)) AS DATE) AS month FROM fwd)"""
FWD_R = FWD + "," + O.REGIONS


def _forward(spark, sf):
    return serving.forecast_forward(_arrays(spark, sf), I.stored_aggregate(spark, sf), I.regions(spark, sf), I.CALENDAR, FORWARD)


def _stored_forward(spark, sf):
    """The forecast table as the serving operators find it: written once."""
    return written_once("forecast", lambda: _forward(spark, sf))


@query("fwd_1_forecast_forward", f"""WITH {FWD_R}
SELECT series_id, region, model, CAST(horizon AS INTEGER) AS horizon, month, {r('forecast')} AS forecast, recommended, pub AS uses_published_aggregate, error
FROM fwdm LEFT JOIN regions USING (series_id)""")
def forecast_forward(spark, sf):
    return rounded(_forward(spark, sf))


@query("fwd_2_future_index", f"""WITH {O.TOTAL}, z AS (SELECT max(month) AS z FROM total WHERE month <= {O.LAST})
SELECT CAST(k AS INTEGER) AS step, CAST(z + to_months(CAST(k AS INTEGER)) AS DATE) AS month FROM z CROSS JOIN range(1, 13) AS g(k)""")
def future_index(spark, sf):
    last = I.total_panel(spark, sf).where(I.CALENDAR.contains(F.col("month"))).agg(F.max("month").alias("z"))
    return last.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.add_months("z", k))).alias("k", "month")).select(
        (F.col("k") + 1).alias("step"), "month")


CHECK = LONGCUT + "," + chosen(HZ) + f""",
own AS (SELECT p.k, c.hz AS horizon, c.model, exp(p.p) AS f, exp(p.last) AS last FROM choice c JOIN paths p ON p.series_key = c.series_key AND p.n = c.n AND p.model = c.model AND p.k < c.hz
  WHERE c.series_key = 'aggregate' AND c.n = 79),
chk AS (
  SELECT horizon, 'two_stage' AS method, model AS aggregate_model, k, f AS forecast FROM own
  UNION ALL SELECT horizon, 'naive', 'last month', k, last FROM own
  UNION ALL SELECT horizon, 'seasonal_naive', 'year ago', k, a.value FROM own LEFT JOIN agg a ON a.month = CAST(DATE '2001-08-01' + to_months(CAST(k - 12 AS INTEGER)) AS DATE)),
checked AS (
  SELECT horizon, method, aggregate_model, CAST(DATE '2001-08-01' + to_months(CAST(k AS INTEGER)) AS DATE) AS month, forecast, b.value AS actual, (forecast - b.value) / b.value * 100 AS error_pct
  FROM chk LEFT JOIN agg b ON b.month = CAST(DATE '2001-08-01' + to_months(CAST(k AS INTEGER)) AS DATE))"""


@query("fwd_3_aggregate_check", f"""WITH {CHECK}
SELECT CAST(horizon AS INTEGER) AS horizon, method, aggregate_model, month, {r('forecast')} AS forecast, {r('actual')} AS actual, {r('error_pct')} AS error_pct FROM checked""")
def aggregate_check(spark, sf):
    return rounded(serving.aggregate_check(I.stored_aggregate(spark, sf), I.CALENDAR, FORWARD.horizons))


@query("fwd_4_aggregate_mape", f"""WITH {CHECK}
SELECT CAST(horizon AS INTEGER) AS horizon, {', '.join(f"{r(f"avg(CASE WHEN method = '{m}' THEN abs(error_pct) END)")} AS {m}" for m in ('two_stage', 'naive', 'seasonal_naive'))} FROM checked GROUP BY 1""")
def aggregate_mape(spark, sf):
    return rounded(serving.aggregate_mape(serving.aggregate_check(I.stored_aggregate(spark, sf), I.CALENDAR, FORWARD.horizons)))


QUANTILES = ", ".join(f"{r(f'quantile_cont(growth, {p})')} AS {n}" for n, p in serving.GROWTH.items())


@query("fwd_5_growth_stats", f"""WITH {FWD}, gr AS (
  SELECT model, horizon, forecast / c.y - 1 AS growth FROM fwdm JOIN clean c ON c.series_id = fwdm.series_id AND c.month = CAST(fwdm.month - to_months(12) AS DATE) WHERE forecast IS NOT NULL)
SELECT model, CAST(horizon AS INTEGER) AS horizon, {QUANTILES}, count(growth) AS n FROM gr GROUP BY 1, 2""")
def growth_stats(spark, sf):
    return rounded(serving.growth_stats(_stored_forward(spark, sf), I.total_clean(spark, sf)))


@query("fwd_6_growth_stats_annual", f"""WITH {FWD}, back AS (SELECT series_id, sum(y) AS b FROM clean WHERE t >= 67 GROUP BY 1),
gr AS (SELECT model, series_id, sum(forecast) / any_value(b) - 1 AS growth FROM fwdm JOIN back USING (series_id) WHERE horizon = 12 GROUP BY 1, 2)
SELECT model, {QUANTILES}, count(growth) AS n FROM gr WHERE growth IS NOT NULL GROUP BY 1""")
def growth_annual(spark, sf):
    return rounded(serving.growth_stats_annual(_stored_forward(spark, sf), _arrays(spark, sf)))


BYSTEP = FWD + """,
sh AS (SELECT s AS step, min(horizon) AS horizon FROM range(1, 13) AS g(s) JOIN fplan ON horizon >= s GROUP BY 1),
bystep AS (SELECT f.series_id, f.model, f.horizon, f.month, f.step, f.forecast FROM fwdm f JOIN sh USING (step, horizon) WHERE recommended)"""


@query("fwd_7_step_horizon_map", f"""WITH {BYSTEP}
SELECT CAST(step AS INTEGER) AS step, CAST(horizon AS INTEGER) AS horizon, count(*) AS n_series FROM bystep GROUP BY 1, 2""")
def step_map(spark, sf):
    return serving.forecast_by_step(_stored_forward(spark, sf), I.CALENDAR, FORWARD.horizons).groupBy("step", "horizon").agg(
        F.count(F.lit(1)).alias("n_series"))


@query("fwd_8_forecast_by_step", f"""WITH {BYSTEP}
SELECT series_id, model, CAST(horizon AS INTEGER) AS horizon, month, CAST(step AS INTEGER) AS step, {r('forecast')} AS forecast FROM bystep""")
def by_step(spark, sf):
    return rounded(serving.forecast_by_step(_stored_forward(spark, sf), I.CALENDAR, FORWARD.horizons))


@query("fwd_9_forecast_rule", f"""WITH {BYSTEP}, d AS (SELECT DISTINCT step, month, horizon, model FROM bystep)
SELECT model, CAST(horizon AS INTEGER) AS horizon, min(month) AS first_month, max(month) AS last_month, count(*) AS n_months FROM d GROUP BY 1, 2""")
def rule(spark, sf):
    return serving.forecast_rule(_stored_forward(spark, sf), I.CALENDAR, FORWARD.horizons)


TOTAL_SCORES = O.TOTAL_CLEAN + "," + O.scores("clean")


def total_scores(spark, sf):
    return backtest.score_series(_arrays(spark, sf), I.folds(), I.MODELS)


def _documents(spark, sf):
    breaks = realtime.offline_breaks(_arrays(spark, sf), "cusum", "ratio", [], I.CALENDAR)
    return serving.series_documents(_arrays(spark, sf), _stored_forward(spark, sf), total_scores(spark, sf), I.CALENDAR, FORWARD.horizons, breaks)


@query("fwd_10_series_document", f"""WITH {BYSTEP}, {O.scores('clean').replace('folds AS', 'folds3 AS', 1).replace('FROM folds', 'FROM folds3').replace('folds f', 'folds3 f').replace('FROM folds3,', 'FROM folds3,')},
a AS (SELECT series_id, count(*) AS n_fact, CAST(sum(CAST(round(y) AS INTEGER)) AS BIGINT) AS fact_sum FROM clean GROUP BY 1),
b AS (SELECT series_id, count(*) AS n_forecast, CAST(sum(CAST(round(forecast) AS INTEGER)) AS BIGINT) AS forecast_sum FROM bystep GROUP BY 1),
k AS (SELECT series_id, count(*) AS n_known FROM fwdm WHERE pub AND horizon = 3 GROUP BY 1),
e AS (SELECT series_id, string_agg(CAST(CAST(round(mae) AS INTEGER) AS VARCHAR), ',' ORDER BY fold) AS drift_mae FROM scores WHERE model = 'drift' AND error IS NULL GROUP BY 1)
SELECT series_id, n_fact, fact_sum, n_forecast, forecast_sum, n_known, drift_mae FROM a LEFT JOIN b USING (series_id) LEFT JOIN k USING (series_id) LEFT JOIN e USING (series_id)""")
def document(spark, sf):
    def add(arr):
        return F.aggregate(arr, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    return _documents(spark, sf).select(
        "series_id", F.size("fact").cast("bigint").alias("n_fact"), add(F.col("fact")).alias("fact_sum"),
        F.size("forecast").cast("bigint").alias("n_forecast"), add(F.col("forecast")).alias("forecast_sum"),
        F.size("known").cast("bigint").alias("n_known"),
        F.array_join(F.transform(F.try_element_at("mae", F.lit("drift")), lambda x: x.cast("string")), ",").alias("drift_mae"))


@query("snk_7_series_json")
def series_json(spark, sf):
    from panelwright.session import work_path
    from panelwright.sources.sinks import write_series_json

    shard = F.pmod(F.xxhash64("region"), F.lit(16)).cast("int")
    docs = _documents(spark, sf).join(I.regions(spark, sf).select("series_id", shard.alias("region_no")), "series_id")
    path = work_path(spark, "series-json")
    write_series_json(docs, "region_no", path)
    back = spark.read.text(path)
    return back.groupBy("region_no").agg(F.count(F.lit(1)).alias("n_series"), F.sum(F.length("value")).alias("n_chars"))


@query("fwd_12_panel_mae_by_fold", f"""WITH {TOTAL_SCORES}, m AS (SELECT model, fold, avg(mae) AS m FROM scores WHERE error IS NULL GROUP BY 1, 2)
SELECT model, {', '.join(f'{r(f"max(CASE WHEN fold = {i} THEN m END)")} AS fold_{i}' for i in range(3))}, {r('avg(m)')} AS mean FROM m GROUP BY 1""")
def panel_mae(spark, sf):
    return rounded(serving.panel_mae_by_fold(total_scores(spark, sf), [0, 1, 2]))


ROLES = {"reference": "seasonal_drift", "naive": "naive_last", "trend": "drift", "season": "seasonal_naive"}


@query("fwd_13_horizon_table", f"""WITH {O.CAT_SCORES_H}, {summary_sql('horizon, model')}, roles(role, model) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in ROLES.items())})
SELECT role, model, {', '.join(f'{r(f"max(CASE WHEN horizon = {h} THEN mae END)")} AS h{h}' for h in (1, 3, 6, 12))} FROM summary JOIN roles USING (model) GROUP BY 1, 2""")
def horizon_table(spark, sf):
    table = metrics.summarise(I.horizon_scores(spark, sf), ["horizon", "model"], exact_median=False)
    return rounded(serving.horizon_table(table, ROLES, [1, 3, 6, 12]))


@query("fwd_14_series_summary", f"""WITH {BYSTEP}, {O.scores('clean').replace('folds AS', 'folds3 AS', 1).replace('FROM folds', 'FROM folds3').replace('folds f', 'folds3 f')},
b AS (SELECT series_id, avg(y) AS last_year FROM clean WHERE t >= 67 GROUP BY 1),
a AS (SELECT series_id, avg(forecast) AS forecast_mean FROM bystep GROUP BY 1),
m AS (SELECT series_id, model, avg(mae) AS mae FROM scores WHERE error IS NULL GROUP BY 1, 2),
o(model, place) AS (VALUES ('naive_last', 1), ('seasonal_naive', 2), ('drift', 3), ('seasonal_drift', 4)),
w AS (SELECT series_id, model, mae FROM m JOIN o USING (model) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(mae, 9), place) = 1)
SELECT series_id, {r('forecast_mean')} AS forecast_mean, {r('forecast_mean / last_year - 1')} AS growth, w.model AS best_model, {r('w.mae')} AS best_mae, {r('ref.mae')} AS reference_mae
FROM b LEFT JOIN a USING (series_id) LEFT JOIN w USING (series_id) LEFT JOIN m ref ON ref.series_id = b.series_id AND ref.model = 'seasonal_drift'""")
def series_summary(spark, sf):
    steps = serving.forecast_by_step(_stored_forward(spark, sf), I.CALENDAR, FORWARD.horizons)
    return rounded(serving.series_summary(_arrays(spark, sf), steps, total_scores(spark, sf), I.MODELS, "seasonal_drift"))


@query("fwd_15_windows_held", f"""WITH {O.CAT_SCORES_H}, m AS (SELECT horizon, model, fold, avg(mae) AS m FROM scores WHERE error IS NULL GROUP BY 1, 2, 3),
b AS (SELECT *, max(CASE WHEN model = 'naive_last' THEN m END) OVER (PARTITION BY horizon, fold) AS base FROM m)
SELECT CAST(horizon AS INTEGER) AS horizon, model, count(*) FILTER (WHERE m < base) AS held, count(*) FILTER (WHERE m > base) AS lost FROM b GROUP BY 1, 2""")
def windows_held(spark, sf):
    return serving.windows_held(I.horizon_scores(spark, sf), "naive_last")


@query("fwd_17_series_set_match", f"""WITH {O.TOTAL_CLEAN}
SELECT CAST(0 AS BIGINT) AS only_forecast, (SELECT count(DISTINCT series_id) FROM total) - count(DISTINCT series_id) AS only_panel FROM clean""")
def series_set(spark, sf):
    return serving.series_set_difference(_stored_forward(spark, sf), I.total_panel(spark, sf))


# --- iterative forecasters --------------------------------------------------------------

def _solved(model):
    def run(spark, sf):
        from panelwright.operators import solvers

        rows = backtest.fold_rows(I.category_arrays(spark, sf), I.folds())
        done = solvers.forecast_series(rows, (model,))
        return backtest.score_rows(done)
    return run


for _id, _model in (("fc_5", "theta"), ("fc_6", "ets_damped"), ("fc_7", "ets_seasonal"), ("fc_8", "arima111"), ("fc_8", "arima011")):
    query(f"{_id}_{_model}")(_solved(_model))
