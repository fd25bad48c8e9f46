"""Registered queries: forecasters, scores, summaries, comparisons, guards, merges."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import backtest, compare, folds as guard, metrics
from panelwright.plans import inputs as I, oracle as O
from panelwright.plans.oracle import r
from panelwright.plans.registry import query
from panelwright.plans.rounding import rnd, rounded
from panelwright.session import cut_lineage, work_path
from panelwright.sources import readers, sinks

S = O.CAT_SCORES
SH = O.CAT_SCORES_H
FC = O.CATEGORY + "," + O.cleaned("catpanel", "category") + "," + O.forecasts()


def _points_of(model):
    def run(spark, sf):
        return rounded(I.points(spark, sf).where(F.col("model") == model)
                       .select("horizon", "fold", "series_id", "step", "t", "forecast", "actual"))
    return run


for _id, _model in (("fc_1", "naive_last"), ("fc_2", "seasonal_naive"), ("fc_3", "drift"), ("fc_4", "seasonal_drift")):
    query(f"{_id}_{_model}", f"""WITH {FC}
SELECT CAST(horizon AS INTEGER) AS horizon, fold, fc.series_id, step, CAST(fc.t AS INTEGER) AS t, {r('forecast')} AS forecast, {r('a.y')} AS actual
FROM fc JOIN filled a ON a.series_id = fc.series_id AND a.t = fc.t WHERE model = '{_model}'""")(_points_of(_model))


SCORE_COLUMNS = f"""model, CAST(horizon AS INTEGER) AS horizon, fold, train_end, series_id, {r('mae', 7)} AS mae, {r('r2')} AS r2,
  {r('smape')} AS smape, {r('mase')} AS mase, {r('sse', 3)} AS sse, {r('sst', 3)} AS sst, n, {r('y_sum')} AS y_sum, {r('y_sq', 3)} AS y_sq, error"""


def _scores(df):
    wide = {c: rnd(c, 3) for c in ("sse", "sst", "y_sq")}
    fine = {c: rnd(c, 6) for c in ("r2", "smape", "mase", "y_sum")}
    return df.withColumns({**wide, **fine, "mae": rnd("mae", 7)})


@query("fc_9_score_series", f"WITH {SH} SELECT {SCORE_COLUMNS} FROM scores")
def score_series(spark, sf):
    return _scores(I.horizon_scores(spark, sf))


@query("fc_10_forecast_reference", f"""WITH {O.TOTAL_CLEAN}, {O.REGIONS},
tr AS (
  SELECT series_id, avg(CASE WHEN t >= 67 THEN y END) AS m_recent, avg(CASE WHEN t >= 55 AND t < 67 THEN y END) AS m_earlier
  FROM clean GROUP BY 1)
SELECT c.series_id, region, 'seasonal_drift' AS model, CAST(12 AS INTEGER) AS horizon,
       CAST(DATE '2001-07-01' + to_months(CAST(s AS INTEGER)) AS DATE) AS month,
       {r('c.y + (m_recent - m_earlier) / 12 * s')} AS forecast, CAST(NULL AS VARCHAR) AS error
FROM tr JOIN clean c USING (series_id) CROSS JOIN range(1, 13) AS g(s) LEFT JOIN regions USING (series_id)
WHERE c.t = 79 - 12 + (s - 1) % 12""")
def forecast_reference(spark, sf):
    done = backtest.forecast_reference(I.total_arrays(spark, sf), "seasonal_drift", 12, I.CALENDAR.n_months)
    long = done.select("series_id", "model", "horizon", "error", F.posexplode_outer("forecast").alias("s", "forecast"))
    out = long.withColumn("month", I.CALENDAR.month_at(F.col("s") + I.CALENDAR.n_months)).join(
        I.regions(spark, sf).select("series_id", "region"), "series_id", "left")
    return rounded(out.select("series_id", "region", "model", "horizon", "month", "forecast", "error"))


def _direct(spark, sf):
    """SSE of the two simplest models straight from the panel cells."""
    rows = backtest.fold_rows(I.category_arrays(spark, sf), I.folds())
    from panelwright.functions import arrays as A

    last = F.element_at("train", -1)
    n = F.size("train")
    out = rows.where(~A.has_null(F.col("train")) & ~A.has_null(F.col("test"))).select(
        "series_id", "horizon", "fold",
        F.explode(F.create_map(
            F.lit("naive_last"), A.sum_of_squares(F.col("test"), last),
            F.lit("seasonal_naive"), A.total(F.transform(
                "test", lambda v, i: (v - F.get("train", n - 12 + i)) * (v - F.get("train", n - 12 + i)))),
        )).alias("model", "sse"))
    return out


@query("fc_11_direct_sse", f"WITH {S} SELECT model, series_id, fold, {r('sse', 4)} AS sse FROM scores WHERE error IS NULL AND model IN ('naive_last', 'seasonal_naive')")
def direct_sse(spark, sf):
    return rounded(_direct(spark, sf).select("model", "series_id", "fold", "sse"), 4)


for _id, _metric in (("met_1", "mae"), ("met_2", "r2"), ("met_3", "smape"), ("met_4", "mase")):
    query(f"{_id}_{_metric}", f"WITH {S} SELECT model, fold, series_id, {r(_metric)} AS {_metric} FROM scores WHERE error IS NULL")(
        lambda spark, sf, m=_metric: rounded(
            I.scores(spark, sf).where(F.col("error").isNull()).select("model", "fold", "series_id", m)))


@query("met_5_row_metrics", f"WITH {S} SELECT {SCORE_COLUMNS} FROM scores")
def row_metrics(spark, sf):
    return _scores(I.scores(spark, sf))


@query("met_6_refused", f"WITH {S} SELECT model, fold, series_id, error, error IS NOT NULL OR mae IS NULL AS refused FROM scores")
def refused(spark, sf):
    return I.scores(spark, sf).select("model", "fold", "series_id", "error", metrics.refused().alias("refused"))


def summary_sql(keys: str, source: str = "scores") -> str:
    """Summary by ``keys`` (comma separated)."""
    return f"""
pool AS (
  SELECT {keys}, sum(sse) AS sse, sum(sst) + sum(n * pow(y_sum / n - mean, 2)) AS sst FROM (
    SELECT *, sum(y_sum) OVER w / sum(n) OVER w AS mean FROM {source} WHERE error IS NULL AND sse IS NOT NULL
    WINDOW w AS (PARTITION BY {keys})) GROUP BY {keys}),
base AS (
  SELECT {keys}, avg(mae) FILTER (WHERE error IS NULL) AS mae, avg(mase) FILTER (WHERE error IS NULL) AS mase,
         avg(smape) FILTER (WHERE error IS NULL) AS smape,
         count(DISTINCT series_id) FILTER (WHERE error IS NULL AND mae IS NOT NULL) AS n_series,
         count(*) FILTER (WHERE error IS NOT NULL OR mae IS NULL) AS n_refused,
         quantile_cont(r2, 0.5) FILTER (WHERE error IS NULL) AS r2_median
  FROM {source} GROUP BY {keys}),
summary AS (
  SELECT base.*, CASE WHEN pool.sst > 0 THEN 1 - pool.sse / pool.sst END AS r2_pool
  FROM base LEFT JOIN pool USING ({keys}))"""


SUMMARY = f"{r('mae')} AS mae, {r('mase')} AS mase, {r('smape')} AS smape, n_series, n_refused, {r('r2_pool')} AS r2_pool, {r('r2_median')} AS r2_median"


@query("met_7_summarise", f"WITH {S}, {summary_sql('model')} SELECT model, {SUMMARY} FROM summary")
def summarise(spark, sf):
    return rounded(metrics.summarise(I.score_table(spark, sf))).orderBy("mae")


@query("met_8_r2_pool", f"WITH {S}, {summary_sql('model, fold')} SELECT model, fold, {r('r2_pool')} AS r2_pool FROM summary WHERE r2_pool IS NOT NULL")
def r2_pool(spark, sf):
    return rounded(metrics.r2_pool(I.scores(spark, sf), ["model", "fold"]))


@query("met_9_r2_median", f"WITH {S}, {summary_sql('model, fold')} SELECT model, fold, {r('r2_median')} AS r2_median FROM summary")
def r2_median(spark, sf):
    return rounded(metrics.r2_median(I.score_table(spark, sf), ["model", "fold"]))


def gain(reference: str, within: str) -> str:
    over = f"OVER (PARTITION BY {within})" if within else "OVER ()"
    base = f"max(CASE WHEN model = '{reference}' THEN mae END) {over}"
    return f"100 * ({base} - mae) / {base}"


@query("met_10_gains", f"""WITH {S}, {summary_sql('model')}
SELECT model, {r('mae')} AS mae, {r(gain('seasonal_drift', ''))} AS gain_to_reference, {r(gain('naive_last', ''))} AS gain_to_naive FROM summary""")
def gains(spark, sf):
    out = metrics.gains(metrics.summarise(I.score_table(spark, sf), exact_median=False))
    return rounded(out.select("model", "mae", "gain_to_reference", "gain_to_naive"))


@query("met_11_summarise_by_fold", f"""WITH {SH}, {summary_sql('horizon, model, fold, train_end')}
SELECT CAST(horizon AS INTEGER) AS horizon, model, fold, train_end, {SUMMARY}, {r(gain('seasonal_drift', 'horizon, fold'))} AS gain_to_reference,
       {r(gain('naive_last', 'horizon, fold'))} AS gain_to_naive FROM summary""")
def by_fold(spark, sf):
    return rounded(metrics.summarise_horizons(I.horizon_score_table(spark, sf))[0])


@query("met_11_summarise_by_horizon", f"""WITH {SH}, {summary_sql('horizon, model')},
f AS (SELECT horizon, model, count(DISTINCT fold) AS n_folds, count(DISTINCT fold) FILTER (WHERE error IS NULL) AS n_folds_counted FROM scores GROUP BY 1, 2)
SELECT CAST(horizon AS INTEGER) AS horizon, model, {SUMMARY}, {r(gain('seasonal_drift', 'horizon'))} AS gain_to_reference,
       {r(gain('naive_last', 'horizon'))} AS gain_to_naive, n_folds, n_folds_counted FROM summary JOIN f USING (horizon, model)""")
def by_horizon(spark, sf):
    return rounded(metrics.summarise_horizons(I.horizon_score_table(spark, sf))[1])


@query("met_12_step_errors", f"""WITH {FC}
SELECT model, CAST(horizon AS INTEGER) AS horizon, fold, train_end, step, {r('avg(abs(a.y - forecast))')} AS mae, count(a.y) AS n_series
FROM fc JOIN filled a USING (series_id, t) WHERE a.y IS NOT NULL GROUP BY 1, 2, 3, 4, 5""")
def step_errors(spark, sf):
    return rounded(metrics.step_errors(I.points(spark, sf).where(F.col("actual").isNotNull())))


@query("met_13_identical_models", f"""WITH {SH}
SELECT a.model AS model_a, b.model AS model_b, {r('max(abs(a.mae - b.mae))')} AS max_gap, count(*) AS n_pairs, max(abs(a.mae - b.mae)) <= 0.01 AS identical
FROM scores a JOIN scores b ON a.model < b.model AND a.horizon = b.horizon AND a.fold = b.fold AND a.series_id = b.series_id
WHERE a.error IS NULL AND b.error IS NULL GROUP BY 1, 2""")
def identical_models(spark, sf):
    return rounded(metrics.identical_models(I.horizon_scores(spark, sf), 0.01))


def _thinned(scores):
    """One model loses its refusals' neighbours: the rows of one series in five get no score."""
    lost = (F.col("model") == "drift") & (F.pmod(F.xxhash64("fold"), F.lit(1)) == 0) & F.col("series_id").endswith("0|A")
    return scores.withColumn("mae", F.when(~lost, F.col("mae")))


THIN = "(SELECT * REPLACE (CASE WHEN model = 'drift' AND series_id LIKE '%0|A' THEN NULL ELSE mae END AS mae) FROM scores)"


@query("met_14_uneven_pairs", f"""WITH {SH}, ok AS (SELECT * FROM {THIN} WHERE error IS NULL AND mae IS NOT NULL),
c AS (SELECT horizon, model, count(*) AS n_pairs FROM ok GROUP BY 1, 2),
k AS (SELECT horizon, count(*) AS n_common FROM (SELECT horizon, series_id, fold FROM ok GROUP BY 1, 2, 3 HAVING count(DISTINCT model) = 4) GROUP BY 1)
SELECT CAST(horizon AS INTEGER) AS horizon, model, n_pairs, n_common, bool_or(n_pairs <> n_common) OVER (PARTITION BY horizon) AS uneven FROM c JOIN k USING (horizon)""")
def uneven_pairs(spark, sf):
    return metrics.uneven_pairs(_thinned(I.horizon_score_table(spark, sf)))


@query("met_15_uneven_series", f"""WITH {S}, x AS (SELECT model, count(DISTINCT series_id) AS n_series FROM scores WHERE model <> 'theta' AND NOT (model = 'drift' AND series_id LIKE '%0|A') GROUP BY 1)
SELECT model, n_series FROM x WHERE (SELECT count(DISTINCT n_series) FROM x) > 1""")
def uneven_series(spark, sf):
    lost = (F.col("model") == "drift") & F.col("series_id").endswith("0|A")
    return metrics.uneven_series(I.scores(spark, sf).where(~lost))


FOLD_R2 = summary_sql("horizon, fold, model")


@query("met_16_fold_r2", f"WITH {SH}, {FOLD_R2} SELECT CAST(horizon AS INTEGER) AS horizon, fold, model, {r('mae')} AS mae, {r('r2_pool')} AS r2_pool, {r('r2_median')} AS r2_median FROM summary")
def fold_r2(spark, sf):
    return rounded(compare.fold_r2(I.horizon_score_table(spark, sf)))


@query("met_16_both_ways_lead", f"""WITH {S}, {FOLD_R2}, x AS (
  SELECT *, r2_pool = max(r2_pool) OVER w AND r2_median = max(r2_median) OVER w AS leads FROM summary WINDOW w AS (PARTITION BY horizon, fold))
SELECT CAST(horizon AS INTEGER) AS horizon, fold, max(CASE WHEN leads THEN model END) AS leader FROM x GROUP BY 1, 2""")
def both_ways(spark, sf):
    return compare.both_ways_lead(compare.fold_r2(I.score_table(spark, sf)))


@query("met_17_fold_ranks", f"""WITH {SH}, m AS (SELECT horizon, fold, model, avg(mae) AS mae FROM scores WHERE error IS NULL GROUP BY 1, 2, 3),
p AS (SELECT *, rank() OVER (PARTITION BY horizon, fold ORDER BY mae) AS place FROM m)
SELECT CAST(horizon AS INTEGER) AS horizon, fold, model, {r('mae')} AS mae, CAST(place AS INTEGER) AS place,
       CAST(place - lag(place) OVER (PARTITION BY horizon, model ORDER BY fold) AS INTEGER) AS change FROM p""")
def fold_ranks(spark, sf):
    return rounded(compare.fold_ranks(I.horizon_scores(spark, sf)))


# t quantiles at 0.975, from a printed table
T975 = "CASE n_folds WHEN 2 THEN 12.706204736432095 WHEN 3 THEN 4.302652729749464 WHEN 9 THEN 2.306004135204166 END"


def paired_sql(source: str, reference: str) -> str:
    return f"""
x AS (
  SELECT a.horizon, a.fold, a.series_id, a.model, a.mae, b.mae AS mae_ref, a.mae - b.mae AS diff
  FROM {source} a JOIN {source} b ON b.model = '{reference}' AND a.horizon = b.horizon AND a.fold = b.fold AND a.series_id = b.series_id
  WHERE a.error IS NULL AND b.error IS NULL AND a.model <> '{reference}' AND a.mae IS NOT NULL AND b.mae IS NOT NULL),
pf AS (SELECT horizon, model, fold, avg(diff) AS d, avg(mae) < avg(mae_ref) AS won FROM x GROUP BY 1, 2, 3),
fo AS (SELECT horizon, model, count(*) AS n_folds, avg(d) AS fold_diff_mean, stddev_samp(d) AS fsd, count(*) FILTER (WHERE won) AS folds_won FROM pf GROUP BY 1, 2),
pa AS (SELECT horizon, model, count(*) AS n_pairs, count(DISTINCT series_id) AS n_series, avg(mae) AS mae, avg(mae_ref) AS mae_ref,
  avg(diff) AS diff_mean, stddev_samp(diff) AS psd, avg(CASE WHEN round(diff, 9) < 0 THEN 1.0 ELSE 0.0 END) AS pairs_won_share FROM x GROUP BY 1, 2),
paired AS (SELECT *, CASE WHEN n_folds >= 2 THEN {T975} * fsd / sqrt(n_folds) END AS fm FROM pa JOIN fo USING (horizon, model))"""


PAIRED = f"""CAST(horizon AS INTEGER) AS horizon, model, n_pairs, n_series, {r('mae')} AS mae, {r('mae_ref')} AS mae_ref, {r('diff_mean')} AS diff_mean,
  {r('pairs_won_share')} AS pairs_won_share, n_folds, {r('fold_diff_mean')} AS fold_diff_mean, folds_won,
  {r('diff_mean - 1.96 * psd / sqrt(n_pairs)')} AS pair_ci_low, {r('diff_mean + 1.96 * psd / sqrt(n_pairs)')} AS pair_ci_high,
  {r('fold_diff_mean - fm')} AS fold_ci_low, {r('fold_diff_mean + fm')} AS fold_ci_high"""


@query("met_18_paired_vs_reference", f"WITH {SH}, {paired_sql('scores', 'seasonal_drift')} SELECT {PAIRED} FROM paired")
def paired(spark, sf):
    return rounded(compare.paired_vs_reference(I.horizon_score_table(spark, sf), "seasonal_drift"))


@query("met_19_paired_sources", f"""WITH {SH}, ok AS (SELECT * FROM {THIN} WHERE error IS NULL AND mae IS NOT NULL),
common AS (SELECT horizon, fold, series_id FROM ok GROUP BY 1, 2, 3 HAVING count(DISTINCT model) = 4),
okc AS (SELECT * FROM ok SEMI JOIN common USING (horizon, fold, series_id)), {paired_sql('okc', 'naive_last')} SELECT {PAIRED} FROM paired""")
def paired_sources(spark, sf):
    return rounded(compare.paired_vs_reference(_thinned(I.horizon_score_table(spark, sf)), "naive_last", common_only=True))


# at this many pairs the t quantile needs the routine, so the pair interval is left to the tests
@query("met_20_pair_stats", f"""WITH {SH}, sub AS (SELECT * FROM scores WHERE series_id LIKE '%|A'), {paired_sql('sub', 'naive_last')},
im AS (SELECT horizon, avg(CASE WHEN a < b THEN 1.0 ELSE 0.0 END) AS share_series_improved FROM
  (SELECT horizon, series_id, avg(mae) AS a, avg(mae_ref) AS b FROM x WHERE model = 'drift' GROUP BY 1, 2) GROUP BY 1)
SELECT CAST(horizon AS INTEGER) AS horizon, n_pairs, n_series, n_folds, {r('mae')} AS mae, {r('mae_ref')} AS mae_ref, {r('diff_mean')} AS diff_mean,
  {r('fold_diff_mean')} AS fold_diff_mean, {r('fold_diff_mean - fm')} AS fold_ci_low, {r('fold_diff_mean + fm')} AS fold_ci_high,
  {r('share_series_improved')} AS share_series_improved, folds_won FROM paired JOIN im USING (horizon) WHERE model = 'drift'""")
def pair_stats(spark, sf):
    scores = I.horizon_score_table(spark, sf)
    subset = I.category_panel(spark, sf).where(F.col("category") == "A").select("series_id").distinct()
    return rounded(compare.pair_stats(scores, "naive_last", "drift", subset).drop("pair_ci_low", "pair_ci_high"))


@query("met_21_mae_aggregation_check", f"""WITH {SH}, f AS (SELECT horizon, model, fold, avg(mae) AS m, sum(mae) AS s, count(*) AS k FROM scores WHERE error IS NULL GROUP BY 1, 2, 3)
SELECT CAST(horizon AS INTEGER) AS horizon, model, {r('sum(s) / sum(k)')} AS over_pairs, {r('avg(m)')} AS over_folds FROM f GROUP BY 1, 2""")
def mae_aggregation(spark, sf):
    return rounded(compare.mae_aggregation_check(I.horizon_scores(spark, sf)))


@query("met_22_flat_windows", f"""WITH {S}, c AS (SELECT *, sqrt(sst / n) / abs(y_sum / n) AS cv FROM scores WHERE error IS NULL AND r2 IS NOT NULL),
q AS (SELECT model, quantile_cont(cv, 0.1) AS cut FROM c GROUP BY 1)
SELECT model, count(*) FILTER (WHERE cv <= cut) AS n_flat, {r('avg(r2) FILTER (WHERE cv <= cut)', 5)} AS r2_flat,
       {r('avg(r2) FILTER (WHERE cv > cut)')} AS r2_rest, {r('sum(r2) FILTER (WHERE cv <= cut) / sum(r2)')} AS share_of_sum FROM c JOIN q USING (model) GROUP BY 1""")
def flat_windows(spark, sf):
    return rounded(compare.flat_windows(I.score_table(spark, sf)), r2_flat=5)


DECOMP = """
pts AS (
  SELECT fc.*, a.y AS actual, b.y AS base FROM fc JOIN filled a USING (series_id, t)
  JOIN filled b ON b.series_id = fc.series_id AND b.t = fc.train_end - 1 WHERE a.y IS NOT NULL),
meds AS (SELECT model, horizon, fold, step, quantile_cont(forecast / base, 0.5) AS mp, quantile_cont(actual / base, 0.5) AS ma FROM pts GROUP BY 1, 2, 3, 4),
decomp AS (
  SELECT model, horizon, fold, avg(abs(forecast - actual)) AS mae, avg(abs(forecast / mp * ma - actual)) AS spread
  FROM pts JOIN meds USING (model, horizon, fold, step) GROUP BY 1, 2, 3)"""


def _base(spark, sf):
    rows = backtest.fold_rows(I.stored_category_arrays(spark, sf), I.horizon_folds())
    return rows.select("series_id", "horizon", "fold", F.element_at("train", -1).alias("base")).where(F.col("base").isNotNull())


def _decomposed(spark, sf):
    """The series are made once, for the points and for the last months; both are read several times."""
    points = cut_lineage(I.points(spark, sf, I.stored_category_arrays(spark, sf)), "points")
    return compare.error_decomposition(points, _base(spark, sf))


@query("met_23_error_decomposition", f"""WITH {FC}, {DECOMP}
SELECT model, CAST(horizon AS INTEGER) AS horizon, fold, {r('mae')} AS mae, {r('spread')} AS spread, {r('mae - spread')} AS bias, {r('(mae - spread) / mae')} AS bias_share FROM decomp""")
def decomposition(spark, sf):
    return rounded(_decomposed(spark, sf))


@query("met_24_decomposition_means", f"""WITH {FC}, {DECOMP}
SELECT model, CAST(horizon AS INTEGER) AS horizon, {r('avg(mae)')} AS mae, {r('avg(spread)')} AS spread, {r('avg(mae - spread)')} AS bias FROM decomp GROUP BY 1, 2""")
def decomposition_means(spark, sf):
    return rounded(compare.decomposition_means(_decomposed(spark, sf)))


@query("met_25_compare_realisations", f"""WITH {S},
b AS (SELECT model, horizon, fold, series_id, CASE WHEN series_id LIKE '%0|A' THEN mae + 1 ELSE mae END AS mae FROM scores WHERE error IS NULL)
SELECT model, CAST(horizon AS INTEGER) AS horizon, fold, count(*) AS n_rows, {r('max(abs(a.mae - b.mae))')} AS max_gap, {r('avg(CASE WHEN a.mae = b.mae THEN 1.0 ELSE 0.0 END)')} AS share_equal
FROM scores a JOIN b USING (model, horizon, fold, series_id) WHERE a.error IS NULL GROUP BY 1, 2, 3""")
def realisations(spark, sf):
    first = I.score_table(spark, sf).where(F.col("error").isNull())
    second = first.withColumn("mae", F.when(F.col("series_id").endswith("0|A"), F.col("mae") + 1).otherwise(F.col("mae")))
    return rounded(compare.compare_realisations(first, second))


def _old_rows(spark, sf):
    return I.score_table(spark, sf).select("model", "horizon", "fold", "series_id", "mae", "r2", "error")


def _targets(spark, sf):
    from panelwright.functions import arrays as A

    rows = backtest.fold_rows(I.category_arrays(spark, sf), I.folds())
    y = F.col("test")
    return rows.where(~A.has_null(y)).select(
        "series_id", "horizon", "fold", metrics.sst(y).alias("sst"), F.size(y).alias("n"), A.total(y).alias("y_sum"),
        A.sum_of_squares(y).alias("y_sq"))


@query("met_26_backfill_parts", f"""WITH {S}, v AS (
  SELECT series_id, horizon, fold, var_pop(y) * count(*) AS sst, CAST(count(*) AS INTEGER) AS n, sum(y) AS y_sum, sum(y * y) AS y_sq, count(y) = count(*) AS ok
  FROM folds JOIN filled ON t >= train_end AND t < train_end + horizon GROUP BY 1, 2, 3)
SELECT model, fold, series_id, {r('mae', 7)} AS mae, {r('(1 - r2) * v.sst', 3)} AS sse, {r('v.sst', 3)} AS sst, v.n, {r('v.y_sum')} AS y_sum, {r('v.y_sq', 3)} AS y_sq
FROM scores LEFT JOIN (SELECT * FROM v WHERE ok) v USING (series_id, horizon, fold)""")
def backfill(spark, sf):
    out = compare.backfill_parts(_old_rows(spark, sf), _targets(spark, sf))
    return _scores(out.withColumn("smape", F.lit(None).cast("double")).withColumn("mase", F.lit(None).cast("double"))).select(
        "model", "fold", "series_id", "mae", "sse", "sst", "n", "y_sum", "y_sq")


@query("met_27_check_known", f"""WITH {S}
SELECT model, count(*) AS n_rows, CAST(TRUE AS BOOLEAN) AS within FROM scores WHERE error IS NULL AND model IN ('naive_last', 'seasonal_naive') GROUP BY 1""")
def check_known(spark, sf):
    derived = compare.backfill_parts(_old_rows(spark, sf), _targets(spark, sf)).where(F.col("error").isNull())
    out = compare.check_known(derived, _direct(spark, sf))
    return out.select("model", "n_rows", (F.col("max_deviation") <= 1e-6).alias("within"))


@query("met_28_check_invariants", f"""WITH {S}
SELECT CASE g.i WHEN 0 THEN 'lost' ELSE 'gained' END AS side, count(*) AS n FROM scores CROSS JOIN range(0, 2) AS g(i)
WHERE error IS NULL AND series_id LIKE '%0|A' AND model = 'drift' GROUP BY 1""")
def invariants(spark, sf):
    before = _old_rows(spark, sf)
    after = compare.backfill_parts(before, _targets(spark, sf))
    touched = (F.col("model") == "drift") & F.col("series_id").endswith("0|A") & F.col("error").isNull()
    return compare.changed_rows(before, after.withColumn("mae", F.when(touched, F.col("mae") + 1).otherwise(F.col("mae"))))


@query("met_29_pool_variance_split", f"""WITH {S}, m AS (SELECT *, sum(y_sum) OVER w / sum(n) OVER w AS mean FROM scores WHERE error IS NULL WINDOW w AS (PARTITION BY model)),
p AS (SELECT model, sum(sst) AS i, sum(n * pow(y_sum / n - mean, 2)) AS b FROM m GROUP BY 1)
SELECT model, {r('b / (i + b)')} AS share_between FROM p""")
def variance_split(spark, sf):
    return rounded(compare.pool_variance_split(I.score_table(spark, sf)).select("model", "share_between"))


EVENTS = {"spring": 71, "summer": 77}


@query("met_30_events_in_folds", f"""WITH {SH}, ev(event, et) AS (VALUES ('spring', 71), ('summer', 77)),
m AS (SELECT horizon, fold, train_end, avg(mae) AS mae FROM scores WHERE model = 'naive_last' AND error IS NULL GROUP BY 1, 2, 3),
x AS (SELECT m.*, coalesce(string_agg(event, ',' ORDER BY et), '') AS events FROM m LEFT JOIN ev ON et >= train_end AND et < train_end + horizon GROUP BY ALL)
SELECT CAST(horizon AS INTEGER) AS horizon, fold, train_end, {r('mae')} AS mae, events,
       {r("avg(CASE WHEN events = '' THEN mae END) OVER (PARTITION BY horizon)")} AS mae_quiet_folds FROM x""")
def events_in_folds(spark, sf):
    return rounded(compare.events_in_folds(I.horizon_scores(spark, sf), I.horizon_folds(), EVENTS))


@query("met_31_top_indistinguishable", f"""WITH {SH},
bf AS (SELECT horizon, model, fold, avg(mae) AS mae FROM scores WHERE error IS NULL GROUP BY 1, 2, 3),
pl AS (SELECT horizon, model, row_number() OVER (PARTITION BY horizon ORDER BY avg(mae), model) AS place, avg(mae) AS mm FROM bf GROUP BY 1, 2),
d AS (SELECT bf.horizon, bf.model, pl.place, bf.mae - b.mae AS diff FROM bf JOIN pl USING (horizon, model)
  JOIN pl p1 ON p1.horizon = bf.horizon AND p1.place = 1 JOIN bf b ON b.horizon = bf.horizon AND b.model = p1.model AND b.fold = bf.fold WHERE pl.place BETWEEN 2 AND 3),
st AS (SELECT horizon, model, place, avg(diff) AS diff_mean, stddev_samp(diff) AS sd, count(*) AS n_folds, count(*) FILTER (WHERE diff < 0) AS folds_ahead FROM d GROUP BY 1, 2, 3),
ci AS (SELECT *, CASE WHEN n_folds >= 2 THEN {T975} * sd / sqrt(n_folds) END AS h FROM st)
SELECT CAST(horizon AS INTEGER) AS horizon, model, CAST(place AS INTEGER) AS place, {r('diff_mean')} AS diff_mean, n_folds, folds_ahead,
       {r('diff_mean - h')} AS ci_low, {r('diff_mean + h')} AS ci_high, diff_mean - h <= 0 AND diff_mean + h >= 0 AS same FROM ci""")
def top(spark, sf):
    return rounded(compare.top_indistinguishable(I.horizon_score_table(spark, sf), 3))


BLEND = """
cells AS (
  SELECT horizon, fold, train_end, series_id, step, t, max(CASE WHEN model = 'naive_last' THEN forecast END) AS a,
         max(CASE WHEN model = 'seasonal_drift' THEN forecast END) AS b FROM fc GROUP BY 1, 2, 3, 4, 5, 6),
act AS (SELECT cells.*, f.y AS actual FROM cells JOIN filled f USING (series_id, t) WHERE f.y IS NOT NULL),
cand AS (
  SELECT f.horizon, f.fold, i * 0.05 AS w, avg(abs(actual - (i * 0.05 * a + (1 - i * 0.05) * b))) AS mae
  FROM (SELECT DISTINCT horizon, fold FROM act) f JOIN act ON act.horizon = f.horizon AND act.fold < f.fold CROSS JOIN range(0, 21) AS g(i) GROUP BY 1, 2, 3),
best AS (SELECT horizon, fold, w, mae FROM cand QUALIFY row_number() OVER (PARTITION BY horizon, fold ORDER BY mae, w) = 1)"""


@query("gb_13_blend_weights", f"""WITH {FC}, {BLEND}
SELECT CAST(horizon AS INTEGER) AS horizon, fold, {r('CAST(w AS DOUBLE)', 2)} AS weight, {r('mae')} AS mae_before FROM best""")
def blend_weights(spark, sf):
    return rounded(compare.blend_weights(I.point_table(spark, sf), "naive_last", "seasonal_drift"))


@query("gb_13_blend", f"""WITH {FC}, {BLEND}
SELECT CAST(horizon AS INTEGER) AS horizon, fold, step, {r('avg(abs(actual - (CAST(w AS DOUBLE) * a + (1 - CAST(w AS DOUBLE)) * b)))')} AS mae, count(*) AS n
FROM act JOIN best USING (horizon, fold) GROUP BY 1, 2, 3""")
def blend(spark, sf):
    points = I.point_table(spark, sf)
    mixed = compare.blend(points, compare.blend_weights(points, "naive_last", "seasonal_drift"), "naive_last", "seasonal_drift")
    return rounded(mixed.where(F.col("actual").isNotNull()).groupBy("horizon", "fold", "step").agg(
        F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("mae"), F.count(F.lit(1)).alias("n")))


# --- guards, merges, snapshots ---------------------------------------------------------

@query("fold_6_panel_differences", f"""WITH {SH}, fresh AS (SELECT * FROM scores WHERE series_id NOT LIKE '%0|A' AND NOT (horizon = 3 AND fold = 2))
SELECT 'series only stored' AS problem, count(*) AS n FROM (SELECT DISTINCT series_id FROM scores EXCEPT SELECT series_id FROM fresh)
UNION ALL SELECT 'other folds at horizon 3', 1""")
def panel_differences(spark, sf):
    stored = I.horizon_score_table(spark, sf)
    fresh = stored.where(~F.col("series_id").endswith("0|A") & ~((F.col("horizon") == 3) & (F.col("fold") == 2)))
    return guard.panel_differences(stored, fresh)


def _batch(scores, model):
    return scores.where(F.col("model") == model).withColumn("mae", F.col("mae") + 1)


@query("snk_3_upsert_by_model", f"""WITH {S}
SELECT model, fold, series_id, {r("CASE WHEN model = 'drift' THEN mae + 1 ELSE mae END")} AS mae, error FROM scores""")
def upsert_model(spark, sf):
    """A batch merged into the stored table: its folders are written, checked and made current at once."""
    stored = I.score_table(spark, sf)
    table = sinks.ResultTable(spark, work_path(spark, "results"))
    table.merge(stored)
    out = table.merge(_batch(stored, "drift"))
    return rounded(out.select("model", "fold", "series_id", "mae", "error"))


@query("snk_4_upsert_by_model_horizon", f"""WITH {SH}
SELECT model, CAST(horizon AS INTEGER) AS horizon, fold, series_id, {r("CASE WHEN model = 'drift' AND horizon = 3 THEN mae + 1 ELSE mae END", 7)} AS mae
FROM scores WHERE NOT (model = 'naive_last' AND horizon = 12)""")
def upsert_horizon(spark, sf):
    stored = I.horizon_score_table(spark, sf)
    fresh = _batch(stored, "drift").where(F.col("horizon") == 3)
    cleared = stored.select("model", "horizon").distinct().where((F.col("model") == "naive_last") & (F.col("horizon") == 12))
    table = sinks.ResultTable(spark, work_path(spark, "results"), ["model", "horizon"])
    table.merge(stored)
    out = table.merge(fresh, explicit=cleared)
    return rounded(out.select("model", "horizon", "fold", "series_id", "mae"), 7)


@query("snk_5_archive_replaced", f"WITH {S} SELECT model, fold, series_id, {r('mae')} AS mae, error FROM scores WHERE model = 'drift'")
def archive(spark, sf):
    stored = I.score_table(spark, sf)
    target = sinks.archive_replaced(stored, _batch(stored, "drift"), ["model"], work_path(spark, "archive"))
    return rounded(spark.read.parquet(target).select("model", "fold", "series_id", "mae", "error"))


@query("snk_6_export_snapshot", f"WITH {S} SELECT CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_extra, count(*) AS n_source, count(*) AS n_copy FROM scores")
def snapshot(spark, sf):
    return sinks.write_and_verify(I.score_table(spark, sf), work_path(spark, "snapshot"))


@query("snk_1_write_features", f"WITH {O.TOTAL_CLEAN} SELECT series_id, t, {r('y')} AS y, filled FROM clean")
def write_features(spark, sf):
    path = work_path(spark, "features")
    sinks.write_features(I.total_clean(spark, sf), path)
    return rounded(spark.read.parquet(path).select("series_id", "t", "y", "filled"))


@query("snk_2_write_versioned", f"WITH {S} SELECT 'v2' AS protocol, model, fold, series_id, n, error FROM scores")
def write_versioned(spark, sf):
    path = work_path(spark, "versioned")
    sinks.write_versioned(I.scores(spark, sf), path, "v2")
    return spark.read.parquet(path).select("protocol", "model", "fold", "series_id", "n", "error")


@query("src_8_read_results", f"WITH {S} SELECT model, fold, count(*) AS n FROM scores GROUP BY 1, 2")
def read_results(spark, sf):
    path = work_path(spark, "results")
    I.scores(spark, sf).write.parquet(path + "-snapshot")
    found = readers.read_results(spark, path, path + "-snapshot")
    return found.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"))
