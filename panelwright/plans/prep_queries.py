"""Registered queries: panel preparation, regions, folds."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import prep, regions as geo
from panelwright.plans import inputs as I, oracle as O
from panelwright.plans.oracle import r
from panelwright.plans.registry import query
from panelwright.plans.rounding import rnd
from panelwright.protocol import dense_origins, fold_array
from panelwright.sources import readers

KEY = ["series_id", "category"]
DENSE = O.CATEGORY + "," + O.cleaned("catpanel", "category")


def _dense(spark, sf):
    return prep.densify(I.category_panel(spark, sf), KEY, I.CALENDAR)


def _profile(spark, sf):
    return prep.series_profile(_dense(spark, sf), KEY, I.CALENDAR)


def _round(df, *columns, digits=6):
    return df.withColumns({c: rnd(c, digits) for c in columns})


# --- entities -------------------------------------------------------------------------

# Names repeat: twenty names over all suppliers, blocks of rising months per supplier and
# flag. The row position is spelled out, as a file would give it.
NAMED = O.SPENDING + """,
named AS (
  SELECT 'M' || CAST(series_id AS BIGINT) % 20 AS mo, category, month, value, series_id AS supplier,
         CAST(series_id AS BIGINT) * 1000 + date_diff('month', DATE '1995-01-01', month) AS pos
  FROM spending),
starts AS (
  SELECT *, CASE WHEN lag(month) OVER w IS NULL OR month <= lag(month) OVER w THEN 1 ELSE 0 END AS s
  FROM named WINDOW w AS (PARTITION BY mo, category ORDER BY pos)),
numbered AS (
  SELECT *, CAST(sum(s) OVER (PARTITION BY mo, category ORDER BY pos) AS INTEGER) AS entity_no FROM starts),
entities AS (
  SELECT *, CASE WHEN max(entity_no) OVER (PARTITION BY mo, category) > 1
                 THEN mo || ' #' || entity_no ELSE mo END AS series_id FROM numbered)"""


def named_panel(spark, sf):
    supplier = F.col("series_id").cast("bigint")
    return I.spending(spark, sf).select(
        F.concat(F.lit("M"), (supplier % 20).cast("string")).alias("mo"),
        "category",
        "month",
        "value",
        F.col("series_id").alias("supplier"),
        (supplier * 1000 + I.CALENDAR.position(F.col("month"))).alias("pos"),
    )


@query("prep_1_rebuild_entities", f"WITH {NAMED} SELECT mo, category, month, entity_no, series_id, {r('value')} AS value FROM entities")
def rebuild_entities(spark, sf):
    out = prep.rebuild_entities(named_panel(spark, sf), "pos", block_rows=5000)
    return out.select("mo", "category", "month", "entity_no", "series_id", rnd("value", 6).alias("value"))


@query("prep_2_densify", f"WITH {DENSE} SELECT series_id, category, t, month, {r('y')} AS y FROM dense")
def densify(spark, sf):
    return _round(_dense(spark, sf), "y").select("series_id", "category", "t", "month", "y")


@query("prep_3_max_gap_run", f"WITH {DENSE} SELECT series_id, category, n_known, n_missing, max_gap FROM prof")
def max_gap_run(spark, sf):
    return _profile(spark, sf).select("series_id", "category", "n_known", "n_missing", "max_gap")


@query("prep_4_keep_rule", f"WITH {DENSE} SELECT series_id, category, complete, edges, kept FROM prof")
def keep_rule(spark, sf):
    return prep.keep_flags(_profile(spark, sf), I.CALENDAR).select("series_id", "category", "complete", "edges", "kept")


@query("prep_5_interpolate_inside", f"WITH {DENSE} SELECT series_id, category, t, {r('y')} AS y, filled FROM filled")
def interpolate_inside(spark, sf):
    out = prep.interpolate_inside(_dense(spark, sf), KEY)
    return _round(out, "y").select("series_id", "category", "t", "y", "filled")


@query("prep_5_clean_panel", f"WITH {DENSE} SELECT series_id, category, t, month, {r('y')} AS y, filled FROM clean")
def clean_panel(spark, sf):
    return _round(prep.clean_panel(I.category_panel(spark, sf), KEY, I.CALENDAR), "y")


@query("prep_6_panel_report", f"""WITH {DENSE},
src AS (SELECT count(*) AS n_rows, count(DISTINCT series_id) AS n_mo, count(DISTINCT category) AS n_categories FROM spending)
SELECT n_rows, n_mo, n_categories, CAST(79 AS BIGINT) AS n_periods, count(*) AS n_series_total,
       count(*) FILTER (WHERE complete) AS n_series_complete,
       count(*) FILTER (WHERE kept AND NOT complete) AS n_series_filled,
       count(*) FILTER (WHERE NOT kept) AS n_series_dropped, CAST(sum(n_missing) AS BIGINT) AS n_cells_missing
FROM src CROSS JOIN prof WHERE category = 'A' GROUP BY ALL""")
def panel_report(spark, sf):
    raw = I.spending(spark, sf).withColumnRenamed("series_id", "mo")
    return prep.panel_report(raw, _profile(spark, sf), I.CALENDAR, "A")


STRATA = O.TOTAL_CLEAN + """,
levels AS (SELECT series_id, avg(y) AS level FROM clean GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY level) - 1 AS rank0, count(*) OVER () AS n FROM levels)"""


def _levels(spark, sf):
    return I.total_clean(spark, sf).groupBy("series_id").agg(F.avg("y").alias("level"))


@query("prep_7_strata", f"WITH {STRATA} SELECT series_id, CAST(floor(rank0 * 10 / n) AS INTEGER) AS stratum FROM ranked")
def strata(spark, sf):
    return prep.stratified_sample(_levels(spark, sf), "series_id", "level", None, seed=20260919).select("series_id", "stratum")


@query("prep_7_stratified_sample", f"""WITH {STRATA},
s AS (SELECT CAST(floor(rank0 * 10 / n) AS INTEGER) AS stratum, n FROM ranked)
SELECT stratum, CAST(count(*) AS BIGINT) AS n_series, CAST(least(4, count(*)) AS BIGINT) AS n_picked FROM s GROUP BY 1""")
def stratified_sample(spark, sf):
    levels = _levels(spark, sf)
    every = prep.stratified_sample(levels, "series_id", "level", None, seed=20260919)
    picked = prep.stratified_sample(levels, "series_id", "level", 40, seed=20260919).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_picked"))
    return every.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_series")).join(picked, "stratum", "left")


@query("prep_8_bench_sample")
def bench_sample(spark, sf):
    return prep.bench_sample(I.total_arrays(spark, sf).select("series_id"), "series_id", 60, 20260920)


@query("prep_9_classify_dropped", f"""WITH {DENSE}
SELECT series_id, category,
  CASE WHEN last_t < 78 AND first_t > 0 THEN 'middle only' WHEN last_t < 78 THEN 'ends early'
       WHEN first_t > 0 THEN 'starts late' ELSE 'long gap' END AS reason,
  CASE WHEN last_t < 78 THEN CAST(DATE '1995-01-01' + to_months(last_t) AS DATE)
       WHEN first_t > 0 THEN CAST(DATE '1995-01-01' + to_months(first_t) AS DATE) END AS at_month,
  n_known, max_gap FROM prof WHERE NOT kept""")
def classify_dropped(spark, sf):
    out = prep.classify_dropped(_profile(spark, sf), I.CALENDAR)
    return out.select("series_id", "category", "reason", "at_month", "n_known", "max_gap")


@query("prep_10_interpolated_in_test", f"""WITH {DENSE}, {O.FOLDSH}
SELECT CAST(horizon AS INTEGER) AS horizon, fold, count(*) AS n_cells, count(DISTINCT series_id) AS n_series
FROM folds JOIN clean ON filled AND t >= train_end AND t < train_end + horizon GROUP BY 1, 2""")
def interpolated_in_test(spark, sf):
    clean = prep.clean_panel(I.category_panel(spark, sf), KEY, I.CALENDAR)
    return prep.interpolated_in_test(clean, I.horizon_folds())


@query("prep_11_drop_share_by_region", f"""WITH {DENSE}, {O.REGIONS}
SELECT region, {r('avg(CASE WHEN kept THEN 0.0 ELSE 1.0 END)')} AS drop_share, count(*) AS n_series
FROM prof JOIN regions ON split_part(prof.series_id, '|', 1) = regions.series_id
GROUP BY 1 HAVING avg(CASE WHEN kept THEN 0.0 ELSE 1.0 END) > 0.3""")
def drop_share_by_region(spark, sf):
    flags = prep.keep_flags(_profile(spark, sf), I.CALENDAR).withColumn(
        "series_id", F.element_at(F.split("series_id", r"\|"), 1))
    joined = flags.join(I.regions(spark, sf), "series_id")
    return _round(prep.drop_share_by_region(joined), "drop_share")


# --- names and regions ----------------------------------------------------------------

@query("prep_12_normalise_name", """
SELECT p_partkey, trim(regexp_replace('  ' || p_name || '   ' || p_brand || ' ', '\\s+', ' ', 'g')) AS name FROM part""")
def normalise_name(spark, sf):
    messy = F.concat(F.lit("  "), "p_name", F.lit("   "), "p_brand", F.lit(" "))
    return I.table(spark, sf, "part").select("p_partkey", readers.normalise_name(messy).alias("name"))


@query("prep_13_homonyms", f"""WITH {NAMED},
s AS (SELECT DISTINCT series_id FROM entities)
SELECT split_part(series_id, ' #', 1) AS mo, count(*) AS n_series,
       count(*) FILTER (WHERE series_id LIKE '% #%') AS n_marked FROM s GROUP BY 1 HAVING count(*) > 1""")
def homonyms(spark, sf):
    entities = prep.rebuild_entities(named_panel(spark, sf), "pos", block_rows=5000)
    return prep.homonyms(entities.select("series_id").distinct())


# Districts are parts: brand and name repeat, so some keys are homonyms. Each part has two
# versions of its territory; the district type alternates.
DISTRICTS = """
districts AS (
  SELECT p_name || ' ' || p_brand || '  ' ||
           CASE WHEN p_size % 2 = 0 THEN 'муниципальный район' ELSE 'муниципальный округ' END AS municipal_district_name,
         CAST(2015 + p_size % 9 + v * 3 AS VARCHAR) AS year_from, CAST(2018 + p_size % 9 + v * 4 AS VARCHAR) AS year_to,
         p_partkey AS territory_id, p_type AS region_name, CAST(p_size AS VARCHAR) AS region_code,
         CAST(p_partkey * 10 + v AS VARCHAR) AS oktmo, p_brand AS municipal_district_type
  FROM part CROSS JOIN range(0, 2) AS g(v)),
dictionary AS (
  SELECT *, trim(regexp_replace(municipal_district_name, '\\s+', ' ', 'g')) AS key FROM districts
  WHERE CAST(year_from AS INTEGER) <= 2024 AND CAST(year_to AS INTEGER) >= 2023),
ents AS (
  SELECT p_partkey AS entity, ' ' || p_name || '  ' || p_brand || ' ' ||
         CASE WHEN p_size % 3 = 0 THEN 'муниципальный район' ELSE 'муниципальный округ' END AS mo FROM part),
counts AS (SELECT key, count(DISTINCT territory_id) AS c FROM dictionary GROUP BY 1),
lookup AS (
  SELECT d.* FROM dictionary d JOIN counts USING (key) WHERE c = 1
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY CAST(year_to AS INTEGER) DESC) = 1),
keyed AS (SELECT *, trim(regexp_replace(mo, '\\s+', ' ', 'g')) AS key FROM ents),
attached AS (
  SELECT k.entity, k.mo, coalesce(c.c, 0) AS n_candidates,
         coalesce(a.region_name, b.region_name) AS region_name, coalesce(a.oktmo, b.oktmo) AS oktmo,
         coalesce(a.territory_id, b.territory_id) AS territory_id
  FROM keyed k LEFT JOIN counts c USING (key) LEFT JOIN lookup a ON a.key = k.key
  LEFT JOIN lookup b ON a.key IS NULL AND b.key = replace(k.key, 'муниципальный округ', 'муниципальный район'))"""


def districts(spark, sf):
    part = I.table(spark, sf, "part").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    kind = F.when(F.col("p_size") % 2 == 0, geo.RETYPE_TO).otherwise(geo.RETYPE_FROM)
    year = F.col("p_size") % 9
    return part.select(
        F.concat("p_name", F.lit(" "), "p_brand", F.lit("  "), kind).alias("municipal_district_name"),
        (2015 + year + F.col("v") * 3).cast("string").alias("year_from"),
        (2018 + year + F.col("v") * 4).cast("string").alias("year_to"),
        F.col("p_partkey").alias("territory_id"),
        F.col("p_type").alias("region_name"),
        F.col("p_size").cast("string").alias("region_code"),
        (F.col("p_partkey") * 10 + F.col("v")).cast("string").alias("oktmo"),
        F.col("p_brand").alias("municipal_district_type"),
    )


def entity_names(spark, sf):
    kind = F.when(F.col("p_size") % 3 == 0, geo.RETYPE_TO).otherwise(geo.RETYPE_FROM)
    return I.table(spark, sf, "part").select(
        F.col("p_partkey").alias("entity"),
        F.concat(F.lit(" "), "p_name", F.lit("  "), "p_brand", F.lit(" "), kind).alias("mo"),
    )


def attached(spark, sf):
    return geo.attach_regions(entity_names(spark, sf), readers.read_dictionary(districts(spark, sf), 2023, 2024))


@query("src_4_read_dictionary", f"WITH {DISTRICTS} SELECT key, territory_id, year_from, year_to, oktmo FROM dictionary")
def read_dictionary(spark, sf):
    out = readers.read_dictionary(districts(spark, sf), 2023, 2024)
    return out.select("key", "territory_id", "year_from", "year_to", "oktmo")


@query("prep_14_attach_unique", f"""WITH {DISTRICTS}
SELECT key, CAST(c AS INTEGER) AS n_candidates, l.oktmo, l.region_name FROM counts LEFT JOIN lookup l USING (key)""")
def attach_unique(spark, sf):
    keys = geo.unique_keys(readers.read_dictionary(districts(spark, sf), 2023, 2024))
    one = F.col("n_candidates") == 1
    return keys.select("key", "n_candidates", F.when(one, F.col("v.oktmo")).alias("oktmo"),
                       F.when(one, F.col("v.region_name")).alias("region_name"))


@query("prep_15_attach_regions", f"""WITH {DISTRICTS}
SELECT entity, mo, region_name, oktmo, territory_id, CAST(n_candidates AS INTEGER) AS n_candidates,
       region_name IS NOT NULL AS region_resolved FROM attached""")
def attach_regions(spark, sf):
    return attached(spark, sf).select("entity", "mo", "region_name", "oktmo", "territory_id", "n_candidates", "region_resolved")


@query("prep_16_join_report", f"""WITH {DISTRICTS}
SELECT count(*) AS n_series, count(region_name) AS n_resolved, count(*) FILTER (WHERE n_candidates > 1) AS n_ambiguous,
       count(*) FILTER (WHERE region_name IS NULL AND n_candidates <= 1) AS n_unmatched FROM attached""")
def join_report(spark, sf):
    return geo.join_report(attached(spark, sf))


@query("prep_17_monthly", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1""")
def monthly(spark, sf):
    return I.table(spark, sf, "orders").groupBy(readers.to_month("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))


NORM = O.TOTAL_CLEAN + """,
norm AS (
  SELECT series_id, t, month, y, y / avg(CASE WHEN t < 12 THEN y END) OVER (PARTITION BY series_id) AS norm FROM clean),
common AS (SELECT t, quantile_cont(norm, 0.5) AS common FROM norm GROUP BY 1)"""


@query("prep_18_normalise_to_base", f"""WITH {NORM}
SELECT series_id, t, {r('norm')} AS norm, {r('common')} AS common FROM norm JOIN common USING (t)""")
def normalise_to_base(spark, sf):
    out = prep.normalise_to_base(I.total_clean(spark, sf))
    return _round(out, "norm", "common").select("series_id", "t", "norm", "common")


@query("prep_19_spread_band", f"""WITH {NORM}
SELECT CAST(ceil(round(quantile_cont(abs(norm / common - 1), 0.9) * 100, 6)) AS BIGINT) AS band_pct, count(*) AS n_cells
FROM norm JOIN common USING (t)""")
def spread_band(spark, sf):
    return prep.spread_band(prep.normalise_to_base(I.total_clean(spark, sf)))


@query("prep_20_corpus_coverage", f"""WITH {DISTRICTS},
corpus AS (SELECT DISTINCT CASE lang WHEN 'de' THEN 'ECONOMY' WHEN 'fr' THEN 'PROMO' WHEN 'es' THEN 'ABSENT' ELSE 'SMALL' END AS region FROM documents),
s AS (SELECT region_name AS region, entity % 5 <> 0 AS kept, n_candidates > 1 AS homonym FROM attached)
SELECT c.region, count(*) FILTER (WHERE kept) AS n_kept, count(*) FILTER (WHERE NOT kept) AS n_dropped,
       count(*) FILTER (WHERE homonym) AS n_homonyms, count(s.region) = 0 AS absent
FROM corpus c LEFT JOIN s ON c.region = s.region GROUP BY 1""")
def corpus_coverage(spark, sf):
    lang = F.col("lang")
    region = F.when(lang == "de", "ECONOMY").when(lang == "fr", "PROMO").when(lang == "es", "ABSENT").otherwise("SMALL")
    corpus = I.table(spark, sf, "documents").select(region.alias("region")).distinct()
    series = attached(spark, sf).select(
        F.col("region_name").alias("region"), (F.col("entity") % 5 != 0).alias("kept"),
        (F.col("n_candidates") > 1).alias("homonym"))
    return prep.corpus_coverage(corpus, series)


# --- sources --------------------------------------------------------------------------

@query("src_1_read_panel", f"""
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, {r('l_extendedprice', 2)} AS value,
       CAST(l_suppkey AS VARCHAR) AS mo, l_returnflag AS category FROM lineitem""")
def read_panel(spark, sf):
    return _round(readers.read_panel(I.transactions(spark, sf), "M"), "value", digits=2)


@query("src_2_read_aggregate", f"""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {r('avg(o_totalprice)')} AS value
FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' GROUP BY 1""")
def read_aggregate(spark, sf):
    raw = I.table(spark, sf, "orders")
    out = readers.read_aggregate(raw, {"o_orderstatus": "F", "o_orderpriority": "2-HIGH"}, "o_orderdate", "o_totalprice")
    return _round(out, "value")


@query("src_3_read_industry", f"""WITH m AS (
  SELECT 'orders/' || o_orderpriority AS series_key, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         avg(o_totalprice) AS value FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2
  UNION ALL
  SELECT 'lines/' || l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE), avg(l_discount - 0.01) FROM lineitem GROUP BY 1, 2)
SELECT series_key, month, {r('value', 4)} AS value FROM m
WHERE series_key IN (SELECT series_key FROM m GROUP BY 1 HAVING count(*) >= 48 AND min(value) > 0)""")
def read_industry(spark, sf):
    orders = I.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("activity"), F.col("o_orderdate").alias("period"), F.col("o_totalprice").alias("value"))
    lines = I.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("activity"), F.col("l_shipdate").alias("period"), (F.col("l_discount") - 0.01).alias("value"))
    out = readers.read_industry({"orders": orders, "lines": lines}, "activity", "5-low")
    return _round(out, "value", digits=4)


@query("src_7_read_external_features", f"""WITH {O.AGGREGATE}
SELECT 'spending' AS name, month, {r('value')} AS value FROM agg
UNION ALL SELECT 'price', CAST(date_trunc('month', o_orderdate) AS DATE), {r('avg(o_totalprice)', 4)} FROM orders WHERE o_orderstatus = 'F' GROUP BY 2
UNION ALL SELECT 'rate', CAST(date_trunc('month', l_shipdate) AS DATE), {r('avg(l_tax)')} FROM lineitem WHERE l_returnflag = 'N' GROUP BY 2""")
def read_external(spark, sf):
    return external_frame(spark, sf).withColumn(
        "value", F.when(F.col("name") == "price", rnd("value", 4)).otherwise(rnd("value", 6)))


def external_frame(spark, sf):
    orders, lines = I.table(spark, sf, "orders"), I.table(spark, sf, "lineitem")
    return readers.read_external_features({
        "spending": I.aggregate(spark, sf),
        "price": readers.read_aggregate(orders, {"o_orderstatus": "F"}, "o_orderdate", "o_totalprice"),
        "rate": readers.read_aggregate(lines, {"l_returnflag": "N"}, "l_shipdate", "l_tax"),
    })


@query("src_10_category_matrices", f"""WITH {O.SPENDING}, {O.cleaned('spending', 'category')}
SELECT category, series_id, t, {r('y')} AS y FROM clean""")
def category_matrices(spark, sf):
    clean = prep.clean_panel(I.spending(spark, sf), ["series_id", "category"], I.CALENDAR)
    return _round(clean, "y").select("category", "series_id", "t", "y")


# --- folds ----------------------------------------------------------------------------

def _calendar(spark, sf):
    """Months of the panel, read off the data."""
    months = I.spending(spark, sf).where(I.CALENDAR.contains(F.col("month")))
    return months.agg(F.min("month").alias("a"), F.max("month").alias("z"), F.sum("value").alias("v"))


def _with_calendar(spark, sf, folds):
    from panelwright.protocol import Calendar

    found = Calendar.of_panel(I.total_panel(spark, sf).where(I.CALENDAR.contains(F.col("month"))))
    return I.total_arrays(spark, sf), folds(found.n_months)


@query("fold_1_rolling_origin", f"""WITH {O.TOTAL_CLEAN}, {O.FOLDS3}
SELECT fold, train_end, train_end AS test_start, train_end + 3 AS test_end,
       count(*) FILTER (WHERE t < train_end) AS n_train, count(*) FILTER (WHERE t >= train_end AND t < train_end + 3) AS n_test
FROM folds CROSS JOIN clean GROUP BY 1, 2""")
def rolling(spark, sf):
    from panelwright.operators.backtest import fold_rows
    from panelwright.protocol import rolling_origin

    series, folds = _with_calendar(spark, sf, lambda n: fold_array({3: rolling_origin(n, 3, 3)}))
    return fold_rows(series, folds).groupBy("fold", "train_end", "test_start", "test_end").agg(
        F.sum(F.size("train")).alias("n_train"), F.sum(F.size("test")).alias("n_test"))


@query("fold_2_fold_slices", f"""WITH {O.TOTAL_CLEAN}, {O.FOLDS3}
SELECT series_id, fold, {r('sum(CASE WHEN t < train_end THEN y END)')} AS train_sum,
       {r('sum(CASE WHEN t >= train_end AND t < train_end + 3 THEN y END)')} AS test_sum
FROM folds CROSS JOIN clean GROUP BY 1, 2""")
def fold_slices(spark, sf):
    from panelwright.functions.arrays import total
    from panelwright.operators.backtest import fold_rows

    rows = fold_rows(I.total_arrays(spark, sf), I.folds())
    return rows.select("series_id", "fold", rnd(total(F.col("train")), 6).alias("train_sum"),
                       rnd(total(F.col("test")), 6).alias("test_sum"))


@query("fold_3_horizon_plan", f"""WITH {O.TOTAL_CLEAN}, {O.FOLDSH}
SELECT CAST(horizon AS INTEGER) AS horizon, fold, train_end, count(DISTINCT series_id) AS n_series FROM folds JOIN clean ON t < train_end GROUP BY 1, 2, 3""")
def plan(spark, sf):
    from panelwright.operators.backtest import fold_rows
    from panelwright.protocol import horizon_plan

    series, folds = _with_calendar(spark, sf, lambda n: fold_array(horizon_plan(n, dict(I.HORIZONS.plan))))
    return fold_rows(series, folds).groupBy("horizon", "fold", "train_end").agg(F.count(F.lit(1)).alias("n_series"))


@query("fold_4_dense_origins", f"""WITH {O.TOTAL_CLEAN}
SELECT CAST(o AS INTEGER) AS train_end, count(*) FILTER (WHERE t < o) AS n_train,
       {r('sum(CASE WHEN t >= o AND t < o + 3 THEN y END)', 6)} AS test_sum
FROM range(12, 77) AS g(o) CROSS JOIN clean GROUP BY 1""")
def origins(spark, sf):
    from panelwright.functions.arrays import total
    from panelwright.operators.backtest import fold_rows

    series, folds = _with_calendar(spark, sf, lambda n: fold_array({3: dense_origins(n, 3)}))
    return fold_rows(series, folds).groupBy("train_end").agg(
        F.sum(F.size("train")).alias("n_train"), rnd(F.sum(total(F.col("test"))), 6).alias("test_sum"))


@query("fold_5_target_month_coverage", f"""WITH {O.TOTAL_CLEAN}, {O.FOLDS3},
targets AS (
  SELECT fold, train_end, step, t + step AS target FROM folds CROSS JOIN range(1, 4) AS g(step)
  JOIN (SELECT DISTINCT t FROM clean) c ON c.t >= 5 AND c.t + step < train_end)
SELECT fold, CAST(step AS INTEGER) AS step, CAST((train_end + step - 1) % 12 + 1 AS INTEGER) AS predicted_month,
       count(*) AS n_targets, count(*) FILTER (WHERE target % 12 = (train_end + step - 1) % 12) AS n_same_month,
       count(DISTINCT target % 12) AS n_months_seen
FROM targets GROUP BY 1, 2, 3""")
def target_month_coverage(spark, sf):
    from panelwright.operators.folds import target_month_coverage as coverage

    months = I.total_clean(spark, sf).select("t").distinct()
    return coverage(months, I.folds())
