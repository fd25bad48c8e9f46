"""Registered queries beside their SQL on the smallest tables, and streams beside their batch."""
import datetime
import math

import duckdb
import pytest

from panelwright.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalogue.queries(), catalogue.oracles()
CHECKED = [
    "prep_1_rebuild_entities", "prep_5_clean_panel", "prep_6_panel_report", "prep_15_attach_regions", "prep_19_spread_band", "src_3_read_industry",
    "fold_5_target_month_coverage", "fc_9_score_series", "met_7_summarise", "met_11_summarise_by_horizon", "met_18_paired_vs_reference",
    "met_23_error_decomposition", "gb_13_blend_weights", "snk_4_upsert_by_model_horizon", "agg_6_choose_model", "cf_2_elasticity", "ts_3_two_stage",
    "ts_5_two_stage_known", "fwd_1_forecast_forward", "gb_1_lag_features", "gb_3_category_shares", "cp_3_preprocess_deseason", "cp_9_detect_cusum",
    "cp_16_summarise_bench", "cp_25_realtime_rank", "txt_4_monthly_features", "txt_7_removed_words", "txt_10_extract_text", "sta_1_exact_permutation",
    "sta_6_design_stats", "str_1_rollup", "str_2_online_cusum", "str_3_live_episodes", "str_4_online_shares",
]


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_query_has_a_survey_id():
    families = {"src", "snk", "prep", "fold", "fc", "agg", "cf", "ts", "gb", "met", "fwd", "cp", "txt", "sta", "str"}
    for name in QUERIES:
        family, number, *_ = name.split("_")
        assert family in families and number.isdigit(), name
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(repr(plain(r[c])) for c in columns) for r in df.collect()))
    cursor = con.execute(ORACLES[name])
    order = sorted(range(len(cursor.description)), key=lambda i: cursor.description[i][0])
    assert columns == [cursor.description[i][0] for i in order]
    want = sorted((tuple(repr(plain(r[i])) for i in order) for r in cursor.fetchall()))
    assert got == want


def test_stream_equals_batch_for_the_exact_partition(spark, sf):
    live = {tuple(r) for r in QUERIES["str_3_live_episodes_pelt"](spark, sf).select("key", "t").collect()}
    batch = {tuple(r) for r in QUERIES["cp_22_realtime_signals_pelt"](spark, sf).select("series_id", "t").collect()}
    assert live == batch and batch
