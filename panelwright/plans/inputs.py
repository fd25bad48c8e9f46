"""How the given tables stand in for the inputs of the pipeline.

panel      lineitem: supplier x ship month, sum of extended price in thousands
category   l_returnflag (three known values)
region     nation of the supplier (25) and its region (5)
aggregate  the same sum over all suppliers; it continues past the panel's last month
industry   lineitem by part type x month
events     events
text       documents (source = outlet, lang = region), pages
"""
from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.operators import backtest, prep
from panelwright.protocol import BacktestConfig, Calendar, HorizonsConfig, fold_array
from panelwright.session import written_once
from panelwright.sources import readers

CALENDAR = Calendar(date(1995, 1, 1), 79)
BACKTEST = BacktestConfig(CALENDAR)
HORIZONS = HorizonsConfig(CALENDAR)
CATEGORIES = ("A", "N", "R")
MODELS = BACKTEST.models


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """The spending rows in the shape of the raw panel."""
    return table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("period"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_suppkey").cast("string").alias("mo"),
        F.col("l_returnflag").alias("category"),
        F.lit("M").alias("freq"),
        F.lit("thousand").alias("unit"),
    )


def spending(spark: SparkSession, sf: str, calendar: Calendar | None = None) -> DataFrame:
    """``series_id, category, month, value``: one row per supplier, flag and month."""
    bounds = (calendar.start, calendar.last) if calendar is not None else (None, None)
    raw = readers.read_panel(transactions(spark, sf), "M", *bounds).withColumnRenamed("mo", "series_id")
    return prep.monthly_panel(raw, ["series_id", "category"])


def total_panel(spark: SparkSession, sf: str) -> DataFrame:
    raw = readers.read_panel(transactions(spark, sf), "M", CALENDAR.start, CALENDAR.last).withColumnRenamed("mo", "series_id")
    return prep.monthly_panel(raw, ["series_id"])


def total_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Kept total series as arrays over the calendar."""
    return prep.clean_arrays(total_panel(spark, sf), ["series_id"], CALENDAR)


def total_clean(spark: SparkSession, sf: str) -> DataFrame:
    return prep.clean_panel(total_panel(spark, sf), ["series_id"], CALENDAR)


def category_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier x flag as one series each (these have real gaps)."""
    panel = spending(spark, sf, CALENDAR)
    return panel.withColumn("series_id", F.concat_ws("|", "series_id", "category"))


def category_arrays(spark: SparkSession, sf: str, keep_all: bool = True) -> DataFrame:
    return prep.clean_arrays(category_panel(spark, sf), ["series_id", "category"], CALENDAR, keep_all=keep_all)


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """``series_id, region`` (nation) and ``macro`` (region)."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(F.col("s_suppkey").cast("string").alias("series_id"), F.col("n_name").alias("region"),
                F.col("r_name").alias("macro"))
    )


def aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """National monthly sum in millions, past the panel's last month too."""
    raw = readers.read_panel(transactions(spark, sf), "M")
    return prep.monthly_panel(raw, [], unit=1_000_000.0)


def industry(spark: SparkSession, sf: str) -> DataFrame:
    """``series_key, month, value`` per part type. Lines fold to part x month before the join."""
    lines = table(spark, sf, "lineitem").select(
        "l_partkey", readers.to_month("l_shipdate").alias("month"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("v"),
    )
    by_part = lines.groupBy("l_partkey", "month").agg(F.sum("v").alias("v"))
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("series_key"))
    return (
        by_part.join(parts, by_part.l_partkey == parts.p_partkey)
        .groupBy("series_key", "month")
        .agg((F.sum("v").cast("double") / 100.0 / 1_000_000.0).alias("value"))
    )


def folds():
    return fold_array({BACKTEST.horizon: BACKTEST.folds})


def horizon_folds():
    return fold_array(HORIZONS.folds)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Main protocol, all closed-form models, refused series included."""
    return backtest.score_series(category_arrays(spark, sf), folds(), MODELS)


def horizon_scores(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.score_series(category_arrays(spark, sf), horizon_folds(), MODELS)


def stored_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return written_once("arrays", lambda: total_arrays(spark, sf).select("series_id", "y"))


def stored_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return written_once("aggregate", lambda: aggregate(spark, sf))


def score_table(spark: SparkSession, sf: str) -> DataFrame:
    """The score rows as a stored table, for summaries that read it several times."""
    return written_once("scores", lambda: scores(spark, sf))


def horizon_score_table(spark: SparkSession, sf: str) -> DataFrame:
    return written_once("horizon-scores", lambda: horizon_scores(spark, sf))


def point_table(spark: SparkSession, sf: str) -> DataFrame:
    return written_once("points", lambda: points(spark, sf))


def stored_category_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return written_once("category-arrays", lambda: category_arrays(spark, sf).select("series_id", "y"))


def points(spark: SparkSession, sf: str, arrays: DataFrame | None = None) -> DataFrame:
    """Forecasts beside what came; ``arrays``: the series, where a query has them stored."""
    rows = backtest.fold_rows(category_arrays(spark, sf) if arrays is None else arrays, horizon_folds())
    return backtest.forecast_points(backtest.forecast_series(rows, MODELS))
