"""Back-test driver: series x fold x model -> forecasts -> score rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions import arrays as A
from panelwright.operators import forecasters
from panelwright.operators.metrics import naive_scale, row_metrics, target_sums

SCORE_KEYS = ("model", "horizon", "fold", "train_end", "series_id")


def fold_rows(series: DataFrame, folds: Column) -> DataFrame:
    """One row per series and fold with its training and test slices."""
    exploded = series.select("*", F.explode(folds).alias("f")).select(
        "*", *[F.col(f"f.{c}").alias(c) for c in ("horizon", "fold", "train_end", "test_start", "test_end")]
    )
    sliced = exploded.drop("f").withColumn("train", A.head(F.col("y"), F.col("train_end"))).withColumn(
        "test", A.window(F.col("y"), F.col("test_start"), F.col("horizon"))
    )
    # the same for every model, so before the models multiply the rows; unused columns are pruned
    return sliced.withColumns({
        "train_hole": A.has_null(F.col("train")),
        "test_hole": A.has_null(F.col("test")),
        "scale": naive_scale(F.col("train")),
        "target": target_sums(F.col("test")),
    })


def forecast_series(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every closed-form model on every row that has ``train`` and ``horizon``.

    A series with a hole cannot be fitted: it becomes a row with a reason, not a gap.
    """
    bad = F.col("train_hole") if "train_hole" in rows.columns else A.has_null(F.col("train"))
    reason = F.when(bad, F.lit("ValueError: missing values in the training window"))
    runs = [
        F.struct(
            F.lit(name).alias("model"),
            F.when(~bad, forecasters.build(name)(F.col("train"), F.col("horizon"))).alias("forecast"),
            F.substring(reason, 1, 120).alias("error"),
        )
        for name in models
    ]
    return rows.select("*", F.explode(F.array(*runs)).alias("r")).select("*", "r.*").drop("r")


def score_series(series: DataFrame, folds: Column, models: Sequence[str]) -> DataFrame:
    """Score rows of all ``(series, fold, model)`` triples."""
    done = forecast_series(fold_rows(series, folds), models)
    return score_rows(done)


def score_rows(done: DataFrame) -> DataFrame:
    """Score rows of :func:`fold_rows` with ``forecast, error``; refusals keep their reason."""
    failed = F.col("error").isNotNull() | F.col("forecast").isNull() | A.has_null(F.col("forecast"))
    blind = F.col("test_hole")
    error = (
        F.coalesce(F.col("error"), F.when(failed, F.lit("not enough history for the features")),
                   F.when(blind, F.lit("ValueError: missing values in the test window")))
    )
    metrics = F.when(~failed & ~blind, row_metrics(F.col("test"), F.col("forecast"), F.col("scale"), F.col("target")))
    return done.select(*SCORE_KEYS, metrics.alias("m"), error.alias("error")).select(*SCORE_KEYS, "m.*", "error")


def forecast_points(done: DataFrame) -> DataFrame:
    """Long form: one row per step with the actual value beside the forecast."""
    pairs = F.zip_with("forecast", "test", lambda p, a: F.struct(p.alias("forecast"), a.alias("actual")))
    steps = F.posexplode(pairs)
    long = done.where(F.col("error").isNull()).select(*SCORE_KEYS, "test_start", steps.alias("step0", "p"))
    return long.select(
        *SCORE_KEYS,
        (F.col("step0") + 1).alias("step"),
        (F.col("test_start") + F.col("step0")).alias("t"),
        F.col("p.forecast").alias("forecast"),
        F.col("p.actual").alias("actual"),
    )


def forecast_reference(series: DataFrame, model: str, horizon: int, n_months: int) -> DataFrame:
    """One model from the last month of every series, ``horizon`` steps ahead."""
    rows = series.withColumn("train", F.col("y")).withColumn("horizon", F.lit(horizon))
    size_ok = F.size("y") == n_months
    rows = rows.withColumn(
        "train",
        F.when(size_ok, F.col("train")).otherwise(
            F.raise_error(F.lit("the forecast origin is not the last month of the panel")).cast("array<double>")
        ),
    )
    return forecast_series(rows, [model])
