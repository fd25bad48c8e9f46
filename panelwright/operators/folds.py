"""Checks on folds and stored batches."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MIN_LAG = 5


def target_month_coverage(months: DataFrame, folds: Column) -> DataFrame:
    """Calendar months seen as training targets per step, against the month to predict."""
    rows = months.select("t", F.explode(folds).alias("f"))
    steps = rows.select("t", "f.*", F.explode(F.sequence(F.lit(1), F.col("f.horizon"))).alias("step"))
    target = F.col("t") + F.col("step")
    used = steps.where((F.col("t") >= MIN_LAG) & (target < F.col("train_end")))
    wanted = (F.col("train_end") + F.col("step") - 1) % 12
    return used.groupBy("fold", "step", (wanted + 1).cast("int").alias("predicted_month")).agg(
        F.count(F.lit(1)).alias("n_targets"),
        F.count(F.when(target % 12 == wanted, 1)).alias("n_same_month"),
        F.count_distinct(target % 12).alias("n_months_seen"),
    )


def panel_differences(stored: DataFrame, fresh: DataFrame, by_horizon: bool = True) -> DataFrame:
    """What differs between a stored table and a batch: series only on one side, fold numbers.

    Fold numbers are compared on the horizons both sides have.
    """
    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select("series_id").distinct().withColumn(name, F.lit(True))

    series = side(stored, "_s").join(side(fresh, "_f"), "series_id", "full")
    only = series.select(
        F.when(F.col("_f").isNull(), "series only stored").when(F.col("_s").isNull(), "series only in batch").alias("problem")
    ).where(F.col("problem").isNotNull())
    keys = ["horizon"] if by_horizon else []

    def numbers(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(*keys).agg(F.array_sort(F.collect_set("fold")).alias(name))

    if keys:
        both = numbers(stored, "_sf").join(numbers(fresh, "_ff"), keys)
    else:
        both = numbers(stored, "_sf").crossJoin(F.broadcast(numbers(fresh, "_ff").limit(1)))
    where = F.concat(F.lit(" at horizon "), F.col("horizon").cast("string")) if keys else F.lit("")
    folds = both.where(F.col("_sf") != F.col("_ff")).select(F.concat(F.lit("other folds"), where).alias("problem"))
    return only.unionByName(folds).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def check_same_panel(stored: DataFrame, fresh: DataFrame, what: str = "batch", by_horizon: bool = True) -> None:
    """Raise unless the batch has the stored series and fold numbers. An empty batch is an error."""
    if fresh.isEmpty():
        raise ValueError(f"the {what} is empty: check the models, the sample and the folds; nothing was written")
    if stored.isEmpty():
        return
    problems = panel_differences(stored, fresh, by_horizon).limit(100).collect()
    if problems:
        text = "; ".join(f"{p['problem']}: {p['n']}" for p in sorted(problems, key=lambda p: p["problem"]))
        raise ValueError(f"the {what} does not match the stored table: {text}; nothing was written")
