"""How the gain of a model changes with the length of the training window."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelwright.functions.frames import average_rank, union_all
from panelwright.functions.stats import pearson
from panelwright.operators import backtest
from panelwright.operators.metrics import refused
from panelwright.protocol import Fold, fold_array


def length_table(scores: DataFrame, base: str) -> DataFrame:
    """Per training length: mean error, gain to the base in percent, and the best model."""
    means = scores.where(~refused()).groupBy("horizon", "train_end", "model").agg(F.avg("mae").alias("mae"))
    here = Window.partitionBy("horizon", "train_end")
    reference = F.max(F.when(F.col("model") == base, F.col("mae"))).over(here)
    gain = 100.0 * (reference - F.col("mae")) / F.when(reference != 0, reference)
    best = F.min(F.struct("mae", "model")).over(here)
    return means.withColumn("gain", gain).withColumn("is_best", F.col("model") == best["model"])


def length_correlation(table: DataFrame) -> DataFrame:
    """Spearman correlation of each model's gain with the training length. One row per origin."""
    rows = table.where(F.col("gain").isNotNull())
    ranked = rows.withColumn("_g", average_rank("gain", ["horizon", "model"])).withColumn("_n", average_rank("train_end", ["horizon", "model"]))
    return ranked.groupBy("horizon", "model").agg(F.count(F.lit(1)).alias("n_origins"), pearson("_g", "_n").alias("spearman"))


def length_sweep(ctx, names: Sequence[str], plan: Mapping[int, Sequence[Fold]], config) -> DataFrame:
    """Naive forecast and panel models on every origin of the plan."""
    from panelwright.operators.trees import evaluate_panel

    naive = backtest.score_series(ctx.arrays, fold_array(dict(plan)), ["naive_last"])
    parts = [naive, *[evaluate_panel(ctx, name, plan, config) for name in names]]
    return length_table(union_all(parts), "naive_last")
