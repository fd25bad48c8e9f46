"""Scores of one window, and summaries over the score table."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions import arrays as A
from panelwright.functions.quantiles import exact_quantiles

PARTS = ("mae", "r2", "smape", "mase", "sse", "sst", "n", "y_sum", "y_sq")
REFERENCES = {"gain_to_reference": "seasonal_drift", "gain_to_naive": "naive_last"}


def mae(y: Column, p: Column) -> Column:
    return A.mean(F.zip_with(y, p, lambda a, b: F.abs(a - b)))


def sse(y: Column, p: Column) -> Column:
    return A.total(F.zip_with(y, p, lambda a, b: (a - b) * (a - b)))


def sst(y: Column) -> Column:
    return A.sum_of_squares(y, A.mean(y))


def r2(y: Column, p: Column) -> Column:
    spread = sst(y)
    return F.when(spread != 0, 1.0 - sse(y, p) / spread)


def smape(y: Column, p: Column) -> Column:
    parts = F.zip_with(
        y, p, lambda a, b: F.when(F.abs(a) + F.abs(b) > 0, F.abs(a - b) / ((F.abs(a) + F.abs(b)) / 2.0))
    )
    return A.mean(F.filter(parts, lambda x: x.isNotNull())) * 100.0


def naive_scale(train: Column) -> Column:
    """In-sample error of the one-step naive forecast."""
    return A.mean(F.transform(A.diffs(train), lambda d: F.abs(d)))


def mase(y: Column, p: Column, train: Column) -> Column:
    """Over the in-sample error of the one-step naive forecast."""
    scale = naive_scale(train)
    return F.when(scale != 0, mae(y, p) / scale)


def target_sums(y: Column) -> Column:
    """What the scores need of the window itself, the same for every model."""
    return F.struct(sst(y).alias("sst"), F.size(y).alias("n"), A.total(y).alias("y_sum"), A.sum_of_squares(y).alias("y_sq"))


def row_metrics(y: Column, p: Column, scale: Column, target: Column) -> Column:
    """All scores of one window. ``scale`` and ``target`` are computed once per series and fold."""
    errors = F.zip_with(y, p, lambda a, b: a - b)

    def body(e: Column) -> Column:
        sums = F.struct(A.mean(F.transform(e, lambda x: F.abs(x))).alias("mae"), A.sum_of_squares(e).alias("sse"))
        return A.let(sums, lambda m: F.struct(
            m["mae"].alias("mae"),
            F.when(target["sst"] != 0, 1.0 - m["sse"] / target["sst"]).alias("r2"),
            smape(y, p).alias("smape"),
            F.when(scale != 0, m["mae"] / scale).alias("mase"),
            m["sse"].alias("sse"),
            target["sst"].alias("sst"),
            target["n"].alias("n"),
            target["y_sum"].alias("y_sum"),
            target["y_sq"].alias("y_sq"),
        ))

    return A.let(errors, body)


def refused() -> Column:
    return F.col("error").isNotNull() | F.col("mae").isNull()


def summarise(scores: DataFrame, keys: Sequence[str] = ("model",), exact_median: bool = True) -> DataFrame:
    """Means over scored rows, refusals counted, models with nothing but refusals kept."""
    keys = list(keys)
    rows = scores.withColumn("_ok", ~refused())
    ok = F.col("_ok")
    base = rows.groupBy(*keys).agg(
        F.avg(F.when(ok, F.col("mae"))).alias("mae"),
        F.avg(F.when(ok, F.col("mase"))).alias("mase"),
        F.avg(F.when(ok, F.col("smape"))).alias("smape"),
        F.count_distinct(F.when(ok, F.col("series_id"))).alias("n_series"),
        F.count(F.when(~ok, 1)).alias("n_refused"),
    )
    out = base.join(r2_pool(scores, keys), keys, "left")
    if exact_median:
        out = out.join(r2_median(scores, keys), keys, "left")
    return out


def r2_pool(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``1 - SSE / SST`` with SST around the pooled mean.

    One pass: inside a window length the spread of window means is a plain variance, which
    Spark merges without cancellation; the few window lengths are combined afterwards.
    """
    keys = list(keys)
    rows = scores.where(~refused() & F.col("sse").isNotNull())
    by_length = rows.groupBy(*keys, "n").agg(
        F.sum("sse").alias("sse"),
        F.sum("sst").alias("sst"),
        (F.col("n") * F.count(F.lit(1))).alias("w"),
        F.avg(F.col("y_sum") / F.col("n")).alias("m"),
        F.var_pop(F.col("y_sum") / F.col("n")).alias("v"),
    )
    lengths = by_length.groupBy(*keys).agg(
        F.sum("sse").alias("sse"),
        F.sum(F.col("sst") + F.col("w") * F.col("v")).alias("within"),
        (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("mean"),
        F.collect_list(F.struct("w", "m")).alias("parts"),
    )
    away = A.total(F.transform("parts", lambda p: p["w"] * (p["m"] - F.col("mean")) * (p["m"] - F.col("mean"))))
    spread = F.col("within") + away
    return lengths.select(*keys, F.when(spread > 0, 1.0 - F.col("sse") / spread).alias("r2_pool"))


def r2_median(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return exact_quantiles(scores.where(~refused()), list(keys), "r2", {"r2_median": 0.5}, few_groups=True).drop("n")


def gains(summary: DataFrame, within: Sequence[str] = (), references: Mapping[str, str] = REFERENCES) -> DataFrame:
    """Percent better than a reference model inside its group; NULL without the reference."""
    frame = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    out = summary
    for column, reference in references.items():
        base = F.max(F.when(F.col("model") == reference, F.col("mae"))).over(frame)
        out = out.withColumn(column, 100.0 * (base - F.col("mae")) / F.when(base != 0, base))
    return out


def summarise_horizons(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries by fold and by horizon; the latter with planned and counted folds."""
    by_fold = gains(summarise(scores, ["horizon", "model", "fold", "train_end"]), ["horizon", "fold", "train_end"])
    folds = by_fold.groupBy("horizon", "model").agg(
        F.count_distinct("fold").alias("n_folds"),
        F.count_distinct(F.when(F.col("n_series") > 0, F.col("fold"))).alias("n_folds_counted"),
    )
    by_horizon = gains(summarise(scores, ["horizon", "model"]), ["horizon"]).join(folds, ["horizon", "model"], "left")
    return by_fold, by_horizon


def step_errors(points: DataFrame) -> DataFrame:
    return points.groupBy("model", "horizon", "fold", "train_end", "step").agg(
        F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("mae"), F.count(F.lit(1)).alias("n_series")
    )


def identical_models(scores: DataFrame, tolerance: float, strict: bool = False) -> DataFrame:
    """Model pairs equal within the tolerance on every common row.

    Each (series, fold) folds its few models into one array, so the pairs come from one
    row and nothing is self-joined. The number of models is fixed by the registry.
    """
    rows = scores.where(~refused())
    packed = rows.groupBy("horizon", "fold", "series_id").agg(
        F.array_sort(F.collect_list(F.struct("model", "mae"))).alias("ms")
    )
    pairs = packed.select(F.explode("ms").alias("a"), "ms").select("a", F.explode("ms").alias("b")).where(
        F.col("a.model") < F.col("b.model")
    )
    gap = F.max(F.abs(F.col("a.mae") - F.col("b.mae")))
    out = pairs.groupBy(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b")).agg(
        gap.alias("max_gap"), F.count(F.lit(1)).alias("n_pairs")
    )
    close = F.col("max_gap") < tolerance if strict else F.col("max_gap") <= tolerance
    return out.withColumn("identical", close)


def uneven_pairs(scores: DataFrame) -> DataFrame:
    """Pairs per model and horizon, the pairs common to all, and whether the sets differ."""
    rows = scores.where(~refused())
    per_pair = rows.groupBy("horizon", "series_id", "fold").agg(F.collect_set("model").alias("models"))
    n_models = rows.groupBy("horizon").agg(F.count_distinct("model").alias("n_models"))
    tagged = per_pair.join(n_models, "horizon").withColumn("_all", F.size("models") == F.col("n_models"))
    common = tagged.groupBy("horizon").agg(F.count(F.when(F.col("_all"), 1)).alias("n_common"))
    counts = tagged.select("horizon", F.explode("models").alias("model")).groupBy("horizon", "model").agg(
        F.count(F.lit(1)).alias("n_pairs")
    )
    return counts.join(common, "horizon").withColumn("uneven", F.max(F.col("n_pairs") != F.col("n_common")).over(
        Window.partitionBy("horizon")))


def uneven_series(scores: DataFrame) -> DataFrame:
    """Distinct series per model, refusals included; empty when all are equal."""
    counts = scores.groupBy("model").agg(F.count_distinct("series_id").alias("n_series"))
    whole = Window.partitionBy(F.lit(1))
    spread = counts.withColumn("_a", F.min("n_series").over(whole)).withColumn("_z", F.max("n_series").over(whole))
    return spread.where(F.col("_a") != F.col("_z")).drop("_a", "_z")
