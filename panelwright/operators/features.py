"""Training features of the panel learner.

Rows are ``series_id, t``; a missing feature is NULL until :func:`with_missing_flags` turns
it into a value and a flag, because Spark ML accepts no NaN.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions.frames import union_all
from panelwright.protocol import Calendar

LAGS = (1, 2, 3, 4, 5, 6)
SHARE_SHIFT = 6
LAG_COLUMNS = (
    *[f"ratio_lag_{k}" for k in LAGS if k > 1], "level_log",
    "mean_ratio_3", "std_ratio_3", "mean_ratio_6", "std_ratio_6", "month_no",
)


#: The array of a series beside each of its cells.
WHOLE = "_series"


def cells(series: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """``keys, t, y`` of series held as arrays ``y`` over the calendar. The array stays beside its cells, so looking back
    or ahead needs no shuffle; any other array of the row gives its element of the month."""
    rest = [c for c in series.columns if c not in (*keys, "y")]
    rows = series.select(*keys, F.col("y").alias(WHOLE), *rest, F.posexplode("y").alias("t", "y"))
    return rows.withColumns({c: F.get(c, F.col("t")) for c in rest}) if rest else rows


def whole(rows: DataFrame) -> bool:
    """Is ``y`` the array of a series, not one month of it?"""
    return dict(rows.dtypes)["y"].startswith("array")


def without_holes(series: DataFrame) -> bool:
    """Is every month of the arrays ``y`` an ordinary number? Then no lag feature of :func:`cells` is missing or not a number."""
    return series.where(F.exists("y", lambda v: v.isNull() | ~(F.abs(v) < F.lit(1e100)))).isEmpty()  # their squares are numbers too


def _months_back(rows: DataFrame, keys: Sequence[str]) -> Callable[[int], Column]:
    """``y`` so many months before each row, or ahead of it."""
    if WHOLE in rows.columns:
        return lambda k: F.get(WHOLE, F.col("t") - k)
    by_t = Window.partitionBy(*keys).orderBy("t")
    return lambda k: (F.lag("y", k) if k > 0 else F.lead("y", -k)).over(by_t)


def _with_moments(rows: DataFrame, values: Sequence[Column], mean: str, std: str) -> DataFrame:
    """Mean and population spread of a few columns over ``y``, NULLs left out, with the running update that Spark's aggregates use."""
    known = [v.isNotNull().cast("double") for v in values]
    seen = lambda i: F.greatest(sum(known[1:i + 1], known[0]), F.lit(1.0))
    out = rows.withColumns({"_mean": F.coalesce(values[0], F.lit(0.0)), "_sq": F.lit(0.0)})
    for i, v in enumerate(values[1:], 1):
        out = out.withColumn("_off", F.coalesce(v - F.col("_mean"), F.lit(0.0)))
        part = F.col("_off") / seen(i)
        out = out.withColumns({"_mean": F.col("_mean") + part, "_sq": F.col("_sq") + F.col("_off") * (F.col("_off") - part)})
    total, n = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0)), seen(len(values) - 1)
    return out.withColumns({mean: total / n / F.col("y"), std: F.sqrt(F.col("_sq") / n) / F.col("y")}).drop("_mean", "_sq", "_off")


def lag_features(clean: DataFrame, keys: Sequence[str] = ("series_id",), month_no: Column | None = None) -> DataFrame:
    """From ``t = 5`` on and for positive levels: lag ratios, log level, rolling mean and spread."""
    y, back = F.col("y"), _months_back(clean, keys)
    past = {f"_y{k}": back(k) for k in range(1, max(LAGS))}
    out = clean.withColumns(past).where((F.col("t") >= max(LAGS) - 1) & (y > 0)).drop(WHOLE)
    out = out.withColumns({f"ratio_lag_{k}": F.col(f"_y{k - 1}") / y for k in LAGS if k > 1})
    out = out.withColumn("level_log", F.when(y > 0, F.log(y)))
    for w in (3, 6):
        out = _with_moments(out, [*[F.col(f"_y{k}") for k in range(w - 1, 0, -1)], y], f"mean_ratio_{w}", f"std_ratio_{w}")
    calendar_month = (F.col("t") % 12 + 1).cast("int") if month_no is None else month_no
    return out.withColumn("month_no", calendar_month).drop(*past)


def with_targets(clean: DataFrame, horizon: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """``y_1 .. y_h`` ahead of every row; NULL past the end."""
    back = _months_back(clean, keys)
    return clean.withColumns({f"y_{s}": back(-s) for s in range(1, horizon + 1)})


def trains(step: int, train_end: int) -> Column:
    """Is a row a training row of the step? Its target lies before ``train_end`` and is known."""
    return (F.col("t") <= train_end - step - 1) & F.col(f"y_{step}").isNotNull()


def ratio_ahead(step: int) -> Column:
    return F.col(f"y_{step}") / F.col("y")


def ratio_target(rows: DataFrame, step: int, train_end: int, multipliers: DataFrame | None = None) -> DataFrame:
    """Training rows of one step: ``target = y[t + s] / y[t] / multiplier`` for ``t + s < train_end``.

    ``multipliers`` has ``t, multiplier`` for this step, or ``series_id`` too when regional.
    """
    used = rows.where(trains(step, train_end))
    ratio = ratio_ahead(step)
    if multipliers is None:
        return used.withColumn("target", ratio)
    keys = [k for k in ("series_id", "t") if k in multipliers.columns]
    # without a series the multipliers are one row per month
    joined = used.join(multipliers if "series_id" in keys else F.broadcast(multipliers), keys, "left")
    return joined.withColumn("target", ratio / F.coalesce("multiplier", F.lit(1.0))).drop("multiplier")


def category_shares(total: DataFrame, category_clean: DataFrame, categories: Sequence[str]) -> DataFrame:
    """``series_id, t, share_*, dshare_*``: share of each known category and its change over six months.

    Of series held as arrays: the same as arrays, a row for each series.
    """
    if whole(total):
        return _share_arrays(total, category_clean, categories)
    wide = category_clean.groupBy("series_id", "t").agg(*[
        F.max(F.when(F.col("category") == c, F.col("y"))).alias(f"_c_{c}") for c in categories
    ])
    rows = total.select("series_id", "t", "y").join(wide, ["series_id", "t"], "left")
    by_t = Window.partitionBy("series_id").orderBy("t")
    out = rows
    for c in categories:
        share = F.when(F.col("y") > 0, F.col(f"_c_{c}") / F.col("y"))
        out = out.withColumn(f"share_{c}", share)
    for c in categories:
        past = F.lag(f"share_{c}", SHARE_SHIFT).over(by_t)
        out = out.withColumn(f"dshare_{c}", F.when(past > 0, F.col(f"share_{c}") / past - 1.0))
    return out.drop("y", *[f"_c_{c}" for c in categories])


def _share_arrays(total: DataFrame, parts: DataFrame, categories: Sequence[str]) -> DataFrame:
    wide = parts.groupBy("series_id").agg(*[F.max(F.when(F.col("category") == c, F.col("y"))).alias(f"_c_{c}") for c in categories])
    out = total.select("series_id", "y").join(wide, "series_id", "left")
    early = F.array_repeat(F.lit(None).cast("double"), SHARE_SHIFT)
    out = out.withColumns({f"share_{c}": F.zip_with(f"_c_{c}", "y", lambda part, y: F.when(y > 0, part / y)) for c in categories})
    change = lambda share, past: F.when(past > 0, share / past - 1.0)
    out = out.withColumns({f"dshare_{c}": F.zip_with(f"share_{c}", F.concat(early, f"share_{c}"), change) for c in categories})
    return out.drop("y", *[f"_c_{c}" for c in categories])


def stacked(total_rows: DataFrame, category_rows: DataFrame) -> DataFrame:
    """Each complete category series as an extra training series; its other features are missing."""
    return union_all([
        total_rows.withColumn("is_total", F.lit(1.0)), category_rows.withColumn("is_total", F.lit(0.0)),
    ])


def external_features(external: DataFrame, names: Sequence[str], difference: Sequence[str] = (), lags: Sequence[int] = (1, 3, 12)) -> DataFrame:
    """Growth of each long series at the lags (difference for rates): one row per month."""
    shifted = external.select(
        "name", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), "month", F.col("value").alias("previous")
    ).withColumn("month", F.add_months("month", F.col("lag")))
    rows = external.join(shifted, ["name", "month"])
    is_rate = F.col("name").isin(*difference) if difference else F.lit(False)
    change = F.when(is_rate, F.col("value") - F.col("previous")).otherwise(F.col("value") / F.col("previous") - 1.0)
    long = rows.where(F.col("previous") != 0).withColumn("change", change)
    return long.groupBy("month").agg(*[
        F.max(F.when((F.col("name") == n) & (F.col("lag") == k), F.col("change"))).alias(f"{n}_d{k}")
        for n in names for k in lags
    ])


def news_features(rows: DataFrame, regions: DataFrame, monthly: DataFrame, topics: Sequence[str], calendar: Calendar) -> DataFrame:
    """Topic shares of the series' region in the month of the row; no region or month gives NULL, never 0."""
    placed = rows.join(regions.select("series_id", "region"), "series_id", "left").withColumn("_m", calendar.month_at(F.col("t")))
    news = monthly.select(F.col("region"), F.col("month").alias("_m"), *[F.col(t).alias(f"news_{t}") for t in topics])
    return placed.join(news, ["region", "_m"], "left").drop("_m", "region")


def pretrain_rows(long_series: DataFrame, origin, horizon: int) -> DataFrame:
    """Features and targets of long industry series up to the origin, with the real calendar month."""
    by_month = Window.partitionBy("series_key").orderBy("month")
    cut = long_series.where(F.col("month") <= F.lit(origin)).select(
        F.col("series_key").alias("series_id"), "series_key", "month", F.col("value").alias("y")
    ).withColumn("t", (F.row_number().over(by_month) - 1).cast("int"))
    targets = with_targets(cut, horizon)
    return lag_features(targets, month_no=F.month("month")).drop("series_key")


def with_missing_flags(df: DataFrame, columns: Sequence[str], flagged: Sequence[str] | None = None, fill: float = -1.0) -> tuple[DataFrame, list[str]]:
    """Each feature as a filled value, and the ``flagged`` ones (by default all) with a 0/1 flag."""
    filled = {c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(fill)) for c in columns}
    flags = {f"{c}_missing": (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double") for c in (columns if flagged is None else flagged)}
    return df.withColumns(flags).withColumns(filled), [*columns, *flags]
