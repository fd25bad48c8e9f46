"""Live signals on the panel and break tables of the whole series."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions.frames import average_rank, with_scalars
from panelwright.operators import detectors as D
from panelwright.operators.cpbench import flag_sets, prepared
from panelwright.protocol import Calendar


def panel_flags(series: DataFrame, detector: str, mode: str, penalty: float | None) -> DataFrame:
    """``series_id, months, n_failed`` of one setting over the whole panel."""
    rows = prepared(series.select("series_id", "y"), [mode])
    grid = {mode: [penalty]} if detector == "kernel_rbf" else None
    return flag_sets(rows, [detector], [penalty] if penalty is not None else [], grid).select("series_id", "months", "n_failed")


def episodes(flagged: DataFrame) -> DataFrame:
    """Episode starts: a flag with no flag in the three months before it."""
    def starts(t: Column, i: Column) -> Column:
        return (i == 0) | (t - F.get("months", i - 1) > D.RECENT)

    return flagged.withColumn("starts", F.filter("months", starts))


def episode_rows(flagged: DataFrame) -> DataFrame:
    return episodes(flagged).select("series_id", F.explode("starts").alias("t"))


def monthly_shares(flagged: DataFrame, calendar: Calendar) -> DataFrame:
    """Percent of series starting an episode per month; months without any are kept at zero."""
    starts = episodes(flagged)
    total = starts.agg(F.count(F.lit(1)).alias("n_series"), F.sum("n_failed").alias("n_failed_series"))
    counts = starts.select(F.explode("starts").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_signals"))
    grid = total.select("*", F.explode(F.sequence(F.lit(0), F.lit(calendar.n_months - 1))).alias("t"))
    out = grid.join(counts, "t", "left").withColumn("n_signals", F.coalesce("n_signals", F.lit(0).cast("bigint")))
    # no series at all is an error, not a share of nothing
    n = F.when(F.col("n_series") > 0, F.col("n_series")).otherwise(F.raise_error(F.lit("the panel has no series")).cast("bigint"))
    return out.select(
        "t", calendar.month_at(F.col("t")).alias("month"), (F.col("n_signals") / n * 100).alias("share"), "n_signals", "n_series"
    )


def _event_windows(events: Sequence[int], n_months: int) -> list[tuple[int, int]]:
    outside = [e for e in events if not 0 <= e < n_months]
    if outside:
        raise ValueError(f"event months outside the panel: {outside}")
    ordered = sorted(events)
    return [(e, next((m for m in ordered if m > e), n_months)) for e in events]


def event_table(flagged: DataFrame, monthly: DataFrame, events: Sequence[int], calendar: Calendar, threshold: float) -> DataFrame:
    """Per event window (to the next event): first month over the threshold, delay, peak, series with any start."""
    spans = F.array(*[
        F.struct(F.lit(a).alias("event_t"), F.lit(z).alias("end_t")) for a, z in _event_windows(events, calendar.n_months)
    ])
    inside = (F.col("t") >= F.col("w.event_t")) & (F.col("t") < F.col("w.end_t"))
    shares = monthly.select("t", "share", "n_series", F.explode(spans).alias("w")).where(inside)
    crossed = shares.groupBy("w").agg(
        F.min(F.when(F.col("share") >= threshold, F.col("t"))).alias("crossed_t"), F.max("share").alias("max_share"), F.max("n_series").alias("n")
    )
    hit = F.exists("starts", lambda t: (t >= F.col("w.event_t")) & (t < F.col("w.end_t")))
    touched = episodes(flagged).select("starts", F.explode(spans).alias("w")).groupBy("w").agg(F.count(F.when(hit, 1)).alias("_k"))
    out = crossed.join(touched, "w")
    return out.select(
        calendar.month_at(F.col("w.event_t")).alias("event"), calendar.month_at(F.col("crossed_t")).alias("crossed_month"),
        (F.col("crossed_t") - F.col("w.event_t")).alias("delay"), "max_share", (F.col("_k") / F.col("n") * 100).alias("share_in_window"),
    )


def rank_view(monthly: DataFrame, events: Sequence[int]) -> DataFrame:
    """Average-tie rank of each observable month and its ratio to the quiet background."""
    early = [e for e in events if e < D.MIN_HISTORY]
    if early:
        raise ValueError(f"events before the first observable month {D.MIN_HISTORY}: {early}")
    seen = monthly.where(F.col("t") >= D.MIN_HISTORY).withColumn("is_event", F.col("t").isin(*events))
    # one row per month of the calendar, so whole-table windows are small
    everything = Window.partitionBy(F.lit(1))
    quiet = seen.where(~F.col("is_event")).agg(F.median("share").alias("background_median"))
    ranked = seen.withColumn("_one", F.lit(1)).withColumn("rank", average_rank("share", ["_one"])).withColumn("n_months", F.count(F.lit(1)).over(everything))
    out = with_scalars(ranked, quiet)
    return out.select(
        "month", "is_event", "share", "rank", "n_months", "background_median",
        (F.col("share") / F.when(F.col("background_median") != 0, F.col("background_median"))).alias("ratio_to_background"),
    )


def offline_breaks(series: DataFrame, detector: str, mode: str, penalties: Sequence[float], calendar: Calendar) -> DataFrame:
    """Breaks of the whole series, dated at the first month of the new level: ``series_id, penalty, t, month``."""
    rows = prepared(series.select("series_id", "y"), [mode])
    if detector == "cusum":
        alarm = D.cusum(F.col("z"))
        found = rows.select("series_id", F.lit(None).cast("double").alias("penalty"), (alarm + F.col("offset")).alias("t")).where(F.col("t").isNotNull())
    else:
        packed = rows.select("series_id", "offset", D.break_column(F.col("z"), detector, penalties).alias("b"))
        values = F.array(*[F.lit(float(p)) for p in penalties])
        each = packed.select("series_id", "offset", F.posexplode("b").alias("i", "at"))
        moved = F.transform("at", lambda b: b + F.col("offset"))
        found = each.select("series_id", F.get(values, F.col("i")).alias("penalty"), F.explode(moved).alias("t"))
    return found.withColumn("month", calendar.month_at(F.col("t")))


def offline_shares(breaks: DataFrame, series: DataFrame, calendar: Calendar) -> DataFrame:
    """Percent of series with a break per month and penalty, months without one at zero."""
    total = series.agg(F.count(F.lit(1)).alias("n_series"))
    counts = breaks.groupBy("penalty", "t").agg(F.count(F.lit(1)).alias("n_breaks"))
    packed = counts.groupBy("penalty").agg(F.map_from_entries(F.collect_list(F.struct("t", "n_breaks"))).alias("m"))
    grid = with_scalars(packed, total).select("penalty", "m", "n_series", F.explode(F.sequence(F.lit(0), F.lit(calendar.n_months - 1))).alias("t"))
    n = F.coalesce(F.try_element_at("m", F.col("t")), F.lit(0).cast("bigint"))
    return grid.select("penalty", "t", calendar.month_at(F.col("t")).alias("month"), n.alias("n_breaks"), (n / F.col("n_series") * 100).alias("share"))


def consensus_months(shares: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` months with the largest share of breaks."""
    return shares.orderBy(F.desc("share"), "t").limit(k)


def break_overlap(breaks: DataFrame, first: int, second: int) -> DataFrame:
    """Of the series breaking at the first event, how many break at the second, and how many in a December."""
    per_series = breaks.groupBy("series_id").agg(
        F.max((F.col("t") == first).cast("int")).alias("a"), F.max((F.col("t") == second).cast("int")).alias("b"),
        F.max((F.col("t") % 12 == 11).cast("int")).alias("december"),
    )
    return per_series.agg(
        F.coalesce(F.sum("a"), F.lit(0).cast("bigint")).alias("n_first"), F.coalesce(F.sum("b"), F.lit(0).cast("bigint")).alias("n_second"),
        F.count(F.when((F.col("a") == 1) & (F.col("b") == 1), 1)).alias("n_both"),
        F.count(F.when((F.col("a") == 1) & (F.col("december") == 1), 1)).alias("n_first_and_december"),
    ).withColumn("share_both", F.col("n_both") / F.when(F.col("n_first") > 0, F.col("n_first")))


def rate_change_rank(rate: DataFrame, events: Sequence) -> DataFrame:
    """Rank of the absolute monthly change of a rate, at event months. One row per month."""
    order = Window.partitionBy(F.lit(1)).orderBy("month")
    moved = rate.withColumn("change", F.col("value") - F.lag("value").over(order)).where(F.col("change").isNotNull())
    size = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.abs("change"), 9)))
    whole = Window.partitionBy(F.lit(1))
    ranked = moved.withColumn("rank", F.rank().over(size)).withColumn("n_months", F.count(F.lit(1)).over(whole))
    ranked = ranked.withColumn("is_max", F.col("change") == F.max("change").over(whole)).withColumn("is_min", F.col("change") == F.min("change").over(whole))
    return ranked.where(F.col("month").isin(*events)).select("month", "value", "change", "rank", "n_months", "is_max", "is_min")


def region_break_shares(breaks: DataFrame, regions: DataFrame, calendar: Calendar, first_t: int = 0, last_t: int | None = None) -> DataFrame:
    """Share of a region's series with a break, every region and month of the window present.

    Breaks are counted per region and month first; the grid is one map per region.
    """
    end = calendar.n_months - 1 if last_t is None else last_t
    members = regions.groupBy("region").agg(F.count(F.lit(1)).alias("n_series"))
    hits = breaks.select("series_id", "t").distinct().join(regions.select("series_id", "region"), "series_id")
    counts = hits.groupBy("region", "t").agg(F.count(F.lit(1)).alias("k"))
    packed = counts.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("t", "k"))).alias("m"))
    grid = members.join(packed, "region", "left").select(
        "region", "n_series", "m", F.explode(F.sequence(F.lit(first_t), F.lit(end))).alias("t"))
    k = F.coalesce(F.try_element_at("m", F.col("t")), F.lit(0).cast("bigint"))
    return grid.select("region", "t", calendar.month_at(F.col("t")).alias("month"), (k / F.col("n_series")).alias("break_share"), "n_series")


def allowed_range(n_months: int, mode: str, min_size: int = D.MIN_SIZE) -> tuple[int, int]:
    """First and last month a break can be dated at."""
    return min_size + D.OFFSET[mode], n_months - min_size


def window_checks(breaks: DataFrame, n_months: int, mode: str) -> DataFrame:
    """Breaks outside the reachable months (an error if any) and hits on its edges (an error if none)."""
    low, high = allowed_range(n_months, mode)
    t = F.col("t")
    return breaks.agg(
        F.count(F.lit(1)).alias("n_breaks"), F.count(F.when((t < low) | (t > high), 1)).alias("n_outside"),
        F.count(F.when(t == low, 1)).alias("n_first_edge"), F.count(F.when(t == high, 1)).alias("n_last_edge"),
    )


def check_window(breaks: DataFrame, n_months: int, mode: str) -> None:
    row = window_checks(breaks, n_months, mode).first()
    low, high = allowed_range(n_months, mode)
    if row["n_outside"]:
        raise ValueError(f"{row['n_outside']} breaks fall outside the reachable months {low}..{high}")
    if not row["n_first_edge"] or not row["n_last_edge"]:
        raise ValueError(f"no break reaches an edge of {low}..{high}; the window is wider than the detector")
