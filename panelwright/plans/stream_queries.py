"""Registered queries: streaming jobs, run until all available rows are processed."""
from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.plans import inputs as I, oracle as O
from panelwright.plans.break_queries import CLEANONLY, EVENTS, LIVE, with_sql
from panelwright.plans.oracle import r
from panelwright.plans.registry import ORACLES, query
from panelwright.plans.rounding import rounded
from panelwright.session import cut_lineage, work_path
from panelwright.streaming import jobs


# windows that the watermark (latest event minus an hour) has passed
@query("str_1_rollup", f"""WITH w AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events)
SELECT event_type AS key, CAST(date_trunc('day', ts) AS DATE) AS start, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS DATE) AS "end", count(*) AS n, {r('CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)', 2)} AS total
FROM events GROUP BY event_type, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT wm FROM w)""")
def rollup(spark, sf):
    path = work_path(spark, "rollup")
    schema = I.table(spark, sf, "events").schema
    events = jobs.read_stream(spark, sf, schema, glob="events.parquet")
    jobs.run_available(jobs.rollup(events, "event_type"), path, path + "-state")
    out = spark.read.parquet(path)
    return rounded(out.withColumn("start", F.to_date("start")).withColumn("end", F.to_date("end")), 2)


def points(spark, sf):
    """The cleaned panel as ``key, ts, t, value``, as it might arrive: two parts by month, then a heartbeat.

    One month comes late, after the month that follows it; another comes twice.
    """
    rows = I.total_clean(spark, sf).select(
        F.col("series_id").alias("key"), I.CALENDAR.month_at(F.col("t")).cast("timestamp").alias("ts"), F.col("t").cast("int").alias("t"), F.col("y").alias("value"))
    rows = cut_lineage(rows, "points")
    middle = I.CALENDAR.n_months // 2
    early = (F.col("t") <= middle) & (F.col("t") != middle - 1)
    again = rows.where(F.col("t") == middle - 3).withColumn("value", F.col("value") * 7)
    return [rows.where(early), rows.where(~early).unionByName(again), jobs.heartbeat(rows)]


def _replayed(spark, sf, name, job, kind):
    path = work_path(spark, name)
    jobs.replay(spark, points(spark, sf), path + "-source", lambda s: jobs.run_available(job(s), path, path + "-state"))
    return spark.read.parquet(path).where(F.col("kind") == kind)


@query("str_2_online_cusum", with_sql(CLEANONLY, "SELECT series_id AS key, CAST(a AS INTEGER) AS alarm FROM alarm JOIN cids USING (cid) WHERE mode = 'raw'"))
def online_cusum(spark, sf):
    return _replayed(spark, sf, "cusum", jobs.online_cusum, "alarm").select("key", F.col("t").alias("alarm"))


@query("str_3_live_episodes", with_sql(LIVE, "SELECT series_id AS key, t FROM ep"))
def live_episodes(spark, sf):
    return _replayed(spark, sf, "episodes", lambda s: jobs.live_episodes(s, "cusum", "raw"), "start").select("key", "t")


@query("str_3_live_episodes_pelt")
def live_episodes_pelt(spark, sf):
    return _replayed(spark, sf, "episodes-pelt", lambda s: jobs.live_episodes(s, "pelt", "ratio", 1.0), "start").select("key", "t")


def _folded(spark, sf):
    """Folder of the month counts and event windows of a stream that has ended."""
    path = work_path(spark, "shares")
    jobs.replay(spark, points(spark, sf), path + "-source",
                lambda s: jobs.month_counts(jobs.live_episodes(s, "cusum", "raw"), path, path + "-state", EVENTS))
    total = I.total_arrays(spark, sf).agg(F.count(F.lit(1)).alias("n_series"))
    return path, jobs.online_shares(spark, path, total, I.CALENDAR, 3.0)


@query("str_4_online_shares", with_sql(LIVE, f"SELECT t, n_signals, {r('share')} AS share, share >= 3 AS crossed FROM mon"))
def online_shares(spark, sf):
    return rounded(_folded(spark, sf)[1].select("t", "n_signals", "share", "crossed"))


@query("str_4_online_events", ORACLES["cp_24_realtime_events"])
def online_events(spark, sf):
    path, shares = _folded(spark, sf)
    return rounded(jobs.online_events(spark, path, shares, EVENTS, I.CALENDAR))


# the rollup feeds the online detector: daily sums per user, then the first alarm
@query("str_2_online_cusum_events")
def online_cusum_events(spark, sf):
    path = work_path(spark, "daily")
    schema = I.table(spark, sf, "events").schema
    events = jobs.read_stream(spark, sf, schema, glob="events.parquet")
    jobs.run_available(jobs.rollup(events, "user_id"), path, path + "-state")
    daily = spark.read.parquet(path).select(
        F.col("key").cast("string").alias("key"), F.col("start").alias("ts"), F.datediff("start", F.lit("2024-01-01")).alias("t"), F.col("total").alias("value"))
    out = work_path(spark, "alarms")
    jobs.replay(spark, [daily, jobs.heartbeat(daily, delay=1)], out + "-source",
                lambda s: jobs.run_available(jobs.online_cusum(s, delay=1), out, out + "-state"))
    return spark.read.parquet(out).where("kind = 'alarm'").select("key", F.col("t").alias("alarm"))
