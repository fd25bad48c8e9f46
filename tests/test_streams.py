"""Streams with points out of order, late, twice or missing, against plain loops over the sorted points."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.protocol import Calendar
from panelwright.session import work_path
from panelwright.streaming import jobs

CAL = Calendar(dt.date(2001, 1, 1), 40)
DDL = "key string, ts timestamp, t int, value double"


def point(key, t, value):
    m = CAL.month(t)
    return key, dt.datetime(m.year, m.month, m.day), t, float(value)


def panel(n=6, months=40, seed=1):
    """Noise with a step for odd series; values by key and month."""
    draw = random.Random(seed)
    return {f"s{k}": {t: 100 + draw.gauss(0, 1) + (30 if k % 2 and t >= 20 + k else 0) for t in range(months)} for k in range(n)}


def run(spark, job, parts, schema="key string, kind string, t int"):
    """Rows told by a job that gets the parts one after another and then a heartbeat."""
    path = work_path(spark, "told")
    frames = [spark.createDataFrame(p, DDL) for p in parts if p]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    jobs.replay(spark, [*frames, jobs.heartbeat(every)], path + "-source", lambda s: jobs.run_available(job(s), path, path + "-state"))
    return sorted((r.key, r.kind, r.t) for r in spark.read.schema(schema).parquet(path).collect())


def cusum_loop(values):
    """First alarm of the sorted points, once there are eight."""
    ts, z = sorted(values), [values[t] for t in sorted(values)]
    if len(z) < 8:
        return None
    mu, sigma = jobs._baseline(z[:6])
    pos = neg = 0.0
    for t, v in zip(ts[6:], z[6:]):
        pos, neg = max(0.0, pos + v - mu - 0.5 * sigma), min(0.0, neg + v - mu + 0.5 * sigma)
        if max(pos, -neg) > 5 * sigma:
            return t
    return None


def episodes_loop(values, mode):
    """Starts of the expanding window, each month from the beginning; gaps stay gaps."""
    out, flagged = [], -100
    for t in sorted(values):
        seen = {u: v for u, v in values.items() if u <= t}
        if mode == "ratio":
            seen = {u: (v - seen[u - 1]) / seen[u - 1] for u, v in seen.items() if u - 1 in seen}
        alarm = cusum_loop(seen)
        if t >= 8 and alarm is not None and alarm >= t - 3:
            if t - flagged > 3:
                out.append(t)
            flagged = t
    return out


def test_points_out_of_order_are_put_in_their_place(spark):
    data = panel()
    rows = [point(k, t, v) for k, own in data.items() for t, v in own.items()]
    late = [r for r in rows if r[2] in (9, 19)]  # each comes after the month that follows it
    parts = [[r for r in rows if r[2] <= 10 and r not in late], [r for r in rows if (r[2] == 9 or 10 < r[2] <= 20) and r[2] != 19], [r for r in rows if r[2] >= 19 and r[2] != 20]]
    found = run(spark, jobs.online_cusum, parts)
    want = sorted((k, "alarm", a) for k, own in data.items() if (a := cusum_loop(own)) is not None)
    assert found == want and len(want) >= 3


def test_late_and_duplicate_points_are_told_and_change_nothing(spark):
    data = panel()
    rows = [point(k, t, v) for k, own in data.items() for t, v in own.items()]
    again = [point("s1", 19, 10_000.0), point("s3", 17, -10_000.0)]  # 19 still waits for the watermark, 17 doesn't
    found = run(spark, jobs.online_cusum, [[r for r in rows if r[2] < 20], again, [r for r in rows if r[2] >= 20]])
    want = [(k, "alarm", a) for k, own in data.items() if (a := cusum_loop(own)) is not None]
    assert found == sorted([*want, ("s1", "duplicate", 19), ("s3", "late", 17)])


def test_an_alarm_waits_for_two_points_beyond_the_baseline(spark):
    jump = [1.0, 2.0, 1.0, 2.0, 1.0, 2.0, 900.0]
    seven = [point("a", t, v) for t, v in enumerate(jump)]
    eight = [point("b", t, v) for t, v in enumerate([*jump, 1.0])]
    assert run(spark, jobs.online_cusum, [seven, eight]) == [("b", "alarm", 6)]


@pytest.mark.parametrize("mode", ["raw", "ratio"])
def test_a_missing_month_moves_no_other(spark, mode):
    data = panel(seed=3)
    for k, own in data.items():
        for t in (3, 13, 24)[: 1 + int(k[1:]) % 3]:
            del own[t]
    rows = [point(k, t, v) for k, own in data.items() for t, v in own.items()]
    found = run(spark, lambda s: jobs.live_episodes(s, "cusum", mode), [[r for r in rows if r[2] < 15], [r for r in rows if r[2] >= 15]])
    assert found == sorted((k, "start", t) for k, own in data.items() for t in episodes_loop(own, mode)) and found


def test_segments_with_a_missing_month(spark):
    data = {"a": {t: (1.0 if t < 14 else 9.0) + 0.01 * (t % 2) for t in range(24) if t != 6}}
    rows = [point("a", t, v) for t, v in data["a"].items()]
    found = run(spark, lambda s: jobs.live_episodes(s, "pelt", "raw", 1.0), [rows[:12], rows[12:]])
    assert [t for _, _, t in found] and all(14 <= t <= 17 for _, _, t in found)
    with pytest.raises(KeyError):
        jobs.live_episodes(spark.createDataFrame(rows, DDL), "cusum", "deseason")


def test_running_sums_do_not_grow():
    """The state after many months is as large as after few."""
    own = jobs.CUSUM_START
    for t in range(1000):
        own = jobs.cusum_step(own, t, float(np.sin(t)), 5.0, 6)
        assert len(own[1]) <= 6
    assert own[0] == 1000


def test_shares_have_zero_months_and_end_where_the_stream_is(spark):
    data = panel()
    rows = [point(k, t, v) for k, own in data.items() for t, v in own.items()]
    path, events = work_path(spark, "shares"), (5, 18, 30)
    n = spark.createDataFrame([(len(data),)], "n_series long")
    job = lambda s: jobs.month_counts(jobs.live_episodes(s, "cusum", "raw"), path, path + "-state", events)
    starts = [(k, t) for k, own in data.items() for t in episodes_loop(own, "raw")]

    def shares():
        return jobs.online_shares(spark, path, n, CAL, 30.0)

    first = spark.createDataFrame([r for r in rows if r[2] < 29], DDL)
    jobs.replay(spark, [first], path + "-source", job)
    early = {r.t: r.n_signals for r in shares().collect()}
    assert sorted(early) == list(range(max(early) + 1)) and 25 <= max(early) < 28  # the last months wait for the watermark
    assert early == {t: sum(u == t for _, u in starts) for t in early}
    closed = jobs.online_events(spark, path, shares(), events, CAL).collect()
    assert [r.event for r in sorted(closed)] == [CAL.month(5)]  # the second window ends later

    rest = spark.createDataFrame([r for r in rows if r[2] >= 29], DDL)
    jobs.replay(spark, [rest, jobs.heartbeat(rest)], path + "-source", job)
    assert {r.t: r.n_signals for r in shares().collect()} == {t: sum(u == t for _, u in starts) for t in range(40)}
    table = {r.event: r for r in jobs.online_events(spark, path, shares(), events, CAL).collect()}
    assert sorted(table) == [CAL.month(e) for e in events]
    for a, z in ((5, 18), (18, 30), (30, 40)):
        by_month = {t: 100 * sum(u == t for _, u in starts) / len(data) for t in range(a, z)}
        over = [t for t, s in by_month.items() if s >= 30]
        row = table[CAL.month(a)]
        assert row.max_share == pytest.approx(max(by_month.values())) and row.share_in_window == pytest.approx(100 * len({k for k, t in starts if a <= t < z}) / len(data))
        assert row.crossed_month == (CAL.month(min(over)) if over else None) and row.delay == (min(over) - a if over else None)


def test_a_stream_without_points_has_no_heartbeat(spark):
    assert jobs.heartbeat(spark.createDataFrame([], DDL)).count() == 0
    assert jobs.heartbeat(spark.createDataFrame([point("a", 3, 1.0)], DDL)).select(F.col("ts") > F.lit("2001-05-05")).first()[0]


def test_many_series_share_few_states(spark):
    """More series than buckets: each is told as alone, and the state has a row for a bucket, not for a series."""
    rows = {f"k{k}": {t: 100 + (t % 3) + (50 if k % 3 == 0 and t >= 12 else 0) for t in range(16)} for k in range(jobs.BUCKETS + 476)}
    points = [point(k, t, v) for k, ts in rows.items() for t, v in ts.items()]
    path = work_path(spark, "many")
    frame = spark.createDataFrame(points, DDL)
    frame.unionByName(jobs.heartbeat(frame)).write.parquet(path + "-source")
    stream = jobs.online_cusum(jobs.read_stream(spark, path + "-source", frame.schema))
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= jobs.BUCKETS
    found = {(r.key, r.kind, r.t) for r in spark.read.parquet(path).collect()}
    assert found == {(k, "alarm", cusum_loop(ts)) for k, ts in rows.items() if cusum_loop(ts) is not None}
    assert found
