"""Structured Streaming: rollup, online CUSUM, live episodes, online month shares.

Every job reads what is available, keeps its state in the checkpoint and can be started again on the
same checkpoint. Points of a key are taken in event time, not in the order of arrival: they wait in the
state until the watermark has passed them. A point that comes after its place has been passed is not
taken but told (``late``), and so is a second point of one place (``duplicate``); points older than the delay and the
``grace`` together are dropped by Spark and counted in its progress. Rows of the key :data:`HEARTBEAT` only move the event
time on, so that the last points of a quiet source are released too.
"""
from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

# names, not the module: the functions below travel to the workers by value
from panelwright.operators.detectors import BASELINE, MIN_HISTORY, MIN_SIZE, RECENT, breaks_near_ends
from panelwright.protocol import Calendar

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEARTBEAT = ""
DAY = 86_400_000
#: A point may come so many days after later ones and be put in its place; it is told as late for so many more.
DELAY, GRACE = 35, 366


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, append to a table, stop."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def rollup(events: DataFrame, key: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and sums per key and time window; a window is final once the watermark passes it.

    The aggregate combines map-side, so a hot key costs one row per task and window.
    """
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), F.col(key).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
        .select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", F.col("total").cast("double").alias("total"))
    )


WAITING = "last int, wait_t array<int>, wait_ms array<bigint>, wait_v array<double>"
#: Series share the state of a bucket by hash: for one series, the call into Python costs many times its own steps.
BUCKETS = 1024
Advance = Callable[[tuple, list[tuple[int, float]]], tuple[tuple, list[int]]]


def in_event_time(points: DataFrame, start: tuple, own_state: str, advance: Advance, kind: str, delay: int, grace: int, buckets: int = BUCKETS) -> DataFrame:
    """``key, kind, t``: what ``advance`` tells of the points of a batch, in event time; late and duplicate points too.

    ``points`` has ``key string, ts timestamp, t int, value double``; ``t`` grows with ``ts``. The state of a
    key holds the waiting points, which the delay bounds, and ``own_state``. Raise ``buckets`` with the number of
    keys, before the first run on a checkpoint: the states of a bucket are read and written together.
    """
    def step(_, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {x[0]: (tuple(x[1:-4]), x[-4], {t: (ms, v) for t, ms, v in zip(*x[-3:])}) for x in state.get[0]} if state.exists else {}
        out: list[tuple[str, str, int]] = []
        for batch in batches:
            stamps = batch["ts"].to_numpy().astype("datetime64[ms]").astype("int64").tolist()
            for key, ms, t, value in zip(batch["key"].tolist(), stamps, batch["t"].tolist(), batch["value"].tolist()):
                if key == HEARTBEAT:
                    continue
                if key not in held:
                    held[key] = (start, -(1 << 31), {})
                _, last, waiting = held[key]
                if t <= last:
                    out.append((key, "late", t))
                elif t in waiting:
                    out.append((key, "duplicate", t))
                else:
                    waiting[t] = (ms, float(value))
        if not held:
            return
        passed = state.getCurrentWatermarkMs() + grace * DAY
        kept, earliest = [], None
        for key, (own, last, waiting) in held.items():
            due = sorted(t for t, (ms, _) in waiting.items() if ms <= passed)
            if due:
                own, told = advance(own, [(t, waiting.pop(t)[1]) for t in due])
                out += [(key, kind, x) for x in told]
                last = due[-1]
            left = sorted(waiting)
            stamps = [waiting[t][0] for t in left]
            if left:
                earliest = min(stamps) if earliest is None else min(earliest, *stamps)
            kept.append((key, *own, int(last), left, stamps, [waiting[t][1] for t in left]))
        state.update((kept,))
        if earliest is not None:
            state.setTimeoutTimestamp(max(earliest - grace * DAY - 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"key": [k for k, _, _ in out], "kind": [x for _, x, _ in out], "t": pd.Series([t for _, _, t in out], dtype="int32")})

    marked = points.select("key", "ts", "t", "value").withWatermark("ts", f"{delay + grace} days")
    dealt = marked.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInPandasWithState(
        step, "key string, kind string, t int", f"series array<struct<key string, {own_state}, {WAITING}>>", "append", "EventTimeTimeout")


CUSUM_STATE = "seen int, buffer array<double>, mu double, sigma double, pos double, neg double, alarm int"
CUSUM_START = (0, [], 0.0, 1.0, 0.0, 0.0, -1)


def _baseline(values: list[float]) -> tuple[float, float]:
    base = np.asarray(values, dtype=float)
    mu = float(np.median(base))
    mad = float(np.median(np.abs(base - mu)))
    spread = float(np.std(base))
    return mu, 1.4826 * mad if mad > 0 else (spread if spread > 0 else 1.0)


def cusum_step(own: tuple, t: int, value: float, threshold: float, baseline: int) -> tuple:
    """The running sums after one more point; ``alarm`` is the place of the first alarm, or -1."""
    seen, buffer, mu, sigma, pos, neg, alarm = own
    if seen < baseline:
        buffer = [*buffer, float(value)]
        if len(buffer) == baseline:
            mu, sigma = _baseline(buffer)
    elif alarm < 0:
        pos = max(0.0, pos + (value - mu) - 0.5 * sigma)
        neg = min(0.0, neg + (value - mu) + 0.5 * sigma)
        if pos > threshold * sigma or -neg > threshold * sigma:
            alarm = int(t)
    return int(seen) + 1, list(buffer), float(mu), float(sigma), float(pos), float(neg), int(alarm)


def online_cusum(points: DataFrame, threshold: float = 5.0, baseline: int = BASELINE, delay: int = DELAY, grace: int = GRACE) -> DataFrame:
    """First alarm per key (kind ``alarm``), once there are two points beyond the baseline; the cost of a point is constant."""

    def advance(own: tuple, due: list[tuple[int, float]]) -> tuple[tuple, list[int]]:
        before = own[-1] if own[0] >= baseline + 2 else -1
        for t, value in due:
            own = cusum_step(own, t, value, threshold, baseline)
        return own, [own[-1]] if own[-1] >= 0 and before < 0 and own[0] >= baseline + 2 else []

    return in_event_time(points, CUSUM_START, CUSUM_STATE, advance, "alarm", delay, grace)


def _growth(previous: tuple[int, float] | None, t: int, value: float, mode: str) -> float | None:
    """The detector's value of a month; None where it needs the month before and that is missing."""
    if mode == "raw":
        return value
    if mode != "ratio":
        raise KeyError(f"unknown streaming mode {mode!r}; known: raw, ratio")
    if previous is None or previous[0] != t - 1:
        return None
    grown = (value - previous[1]) / previous[1] if previous[1] else 0.0
    return grown if np.isfinite(grown) else 0.0


EPISODE_STATE = f"{CUSUM_STATE}, z_t array<int>, z array<double>, y_t int, y double, flagged int"
EPISODE_START = (*CUSUM_START, [], [], -(1 << 31), 0.0, -(1 << 31))


def live_episodes(points: DataFrame, detector: str, mode: str, penalty: float | None = None, delay: int = DELAY, grace: int = GRACE) -> DataFrame:
    """Episode starts (kind ``start``) of an expanding-window detector; ``t`` is the month's place in the calendar.

    A missing month stays missing: it moves no other month, and a mode that needs the month before has no
    value after it. CUSUM goes on from its running sums; the segmentation detectors see all months so
    far again, so their state and cost grow with the months of a key.
    """
    _growth(None, 0, 0.0, mode)

    def advance(own: tuple, due: list[tuple[int, float]]) -> tuple[tuple, list[int]]:
        sums, (z_t, z, y_t, y, flagged) = own[:7], own[7:]
        z_t, z, ends, near = list(z_t), list(z), [], []
        for t, value in due:
            grown = _growth(None if y_t < 0 else (y_t, y), t, value, mode)
            if grown is not None:
                if detector == "cusum":
                    sums = cusum_step(sums, t, grown, 5.0, BASELINE)
                else:
                    z_t.append(t)
                    z.append(float(grown))
            y_t, y = t, value
            if t >= MIN_HISTORY and detector == "cusum" and sums[0] >= BASELINE + 2 and 0 <= sums[6] and sums[6] >= t - RECENT:
                near.append(t)
            elif t >= MIN_HISTORY and detector != "cusum" and len(z) >= 2 * MIN_SIZE:
                ends.append((t, len(z)))
        if ends:
            places = np.asarray(z_t)
            first = [int(np.searchsorted(places[:size], t - RECENT)) for t, size in ends]
            told = breaks_near_ends(detector, np.asarray(z, dtype=float), penalty, [size for _, size in ends], first)
            near = [t for (t, _), here in zip(ends, told) if here]
        starts = []
        for t in near:
            if t - flagged > RECENT:
                starts.append(t)
            flagged = t
        return (*sums, z_t, z, int(y_t), float(y), int(flagged)), starts

    return in_event_time(points, EPISODE_START, EPISODE_STATE, advance, "start", delay, grace)


def month_counts(episodes: DataFrame, path: str, checkpoint: str, events: Sequence[int] = (), grace: int = GRACE) -> None:
    """Fold every batch of episode starts to counts per month, and to series per event window.

    A batch overwrites its own folder, so a batch replayed after a failure counts once. At the end the
    event time that the run has passed is written beside the counts.
    """
    ordered = sorted(events)

    def fold(batch: DataFrame, batch_id: int) -> None:
        batch = batch.where("kind = 'start'").persist()
        batch.groupBy("t").agg(F.count(F.lit(1)).alias("n_signals")).write.mode("overwrite").parquet(f"{path}/months/batch={batch_id}")
        if ordered:
            spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a, z in zip(ordered, [*ordered[1:], (1 << 31) - 1])])
            inside = batch.select("key", "t", F.explode(spans).alias("w")).where("t >= w.a and t < w.z")
            inside.select(F.col("w.a").alias("event_t"), "key").distinct().write.mode("overwrite").parquet(f"{path}/windows/batch={batch_id}")
        batch.unpersist()

    query = (
        episodes.writeStream.foreachBatch(fold).outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    reached = max((p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in (p["eventTime"] or {})), default=None)
    if reached is not None:
        spark = episodes.sparkSession
        passed = spark.createDataFrame([(reached,)], "ts string").select((F.to_timestamp("ts") + F.expr(f"interval {grace} days")).alias("passed"))
        passed.write.parquet(f"{path}/progress/run={uuid.uuid4().hex}")


def closed_months(spark: SparkSession, path: str, calendar: Calendar) -> DataFrame:
    """The calendar joined to the progress of the stream: ``t, month`` of the months it has passed."""
    passed = spark.read.parquet(f"{path}/progress").agg(F.max("passed").alias("passed"))
    months = passed.select("passed", F.explode(F.sequence(F.lit(0), F.lit(calendar.n_months - 1))).alias("t"))
    return months.withColumn("month", calendar.month_at(F.col("t"))).where(F.col("month").cast("timestamp") <= F.col("passed")).select("t", "month")


def online_shares(spark: SparkSession, path: str, n_series: DataFrame, calendar: Calendar, threshold: float) -> DataFrame:
    """Share per closed month from the folded counts, months without a start at zero, and whether it crossed the threshold."""
    from panelwright.functions.frames import with_scalars

    monthly = spark.read.parquet(f"{path}/months").groupBy("t").agg(F.sum("n_signals").alias("n_signals"))
    every = with_scalars(closed_months(spark, path, calendar).join(monthly, "t", "left"), n_series)
    n = F.coalesce("n_signals", F.lit(0).cast("bigint"))
    share = n / F.when(F.col("n_series") > 0, F.col("n_series")) * 100
    return every.select("t", "month", n.alias("n_signals"), "n_series", share.alias("share"), (share >= threshold).alias("crossed"))


def online_events(spark: SparkSession, path: str, shares: DataFrame, events: Sequence[int], calendar: Calendar) -> DataFrame:
    """Events whose window (to the next event) the stream has passed: first month over the threshold, delay, peak, series with any start."""
    ordered = sorted(events)
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a, z in zip(ordered, [*ordered[1:], calendar.n_months])])
    windows = shares.select("t", "share", "crossed", "n_series", F.explode(spans).alias("w")).where("t >= w.a and t < w.z")
    rows = windows.groupBy("w").agg(
        F.min(F.when(F.col("crossed"), F.col("t"))).alias("crossed_t"), F.max("share").alias("max_share"), F.max("n_series").alias("n"), F.max("t").alias("reached"))
    touched = spark.read.parquet(f"{path}/windows").groupBy("event_t").agg(F.count_distinct("key").alias("k"))
    # a window is told when its last month is closed
    closed = rows.where("reached = w.z - 1").join(touched, F.col("w.a") == F.col("event_t"), "left")
    return closed.select(
        calendar.month_at(F.col("w.a")).alias("event"), calendar.month_at(F.col("crossed_t")).alias("crossed_month"), (F.col("crossed_t") - F.col("w.a")).alias("delay"),
        "max_share", (F.coalesce("k", F.lit(0)) / F.col("n") * 100).alias("share_in_window"))


def heartbeat(points: DataFrame, delay: int = DELAY) -> DataFrame:
    """One row that closes a source: the event time goes past its last point and the delay."""
    last = points.agg(F.max("ts").alias("ts"), F.max("t").alias("t"))
    return last.where("ts is not null").select(
        F.lit(HEARTBEAT).alias("key"), (F.col("ts") + F.expr(f"interval {delay + 1} days")).alias("ts"), (F.col("t") + 1).alias("t"), F.lit(0.0).alias("value"))


def replay(spark: SparkSession, parts: list[DataFrame], source: str, build: Callable[[DataFrame], None]) -> None:
    """Feed a stream in stages: append a part, run the job on the same checkpoint, go on."""
    for part in parts:
        part.write.mode("append").parquet(source)
        build(read_stream(spark, source, part.schema))
