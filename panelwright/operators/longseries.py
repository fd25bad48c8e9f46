"""Forecasts of long aggregate series, chosen by a back-test on their own history.

Everything is keyed by ``(series_key, origin)``: the national aggregate, every industry
series and every origin are rows of one job. A history is an array of logs, bounded by
the length of the calendar.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions import arrays as A

Candidate = Callable[[Column, Column], Column]


def cut_at(series: DataFrame, origin: Column) -> DataFrame:
    """The only door to a long series: months up to the origin."""
    return series.where(F.col("month") <= origin)


def log_history(series: DataFrame, keys: Sequence[str] = ("series_key",)) -> DataFrame:
    """``keys, months, h``: the sorted months and the logs of the values."""
    points = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("month", "value"))).alias("p"))
    return points.select(
        *keys, F.transform("p", lambda x: x["month"]).alias("months"), F.transform("p", lambda x: F.log(x["value"])).alias("h")
    )


def _steps(horizon: Column) -> Column:
    return F.sequence(F.lit(0), horizon - 1)


def random_walk(h: Column, horizon: Column) -> Column:
    return F.array_repeat(A.at(h, F.size(h) - 1), horizon)


def seasonal_naive(h: Column, horizon: Column) -> Column:
    """Last value plus the change seen over the same months a year earlier."""
    n = F.size(h)
    last, anchor = A.at(h, n - 1), A.at(h, n - 13)
    moved = F.transform(_steps(horizon), lambda k: last + (F.get(h, n - 12 + k % 12) - anchor))
    return F.when(n < 13, random_walk(h, horizon)).otherwise(moved)


def seasonal_median(h: Column, horizon: Column) -> Column:
    """Cumulative median of the log changes seen in the same position of the year."""
    def walk(changes: Column) -> Column:
        n = F.size(changes) + 1  # points of the history
        typical = F.transform(
            _steps(horizon),
            lambda k: F.coalesce(A.median(F.filter(changes, lambda d, i: (i + 1) % 12 == (n + k) % 12)), A.median(changes)),
        )
        start = A.at(h, F.size(h) - 1)
        return A.let(typical, lambda m: F.transform(m, lambda _, i: start + A.total(F.slice(m, 1, i + 1))))

    return F.when(F.size(h) < 25, seasonal_naive(h, horizon)).otherwise(A.let(A.diffs(h), walk))


# order matters: the first of equal scores wins
SQL_CANDIDATES: dict[str, Candidate] = {
    "seasonal_naive": seasonal_naive,
    "seasonal_median": seasonal_median,
    "random_walk": random_walk,
}


def candidate(name: str) -> Candidate:
    if name not in SQL_CANDIDATES:
        raise KeyError(f"unknown aggregate model {name!r}; known: {sorted(SQL_CANDIDATES)}")
    return SQL_CANDIDATES[name]


def forecast_all(
    histories: DataFrame,
    horizon: int | Column,
    candidates: Mapping[str, Candidate] | None = None,
    solvers: Sequence[str] = (),
) -> DataFrame:
    """``histories`` (with ``h``) x candidate -> ``model, ord, path`` (NULL where a candidate failed).

    ``horizon`` may be a column, so histories with different horizons share one job.
    ``solvers`` names iterative candidates; all of them run in one Arrow-batched pass.
    """
    from panelwright.operators import solvers as S

    ahead = F.lit(horizon) if isinstance(horizon, int) else horizon
    known = SQL_CANDIDATES if candidates is None else candidates
    rows = histories
    paths = {k: fn(F.col("h"), ahead) for k, fn in known.items()}
    if solvers:
        rows = rows.withColumn("_s", S.forecast_columns(F.col("h"), ahead, tuple(solvers)))
        walk = paths.pop("random_walk")  # registration order: naive, median, solvers, walk
        paths |= {k: F.col("_s")[k]["forecast"] for k in solvers}
        paths["random_walk"] = walk
    runs = [
        F.struct(F.lit(i).alias("ord"), F.lit(k).alias("model"), path.alias("path")) for i, (k, path) in enumerate(paths.items())
    ]
    out = rows.select("*", F.explode(F.array(*runs)).alias("c")).select("*", "c.*").drop("c")
    return out.drop("_s") if solvers else out


def inner_origins(history: DataFrame, horizon: Column, n_origins: int = 24) -> DataFrame:
    """Each history once whole (``inner`` NULL) and once per back-test origin.

    Origins run from ``max(36 + horizon, n - 24)`` to ``n - horizon``.
    """
    n = F.size("h")
    first, last = F.greatest(F.lit(36) + horizon, n - n_origins), n - horizon
    origins = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    spread = history.withColumn("inner", F.explode(F.concat(origins, F.array(F.lit(None).cast("int")))))
    return spread.withColumn("full", F.col("h")).withColumn("h", A.head(F.col("full"), F.coalesce("inner", n)))


def forecast_best(
    histories: DataFrame,
    keys: Sequence[str],
    horizon: int | Column,
    n_origins: int = 24,
    candidates: Mapping[str, Candidate] | None = None,
    solvers: Sequence[str] = (),
) -> DataFrame:
    """``keys, model, explained, path, last``: back-test and final forecast in one pass.

    The winner has the least squared error of the log change. No origin, no random walk
    score or a perfect random walk gives ``random_walk, 0``.
    """
    ahead = F.lit(horizon) if isinstance(horizon, int) else horizon
    tried = forecast_all(inner_origins(histories, ahead, n_origins), ahead, candidates, solvers)
    final = F.col("inner").isNull()
    actual = A.window(F.col("full"), F.col("inner"), ahead)
    squares = A.total(F.zip_with("path", actual, lambda p, a: (p - a) * (p - a)))
    scored = tried.withColumn("sq", F.when(~final & F.col("path").isNotNull(), squares)).withColumn(
        "k", F.when(F.col("sq").isNotNull(), ahead)
    )
    by_model = scored.groupBy(*keys, "model", "ord").agg(
        (F.sum("sq") / F.sum("k")).alias("mse"),
        F.max(F.when(final, F.col("path"))).alias("path"),
        F.max(F.when(final, A.at(F.col("h"), F.size("h") - 1))).alias("last"),
    )
    walk = F.col("model") == "random_walk"
    best = by_model.groupBy(*keys).agg(
        F.min(F.when(F.col("mse").isNotNull(), F.struct("mse", "ord", "model", "path"))).alias("b"),
        F.max(F.when(walk, F.col("mse"))).alias("rw"),
        F.max(F.when(walk, F.col("path"))).alias("rw_path"),
        F.max("last").alias("last"),
    )
    none = F.col("b").isNull() | F.col("rw").isNull() | (F.col("rw") <= 0)
    explained = 1.0 - F.col("b.mse") / F.col("rw")
    return best.select(
        *keys,
        F.when(none, F.lit("random_walk")).otherwise(F.col("b.model")).alias("model"),
        F.when(none, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), explained))).alias("explained"),
        F.when(none, F.col("rw_path")).otherwise(F.col("b.path")).alias("path"),
        "last",
    )


def choose_model(
    histories: DataFrame,
    keys: Sequence[str],
    horizon: int | Column,
    n_origins: int = 24,
    candidates: Mapping[str, Candidate] | None = None,
    solvers: Sequence[str] = (),
) -> DataFrame:
    """Winner per key and the share of the random-walk error it explains."""
    return forecast_best(histories, keys, horizon, n_origins, candidates, solvers).select(*keys, "model", "explained")


def origins_of(series: DataFrame, keys: Sequence[str], origins: Column) -> DataFrame:
    """Repeat each history for a literal array of origin structs (``origin`` date first), cut there."""
    packed = log_history(series, keys)
    spread = packed.select(*keys, "months", "h", F.explode(origins).alias("o")).select(*keys, "months", "h", "o.*")
    size = F.size(F.filter("months", lambda m: m <= F.col("origin")))
    return spread.withColumn("h", F.slice("h", 1, size)).withColumn("months", F.slice("months", 1, size))


def walk_forward(series: DataFrame, horizon: int, model: DataFrame, keys: Sequence[str] = ("series_key",),
                 first_position: int = 25, kind: str = "change") -> DataFrame:
    """Residuals of the chosen model from every position on: ``keys, month, step, residual``.

    ``kind="change"`` compares log changes, ``"level"`` log levels; the two differ only by
    where the forecast starts, which cancels, so both are kept for their callers' names.
    """
    packed = log_history(series, keys)
    starts = packed.select(
        *keys, "months", F.col("h").alias("full"), F.explode(F.sequence(F.lit(first_position), F.size("h") - 1)).alias("pos")
    ).withColumn("h", F.slice("full", 1, F.col("pos") + 1))
    tried = forecast_all(starts, horizon).join(model.select(*keys, "model"), [*keys, "model"])
    steps = tried.select(
        *keys, F.element_at("months", F.col("pos") + 1).alias("month"), "pos", "full",
        F.posexplode("path").alias("k", "predicted"),
    )
    actual = F.get("full", F.col("pos") + F.col("k") + 1)
    return steps.select(
        *keys, "month", "pos", (F.col("k") + 1).alias("step"), (actual - F.col("predicted")).alias("residual")
    ).where(F.col("residual").isNotNull())
