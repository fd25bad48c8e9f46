"""Iterative forecasters, batched.

Exponential smoothing and ARIMA are linear filters: for given parameters the one-step
errors are a matrix times the series, minus a matrix times the initial state. So a grid
of parameters is searched for all series of an Arrow batch with matrix products. The
objective is the sum of squared one-step errors with the best initial state.
"""
from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SOLVERS = ("theta", "ets_damped", "ets_seasonal", "arima111", "arima011", "ets", "sarima")
SEASON = {"ets_seasonal": 4, "ets": 12}
SHORTEST = {"ets_seasonal": 9, "ets": 26, "sarima": 30}
CHUNK = 256


def _mesh(*axes):
    return [a.ravel() for a in np.meshgrid(*axes, indexing="ij")]


def _system(kind: str):
    """Stacked ``transition, gain, observation`` and the basis of free initial states."""
    if kind in ("theta", "arima011"):
        alpha = np.linspace(0.02, 1.0 if kind == "theta" else 1.98, 99 if kind == "arima011" else 50)
        g = len(alpha)
        return np.ones((g, 1, 1)), alpha[:, None], np.ones((g, 1)), np.eye(1)
    if kind == "arima111":
        phi, theta = _mesh(np.linspace(-0.9, 0.9, 13), np.linspace(-0.9, 0.9, 13))
        g, one, zero = len(phi), np.ones_like(phi), np.zeros_like(phi)
        move = np.stack([np.stack([one, one], 1), np.stack([zero, phi], 1)], 1)
        return move, np.stack([one, phi + theta], 1), np.ones((g, 2)), np.eye(2)
    m = SEASON.get(kind, 0)
    if m:
        alpha, share, phi, gamma = _mesh(
            np.linspace(0.05, 0.9, 6), np.array([0.01, 0.1, 0.4]), np.array([0.8, 0.9, 0.98]), np.array([0.01, 0.1, 0.3, 0.6])
        )
        gamma = gamma * (1 - alpha)
    else:
        alpha, share, phi = _mesh(np.linspace(0.05, 0.95, 10), np.array([0.01, 0.05, 0.1, 0.2, 0.4, 0.7]),
                                  np.array([0.8, 0.85, 0.9, 0.95, 0.98]))
    g, k = len(alpha), 2 + m
    move, gain, seen = np.zeros((g, k, k)), np.zeros((g, k)), np.zeros((g, k))
    move[:, 0, 0], move[:, 0, 1], move[:, 1, 1] = 1.0, phi, phi
    seen[:, 0], seen[:, 1] = 1.0, phi
    gain[:, 0], gain[:, 1] = alpha, alpha * share
    basis = np.eye(k)
    if m:
        # newest season last in, oldest is used next; initial seasons sum to zero
        seen[:, k - 1] = 1.0
        move[:, 2, k - 1] = 1.0
        for i in range(3, k):
            move[:, i, i - 1] = 1.0
        gain[:, 2] = gamma
        basis = np.zeros((k, k - 1))
        basis[0, 0] = basis[1, 1] = 1.0
        for j in range(m - 1):
            basis[2 + j, 2 + j], basis[k - 1, 2 + j] = 1.0, -1.0
    return move, gain, seen, basis


# per worker; a cached function object could not travel by value, a plain dict can
_known_filters: dict = {}


def _filters(kind: str, n: int):
    """Error matrix, orthonormal basis of the initial-state effect, and the raw effect."""
    if (kind, n) not in _known_filters:
        if len(_known_filters) >= 6:
            _known_filters.clear()
        _known_filters[kind, n] = _build_filters(kind, n)
    return _known_filters[kind, n]


def _build_filters(kind: str, n: int):
    if kind == "sarima":
        return _airline_filters(n)
    move, gain, seen, basis = _system(kind)
    g = len(gain)
    inner = move - gain[:, :, None] * seen[:, None, :]
    effect, impulse = np.empty((g, n, seen.shape[1])), np.empty((g, n))
    row = seen.copy()
    for t in range(n):
        effect[:, t] = row
        impulse[:, t] = (row * gain).sum(1)
        row = np.einsum("gi,gij->gj", row, inner)
    lag = np.arange(n)[:, None] - 1 - np.arange(n)[None, :]
    errors = np.where(lag >= 0, -impulse[:, np.clip(lag, 0, None)], 0.0) + np.eye(n)
    effect = effect @ basis
    return errors, np.linalg.qr(effect)[0], effect


def _airline_grid():
    return _mesh(np.linspace(-0.9, 0.9, 13), np.linspace(-0.9, 0.9, 13))


def _airline_filters(n: int):
    theta, season = _airline_grid()
    twice = np.zeros((n - 13, n))
    for t in range(13, n):
        twice[t - 13, [t, t - 13]] += 1.0
        twice[t - 13, [t - 1, t - 12]] -= 1.0
    errors = np.zeros((len(theta), n - 13, n))
    for t in range(n - 13):
        errors[:, t] = twice[t]
        for lag, weight in ((1, theta), (12, season), (13, theta * season)):
            if t >= lag:
                errors[:, t] -= weight[:, None] * errors[:, t - lag]
    return errors, None, None


def _fit(kind: str, y: np.ndarray) -> np.ndarray:
    """Index of the best grid point per column of ``y`` (n x series)."""
    errors, q, _ = _filters(kind, y.shape[0])
    best = np.empty(y.shape[1], dtype=int)
    for start in range(0, y.shape[1], CHUNK):
        part = errors @ y[:, start : start + CHUNK]
        sse = (part * part).sum(1)
        if q is not None:
            explained = np.swapaxes(q, 1, 2) @ part
            sse = sse - (explained * explained).sum(1)
        best[start : start + CHUNK] = sse.argmin(0)
    return best


def _project(kind: str, point: int, y: np.ndarray, horizon: int) -> np.ndarray:
    """Forecasts (horizon x series) at one grid point."""
    n = y.shape[0]
    errors, _, effect = _filters(kind, n)
    e0 = errors[point] @ y
    if kind == "sarima":
        theta, season = (a[point] for a in _airline_grid())
        e = np.vstack([np.zeros((13, y.shape[1])), e0, np.zeros((horizon, y.shape[1]))])
        path = np.vstack([y, np.zeros((horizon, y.shape[1]))])
        for t in range(n, n + horizon):
            path[t] = (path[t - 1] + path[t - 12] - path[t - 13]
                       + theta * e[t - 1] + season * e[t - 12] + theta * season * e[t - 13])
        return path[n:]
    move, gain, seen, basis = _system(kind)
    state = basis @ np.linalg.lstsq(effect[point], e0, rcond=None)[0]
    for t in range(n):
        surprise = y[t] - seen[point] @ state
        state = move[point] @ state + gain[point][:, None] * surprise
    out = np.empty((horizon, y.shape[1]))
    for k in range(horizon):
        out[k] = seen[point] @ state
        state = move[point] @ state
    return out


def solve(kind: str, y: np.ndarray, horizon: int) -> np.ndarray:
    """Forecast all columns of ``y`` (n x series); result is horizon x series."""
    if kind not in SOLVERS:
        raise KeyError(f"unknown solver {kind!r}; known: {sorted(SOLVERS)}")
    n = y.shape[0]
    if n < SHORTEST.get(kind, 3):
        raise ValueError(f"too few points for {kind}: {n}")
    best = _fit(kind, y)
    out = np.empty((horizon, y.shape[1]))
    for point in np.unique(best):
        chosen = best == point
        out[:, chosen] = _project(kind, int(point), y[:, chosen], horizon)
    if kind == "theta":
        t = np.arange(n) - (n - 1) / 2.0
        slope = (t @ y) / (t @ t)
        out = out + 0.5 * slope * np.arange(1, horizon + 1)[:, None]
    return out


def _run(series: pd.Series, horizons: pd.Series, kinds: tuple[str, ...]) -> pd.DataFrame:
    rows = len(series)
    found = {k: [None] * rows for k in kinds}
    why = {k: [None] * rows for k in kinds}
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (y, h) in enumerate(zip(series, horizons)):
        if y is None or not len(y) or not np.isfinite(np.asarray(y, dtype=float)).all():
            for k in kinds:
                why[k][i] = "ValueError: missing values in the training window"
            continue
        groups.setdefault((len(y), int(h)), []).append(i)
    for (_, horizon), members in groups.items():
        y = np.stack([np.asarray(series.iloc[i], dtype=float) for i in members], axis=1)
        for k in kinds:
            try:
                path = solve(k, y, horizon)
            except (ValueError, np.linalg.LinAlgError) as exc:
                for i in members:
                    why[k][i] = f"{type(exc).__name__}: {exc}"[:120]
                continue
            for column, i in enumerate(members):
                found[k][i] = path[:, column]
    return pd.DataFrame({k: [{"forecast": f, "error": e} for f, e in zip(found[k], why[k])] for k in kinds})


def forecast_columns(y: Column, horizon: Column, kinds: tuple[str, ...]) -> Column:
    """Struct with one ``{forecast, error}`` per solver."""
    for k in kinds:
        if k not in SOLVERS:
            raise KeyError(f"unknown solver {k!r}; known: {sorted(SOLVERS)}")
    schema = ", ".join(f"{k} struct<forecast: array<double>, error: string>" for k in kinds)

    @F.pandas_udf(schema)
    def run(series: pd.Series, horizons: pd.Series) -> pd.DataFrame:
        return _run(series, horizons, kinds)

    return run(y, horizon)


def forecast_series(rows: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Like the closed-form driver: ``model, forecast, error`` per row of ``train`` and ``horizon``."""
    solved = rows.withColumn("_s", forecast_columns(F.col("train"), F.col("horizon"), models))
    runs = [
        F.struct(F.lit(k).alias("model"), F.col("_s")[k]["forecast"].alias("forecast"), F.col("_s")[k]["error"].alias("error"))
        for k in models
    ]
    return solved.select("*", F.explode(F.array(*runs)).alias("r")).select("*", "r.*").drop("r", "_s")
