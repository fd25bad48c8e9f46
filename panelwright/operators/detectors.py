"""Change-point detectors over expanding windows.

CUSUM is a fold over the array in the JVM. The segmentation detectors work on cost
matrices, batched over all curves of an Arrow batch and all penalties at once. A break is
the position of the first point of the new level; minimum segment size is 3.
"""
from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from panelwright.functions import arrays as A

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_SIZE = 3
MIN_HISTORY = 8
RECENT = 3
BASELINE = 6
WIDTH = 6
CHUNK = 128

# --- preparation of a series, causal: a prefix of the result is the result of the prefix -------


def ratio(y: Column) -> Column:
    """Monthly growth; undefined growth is 0. One element shorter."""
    n = F.size(y)
    grown = F.zip_with(F.slice(y, 2, n - 1), F.slice(y, 1, n - 1), lambda b, a: F.when(a != 0, (b - a) / a))
    return F.transform(grown, lambda g: F.coalesce(g, F.lit(0.0)))


def deseason(y: Column) -> Column:
    """Minus the mean of strictly earlier points of the same month, else minus the running mean."""
    def one(value: Column, t: Column) -> Column:
        years = F.floor(t / 12).cast("int")
        past = F.transform(F.sequence(F.lit(1), years), lambda k: F.get(y, t - 12 * k))
        running = A.total(F.slice(y, 1, t + 1)) / (t + 1)
        return value - F.when(years >= 1, A.total(past) / years).otherwise(running)

    return F.transform(y, one)


PREPARE = {"raw": lambda y: y, "ratio": ratio, "deseason": deseason}
OFFSET = {"raw": 0, "ratio": 1, "deseason": 0}


def prepare(y: Column, mode: str) -> Column:
    if mode not in PREPARE:
        raise KeyError(f"unknown preparation mode {mode!r}; known: {sorted(PREPARE)}")
    return PREPARE[mode](y)


# --- CUSUM ------------------------------------------------------------------------------------


def cusum(z: Column, threshold: float = 5.0, baseline: int = BASELINE) -> Column:
    """Position of the first alarm, NULL without one or with fewer than ``baseline + 2`` points.

    Median and MAD of the first points give the level and the scale (population deviation if
    the MAD is 0, 1 if that is 0 too); drift is half the scale.
    """
    def run(first: Column) -> Column:
        return A.let(A.median(first), lambda mu: A.let(
            A.median(F.transform(first, lambda v: F.abs(v - mu))), lambda mad: A.let(
                F.when(mad > 0, 1.4826 * mad).otherwise(
                    A.let(F.sqrt(A.variance_pop(first)), lambda sd: F.when(sd > 0, sd).otherwise(F.lit(1.0)))),
                lambda sigma: _scan(z, mu, sigma, threshold, baseline))))

    return F.when(F.size(z) >= baseline + 2, A.let(F.slice(z, 1, baseline), run))


def _scan(z: Column, mu: Column, sigma: Column, threshold: float, baseline: int) -> Column:
    start = F.struct(
        F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), F.lit(baseline).alias("i"), F.lit(None).cast("int").alias("alarm")
    )

    def step(acc: Column, v: Column) -> Column:
        up = F.greatest(F.lit(0.0), acc["pos"] + (v - mu) - 0.5 * sigma)
        down = F.least(F.lit(0.0), acc["neg"] + (v - mu) + 0.5 * sigma)
        over = (up > threshold * sigma) | (-down > threshold * sigma)
        return F.struct(
            up.alias("pos"), down.alias("neg"), (acc["i"] + 1).alias("i"),
            F.coalesce(acc["alarm"], F.when(over, acc["i"])).alias("alarm"),
        )

    return F.aggregate(F.slice(z, baseline + 1, F.greatest(F.size(z) - baseline, F.lit(0))), start, step, lambda acc: acc["alarm"])


def cusum_flags(z: Column, offset: Column) -> Column:
    """Flagged months of an expanding window: the alarm is within 3 points of the window end."""
    def months(alarm: Column) -> Column:
        first = F.greatest(F.lit(MIN_HISTORY), F.lit(BASELINE + 1) + offset, alarm + offset)
        last = F.least(alarm + offset + RECENT, F.size(z) - 1 + offset)
        found = alarm.isNotNull() & (first <= last)
        return F.when(found, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return A.let(cusum(z), months)


# --- cost matrices ------------------------------------------------------------------------------


def _l2_cost(z: np.ndarray) -> np.ndarray:
    """``cost[b, i, j]``: squared deviation of ``z[b, i:j]`` from its mean."""
    n = z.shape[1]
    s1 = np.concatenate([np.zeros((len(z), 1)), z.cumsum(1)], axis=1)
    s2 = np.concatenate([np.zeros((len(z), 1)), (z * z).cumsum(1)], axis=1)
    size = np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = (s2[:, None, :] - s2[:, :, None]) - (s1[:, None, :] - s1[:, :, None]) ** 2 / size
    return np.where(size > 0, np.maximum(cost, 0.0), np.inf)


def _squared_distances(z: np.ndarray) -> np.ndarray:
    return (z[:, :, None] - z[:, None, :]) ** 2


def _rbf_cost(z: np.ndarray) -> np.ndarray:
    """Kernel cost with the width set by the median squared distance."""
    return _kernel_cost(_squared_distances(z))


def _kernel_cost(d: np.ndarray) -> np.ndarray:
    """The same from squared distances of the points."""
    n = d.shape[1]
    middle = np.median(d[:, *np.triu_indices(n, 1)], axis=1)
    gamma = np.where(middle > 0, 1.0 / np.where(middle > 0, middle, 1.0), 1.0)
    gram = gamma[:, None, None] * d
    np.clip(gram, 1e-2, 1e2, out=gram)
    np.exp(np.negative(gram, out=gram), out=gram)
    trace = np.concatenate([np.zeros((len(d), 1)), np.einsum("bii->bi", gram).cumsum(1)], axis=1)
    block = np.zeros((len(d), n + 1, n + 1))
    block[:, 1:, 1:] = gram.cumsum(1).cumsum(2)
    corner = np.einsum("bii->bi", block).copy()
    block *= -2.0  # the kernel is symmetric, and so are its sums
    block += corner[:, None, :] + corner[:, :, None]
    size = np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        block /= size
        np.subtract(trace[:, None, :] - trace[:, :, None], block, out=block)
    block[:, size <= 0] = np.inf
    return block


# --- detectors: (cost, penalty rows x penalties, length) -> mask of breaks (rows, penalties, length) ---


def _partition(cost: np.ndarray, pen: np.ndarray, n: int) -> np.ndarray:
    """Where the last segment of the cheapest penalised partition of each prefix starts: ``(rows, penalties, n + 1)``."""
    rows, k = pen.shape
    best = np.full((rows, k, n + 1), np.inf)
    back = np.zeros((rows, k, n + 1), dtype=int)
    best[:, :, 0] = -pen
    for j in range(MIN_SIZE, n + 1):
        m = max(j - MIN_SIZE, 0) + 1  # starts too near to 0 cost infinity
        value = best[:, :, :m] + cost[:, None, :m, j]
        pick = value.argmin(2)
        best[:, :, j] = np.take_along_axis(value, pick[:, :, None], 2)[:, :, 0] + pen
        back[:, :, j] = pick
    return back


def _optimal(cost: np.ndarray, pen: np.ndarray, n: int) -> np.ndarray:
    """Exact penalised partition by dynamic programming."""
    rows, k = pen.shape
    back = _partition(cost, pen, n)
    mask = np.zeros((rows, k, n + 1), dtype=bool)
    at = back[:, :, n].copy()
    r, p = np.indices((rows, k))
    while at.any():
        mask[r, p, at] |= at > 0
        at = back[r, p, at]
    return mask[:, :, :n]


def _binary(cost: np.ndarray, pen: np.ndarray, n: int) -> np.ndarray:
    """Greedy halving: every segment whose best split gains more than the penalty is split.

    Where a segment is split doesn't depend on the penalty, only whether it is, so all rows and
    penalties go down the same halvings level by level.
    """
    rows, k = pen.shape
    mask = np.zeros((rows, k, n), dtype=bool)
    spots, each = np.arange(n + 1), np.arange(k)
    row, low, high, there = np.arange(rows), np.zeros(rows, dtype=int), np.full(rows, n), np.ones((rows, k), dtype=bool)
    while True:
        long = high - low >= 2 * MIN_SIZE
        row, low, high, there = row[long], low[long], high[long], there[long]
        if not len(row):
            return mask
        inside = (spots >= (low + MIN_SIZE)[:, None]) & (spots <= (high - MIN_SIZE)[:, None])
        with np.errstate(invalid="ignore"):
            gain = np.where(inside, cost[row, low, high][:, None] - cost[row, low] - cost[row, :, high], -np.inf)
        at = gain.argmax(1)
        there = there & (gain[np.arange(len(at)), at][:, None] > pen[row])
        mask[row[:, None], each[None, :], at[:, None]] |= there
        split = there.any(1)
        row, low, high, at, there = row[split], low[split], high[split], at[split], there[split]
        row, low, high, there = np.concatenate([row, row]), np.concatenate([low, at]), np.concatenate([at, high]), np.concatenate([there, there])


def _around(accepted: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    spots = np.arange(accepted.shape[2])
    low = np.where(accepted & (spots < at[:, :, None]), spots, 0).max(2)
    high = np.where(accepted & (spots > at[:, :, None]), spots, n).min(2)
    return low, high


def _window(cost: np.ndarray, pen: np.ndarray, n: int) -> np.ndarray:
    """Peaks of the discrepancy of two half windows, highest first, while the total cost falls by more than the penalty."""
    rows, k = pen.shape
    mask = np.zeros((rows, k, n), dtype=bool)
    half = WIDTH // 2
    if n < WIDTH:
        return mask
    spots = np.arange(half, n - half + 1)
    score = np.full((rows, n + 1), -np.inf)
    score[:, spots] = cost[:, spots - half, spots + half] - cost[:, spots - half, spots] - cost[:, spots, spots + half]
    padded = np.pad(score, ((0, 0), (half, half)), constant_values=-np.inf)
    near = np.max([padded[:, half + d : half + d + n + 1] for d in range(-half, half + 1) if d], axis=0)
    peak = np.isfinite(score) & (score > near)
    order = np.argsort(np.where(peak, -score, np.inf), axis=1, kind="stable")
    active = np.ones((rows, k), dtype=bool)
    r = np.arange(rows)[:, None]
    for rank in range(int(peak.sum(1).max(initial=0))):
        at = np.repeat(order[:, rank][:, None], k, axis=1)
        low, high = _around(mask, at, n)
        gain = cost[r, low, high] - cost[r, low, at] - cost[r, at, high]
        active &= peak[r, at] & (gain > pen)
        mask[r, np.arange(k)[None, :], np.minimum(at, n - 1)] |= active
    return mask


def _halves(start: int, end: int) -> tuple[int, ...]:
    """Cut points of halving a stretch as long as both parts keep the minimum size."""
    if end - start < 2 * MIN_SIZE:
        return ()
    middle = (start + end) // 2
    return (*_halves(start, middle), middle, *_halves(middle, end))


def _bottom_up(cost: np.ndarray, pen: np.ndarray, n: int) -> np.ndarray:
    """Halved to the smallest pieces, then the cheapest neighbours merged while that costs less than the penalty."""
    rows, k = pen.shape
    mask = np.zeros((rows, k, n), dtype=bool)
    marks = np.array(_halves(0, n), dtype=int)
    if not len(marks):
        return mask
    alive = np.ones((rows, k, len(marks)), dtype=bool)
    r = np.arange(rows)[:, None, None]
    running = np.ones((rows, k), dtype=bool)
    while running.any():
        low = np.maximum.accumulate(np.where(alive, marks, 0), axis=2)
        low = np.concatenate([np.zeros((rows, k, 1), dtype=int), low[:, :, :-1]], axis=2)
        high = np.minimum.accumulate(np.where(alive, marks, n)[:, :, ::-1], axis=2)[:, :, ::-1]
        high = np.concatenate([high[:, :, 1:], np.full((rows, k, 1), n)], axis=2)
        price = np.where(alive, cost[r, low, high] - cost[r, low, marks] - cost[r, marks, high], np.inf)
        pick = price.argmin(2)
        running &= np.take_along_axis(price, pick[:, :, None], 2)[:, :, 0] < pen
        b, p = np.nonzero(running)
        alive[b, p, pick[b, p]] = False
    mask[:, :, marks] = alive
    return mask


SEGMENTERS = {"pelt": _optimal, "binseg": _binary, "window": _window, "bottomup": _bottom_up, "kernel_rbf": _optimal}
DETECTORS = (*SEGMENTERS, "cusum")


def breaks(detector: str, z: np.ndarray, penalties: Sequence[float]) -> np.ndarray:
    """Break mask ``(rows, penalties, length)`` of equally long series.

    The penalty of the l2 detectors is in units of the population variance; the kernel's is raw.
    """
    if detector not in SEGMENTERS:
        raise KeyError(f"unknown detector {detector!r}; known: {sorted(SEGMENTERS)}")
    n = z.shape[1]
    pen = np.broadcast_to(np.asarray(penalties, dtype=float), (len(z), len(penalties)))
    if detector == "kernel_rbf":
        return _optimal(_rbf_cost(z), pen, n)
    scaled = pen * z.var(1)[:, None]
    return SEGMENTERS[detector](_l2_cost(z), scaled, n)


# --- windows that end at every month: is there a break near the end? -------------------------
#
# A window tells whether a break lies within the last points. That needs neither the other breaks nor
# a run per penalty: the breaks near the end fall out of one chain of splits, peaks or merges, and the
# weakest link of the chain is the penalty up to which they stand.


def _blocks(n_windows: int) -> list[tuple[int, int]]:
    """Windows in growing groups, so that rows which have told what they should leave early."""
    edges = [0, *(e for e in (4, 10, 18, 30, 46) if e < n_windows), n_windows]
    return list(zip(edges[:-1], edges[1:]))


def _near(size: np.ndarray | int) -> np.ndarray | int:
    """First break of a window of ``size`` points that counts as near its end."""
    return np.maximum(size - 1 - RECENT, 1)


def _binary_links(cost: np.ndarray, row: np.ndarray, size: np.ndarray, low_pen: np.ndarray, high_pen: np.ndarray) -> np.ndarray:
    """Smallest gain of the halvings that lead to a break near the end; a break there stands for any smaller penalty."""
    found = np.full(len(row), -np.inf)
    column = np.ascontiguousarray(cost.transpose(0, 2, 1))
    spots, near = np.arange(cost.shape[1]), _near(size)
    item, low, weakest = np.arange(len(row)), np.zeros(len(row), dtype=int), np.full(len(row), np.inf)
    while True:
        going = (size[item] - low >= 2 * MIN_SIZE) & (weakest > low_pen[item])
        item, low, weakest = item[going], low[going], weakest[going]
        if not len(item):
            return found
        r, end = row[item], size[item]
        inside = (spots >= (low + MIN_SIZE)[:, None]) & (spots <= (end - MIN_SIZE)[:, None])
        with np.errstate(invalid="ignore"):
            gain = np.where(inside, cost[r, low, end][:, None] - cost[r, low] - column[r, end], -np.inf)
        low = gain.argmax(1)
        weakest = np.minimum(weakest, gain[np.arange(len(low)), low])
        there = low >= near[item]
        found[item[there]] = weakest[there]
        item, low, weakest = item[~there], low[~there], weakest[~there]


def _window_links(cost: np.ndarray, row: np.ndarray, size: np.ndarray, low_pen: np.ndarray, high_pen: np.ndarray) -> np.ndarray:
    """Smallest gain among the peaks down to the one near the end; a window has at most one such peak."""
    found = np.full(len(row), -np.inf)
    half, n = WIDTH // 2, cost.shape[1] - 1
    if n < WIDTH:
        return found
    spots = np.arange(half, n - half + 1)
    score = np.full((len(cost), n + 1), -np.inf)
    score[:, spots] = cost[:, spots - half, spots + half] - cost[:, spots - half, spots] - cost[:, spots, spots + half]
    places = np.arange(n + 1)
    seen = np.where(places <= (size - half)[:, None], score[row], -np.inf)
    padded = np.pad(seen, ((0, 0), (half, half)), constant_values=-np.inf)
    beside = np.max([padded[:, half + d : half + d + n + 1] for d in range(-half, half + 1) if d], axis=0)
    peak = np.isfinite(seen) & (seen > beside)
    last = peak & (places >= _near(size)[:, None])
    item = np.flatnonzero(last.any(1))
    target = last[item].argmax(1)
    seen, peak = seen[item], peak[item]
    order = np.argsort(np.where(peak, -seen, np.inf), axis=1, kind="stable")
    taken, weakest, rank = np.zeros(peak.shape, dtype=bool), np.full(len(item), np.inf), 0
    while len(item):
        at, r, each = order[:, rank], row[item], np.arange(len(item))
        low = np.where(taken & (places < at[:, None]), places, 0).max(1)
        high = np.where(taken & (places > at[:, None]), places, size[item][:, None]).min(1)
        weakest = np.minimum(weakest, cost[r, low, high] - cost[r, low, at] - cost[r, at, high])
        taken[each, at] = True
        there = at == target
        found[item[there]] = weakest[there]
        going = ~there & (weakest > low_pen[item])
        item, target, order, taken, weakest, rank = item[going], target[going], order[going], taken[going], weakest[going], rank + 1
    return found


def _merge_links(cost: np.ndarray, row: np.ndarray, size: np.ndarray, low_pen: np.ndarray, high_pen: np.ndarray) -> np.ndarray:
    """Largest price of the merges up to that of the mark near the end; the mark stands for any penalty up to it."""
    found = np.full(len(row), -np.inf)
    sizes = np.unique(size)
    marks = {int(s): _halves(0, int(s)) for s in sizes}
    marks = {s: m for s, m in marks.items() if m and m[-1] >= _near(s)}  # without a mark there nothing can be told
    if not marks:
        return found
    widest = max(len(m) for m in marks.values())
    place = np.zeros((cost.shape[1], widest + 2), dtype=int)
    count = np.zeros(cost.shape[1], dtype=int)
    for s, m in marks.items():
        place[s, 1 : len(m) + 1], place[s, len(m) + 1 :], count[s] = m, s, len(m)
    item = np.flatnonzero(count[size] > 0)
    spot, r, target = place[size[item]], row[item], count[size[item]]
    index = np.arange(widest + 2)
    back, ahead = np.repeat(index[None, :] - 1, len(item), 0), np.repeat(index[None, :] + 1, len(item), 0)

    def price(e: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, middle, high = spot[e, back[e, at]], spot[e, at], spot[e, ahead[e, at]]
        return cost[r[e], low, high] - cost[r[e], low, middle] - cost[r[e], middle, high]

    prices = np.full((len(item), widest + 2), np.inf)
    e, at = np.nonzero((index >= 1) & (index <= target[:, None]))
    prices[e, at] = price(e, at)
    highest = np.full(len(item), -np.inf)
    while len(item):
        each = np.arange(len(item))
        at = prices.argmin(1)
        highest = np.maximum(highest, prices[each, at])
        there = (at == target) | (highest >= high_pen[item])
        found[item[there]] = highest[there]
        going = ~there
        item, spot, r, target, back, ahead, prices, highest, at = (
            x[going] for x in (item, spot, r, target, back, ahead, prices, highest, at))
        each = np.arange(len(item))
        before, after = back[each, at], ahead[each, at]
        prices[each, at] = np.inf
        ahead[each, before], back[each, after] = after, before
        for beside, inner in ((before, before >= 1), (after, after <= target)):
            e = np.flatnonzero(inner)
            prices[e, beside[e]] = price(e, beside[e])
    return found


LINKS = {"binseg": _binary_links, "window": _window_links, "bottomup": _merge_links}


def _linked_flags(detector: str, z: np.ndarray, pen: np.ndarray, offset: int, first: np.ndarray, out: np.ndarray) -> None:
    """Flags of the greedy detectors, from the weakest link of every window."""
    cost, rows = _l2_cost(z), np.arange(len(z))
    for a, b in _blocks(out.shape[2] - MIN_HISTORY):
        if not len(rows):
            return
        sizes = np.arange(a, b) + MIN_HISTORY + 1 - offset
        spread = np.stack([z[rows, :s].var(1) for s in sizes], axis=1)
        part = np.ascontiguousarray(cost[rows, : sizes[-1] + 1, : sizes[-1] + 1])
        scaled = pen[None, None, :] * spread[:, :, None]
        row, size = np.repeat(np.arange(len(rows)), len(sizes)), np.tile(sizes, len(rows))
        link = LINKS[detector](part, row, size, scaled.min(2).ravel(), scaled.max(2).ravel()).reshape(spread.shape)[:, :, None]
        flagged = link >= scaled if detector == "bottomup" else link > scaled
        out[rows, :, MIN_HISTORY + a : MIN_HISTORY + b] = flagged.transpose(0, 2, 1)
        rows = rows[~(first[rows] & out[rows].any(2).all(1))]


def _segments(costs, levels: int, n: int, rows: int, done: np.ndarray | None = None, start: int = 0) -> np.ndarray:
    """``best[k, j]``: the cheapest partition of the first ``j`` points into ``k`` pieces, ``j`` in ``start .. n - 1`` added to ``done``."""
    best = np.full((levels + 1, n, rows), np.inf) if done is None else done
    best[0, 0] = 0.0
    for j in range(max(start, MIN_SIZE), n):
        used = min(j // MIN_SIZE, levels)
        best[1 : used + 1, j] = (best[:used, : j - MIN_SIZE + 1] + costs(j)).min(1)
    return best


def _late(best: np.ndarray, cost: np.ndarray, size: int, pen: np.ndarray, near: int | None = None) -> np.ndarray:
    """``(penalties, rows)``: is a last break near the end cheaper than any other? ``best`` by number of pieces, ``pen`` as the result."""
    used = min(size // MIN_SIZE, len(best))
    near = int(_near(size)) if near is None else max(near, 1)
    value = best[:used, : size - MIN_SIZE + 1] + cost
    if near >= value.shape[1]:
        return np.zeros(pen.shape, dtype=bool)
    early, late = value[:, :near].min(1), value[:, near:].min(1)
    count = np.arange(used, dtype=float)[:, None, None] * pen[None]
    return (late[:, None] + count).min(0) < (early[:, None] + count).min(0)


def _pelt_flags(z: np.ndarray, pen: np.ndarray, offset: int, first: np.ndarray, out: np.ndarray) -> None:
    """The exact partition by number of pieces serves every window and penalty: only the price of a piece differs."""
    n = z.shape[1]
    s1 = np.concatenate([np.zeros((len(z), 1)), z.cumsum(1)], axis=1).T.copy()
    s2 = np.concatenate([np.zeros((len(z), 1)), (z * z).cumsum(1)], axis=1).T.copy()
    rows, best = np.arange(len(z)), None
    at = 0
    for a, b in _blocks(out.shape[2] - MIN_HISTORY):
        if not len(rows):
            return

        def costs(j: int) -> np.ndarray:
            m = j - MIN_SIZE + 1
            size = (j - np.arange(m))[:, None]
            return np.maximum((s2[j] - s2[:m]) - (s1[j] - s1[:m]) ** 2 / size, 0.0)

        sizes = np.arange(a, b) + MIN_HISTORY + 1 - offset
        if best is None:
            best = np.full((n // MIN_SIZE + 1, n + 1, len(rows)), np.inf)
        best = _segments(costs, n // MIN_SIZE, int(sizes[-1]) + 1, len(rows), best, at)
        at = int(sizes[-1]) + 1
        for s in map(int, sizes):
            if s >= MIN_SIZE:
                out[rows, :, s - 1 + offset] = _late(best, costs(s), s, pen[:, None] * z[rows, :s].var(1)[None, :]).T
        kept = ~(first[rows] & out[rows].any(2).all(1))
        if not kept.all():
            rows, s1, s2, best = rows[kept], np.ascontiguousarray(s1[:, kept]), np.ascontiguousarray(s2[:, kept]), np.ascontiguousarray(best[:, :, kept])


#: From so many penalties on, partitions by number of pieces are cheaper than one partition for each penalty.
MANY = 12


def _middles(flat: np.ndarray, later: np.ndarray, n: int) -> np.ndarray:
    """``(rows, n + 1)``: median distance of the pairs among the first points, for every number of points; pairs are sorted once."""
    rows, pairs = flat.shape
    width = 64
    blocks = -(-pairs // width)
    order = np.argsort(flat, axis=1)
    born = np.full((rows, blocks * width), n, dtype=np.int64)
    born[:, :pairs] = later[order]
    cell = (np.arange(rows * blocks * width) // width).reshape(rows, -1) * (n + 1) + born
    seen = np.bincount(cell.ravel(), minlength=rows * blocks * (n + 1)).reshape(rows, blocks, n + 1).cumsum(2)
    upto = seen.cumsum(1)
    born = born.reshape(rows, blocks, width)
    r = np.arange(rows)
    out = np.zeros((rows, n + 1))
    for size in range(2, n + 1):
        k = size * (size - 1) // 2
        count, sides = upto[:, :, size - 1], []
        for rank in ((k - 1) // 2, k // 2):
            block = (count > rank).argmax(1)
            before = count[r, block] - seen[r, block, size - 1]
            place = ((born[r, block] < size).cumsum(1) == (rank - before + 1)[:, None]).argmax(1)
            sides.append(flat[r, order[r, block * width + place]])
        out[:, size] = (sides[0] + sides[1]) / 2.0
    return out


def _gram(apart: np.ndarray, size: int, middle: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Kernel of the pairs among the first ``size`` points, by later point, from their distances; ``out`` is written over."""
    gram = out[: size * (size - 1) // 2]
    np.multiply(apart[: len(gram)], -np.where(middle > 0, 1.0 / np.where(middle > 0, middle, 1.0), 1.0)[None, :], out=gram)
    np.maximum(gram, -1e2, out=gram)
    np.minimum(gram, -1e-2, out=gram)
    return np.exp(gram, out=gram)


OWN = np.exp(-1e-2)  # kernel of a point with itself


def _kernel_columns(gram: np.ndarray, size: int) -> list[np.ndarray]:
    """Kernel cost of the pieces that end at ``j``, by start, for all ``j`` up to ``size``."""
    inside = np.zeros((size + 1, gram.shape[1]))  # sums over the pairs of a piece, by its start
    out = []
    for j in range(size + 1):
        if j >= 2:
            column = gram[(j - 1) * (j - 2) // 2 : j * (j - 1) // 2]
            inside[: j - 1] += np.add.accumulate(column[::-1], axis=0)[::-1]
        m = max(j - MIN_SIZE + 1, 0)
        length = (j - np.arange(m, dtype=float))[:, None]
        column = inside[:m] * (-2.0 / length)
        column += (length - 1.0) * OWN
        out.append(column)
    return out


def _end_gain(gram: np.ndarray, size: int) -> np.ndarray:
    """The most that a break near the end gains in any piece that ends the window, with the minimum size before it.

    The piece before a last break could as well go on to the end: where the penalty is above that gain, the
    cheapest partition has no break near the end. Needs the costs of three ends only, not of all pieces.
    """
    ends = [*range(int(_near(size)), size - MIN_SIZE + 1), size]
    own = np.zeros((size, gram.shape[1]))  # sums over the pairs of a point with later ones
    costs = {}
    for j in range(1, size + 1):
        own[: j - 1] += gram[(j - 1) * (j - 2) // 2 : j * (j - 1) // 2]
        if j in ends:
            length = (j - np.arange(j, dtype=float))[:, None]
            costs[j] = np.add.accumulate(own[:j][::-1], axis=0)[::-1] * (-2.0 / length) + (length - 1.0) * OWN
    gain = np.full(gram.shape[1], -np.inf)
    for s in ends[:-1]:
        if s >= MIN_SIZE:
            starts = slice(s - MIN_SIZE + 1)
            np.maximum(gain, (costs[size][starts] - costs[s][starts]).max(0) - costs[size][s], out=gain)
    return gain


def _kernel_flags(z: np.ndarray, pen: np.ndarray, offset: int, first: np.ndarray, out: np.ndarray) -> None:
    """The width of the kernel follows the window, so every window has costs of its own.

    Only rows and penalties below the gain of a break near the end are partitioned, and a partition has at
    most as many breaks as the smallest open penalty goes into the cost of the whole window. Cutting off ``b``
    points gains less than ``2 b`` (the mean embeddings of two pieces are at most the root of 2 apart).
    """
    n = z.shape[1]
    i, j = np.tril_indices(n, -1)
    flat = (z[:, i] - z[:, j]) ** 2  # pairs by their later point: a window is a prefix
    rows, apart, middles = np.arange(len(z)), np.ascontiguousarray(flat.T), _middles(flat, i, n)
    kernel = np.empty_like(apart)
    open_ = np.repeat(pen[:, None] < 2.0 * (RECENT + 1), len(z), axis=1)  # penalties that have to be asked
    for t in range(MIN_HISTORY, out.shape[2]):
        size = t + 1 - offset
        if size < MIN_SIZE:
            continue
        kept = open_.any(0)
        if kept.sum() < 0.8 * len(rows):
            rows, apart, middles, open_ = rows[kept], np.ascontiguousarray(apart[:, kept]), middles[kept], open_[:, kept]
            kernel = np.empty_like(apart)
            if not len(rows):
                return
        gram = _gram(apart, size, middles[:, size], kernel)
        asked = open_ & (pen[:, None] <= _end_gain(gram, size)[None, :] + 1e-6)
        if not asked.any():
            continue
        wanted, some = np.flatnonzero(asked.any(1)), np.flatnonzero(asked.any(0))
        columns = _kernel_columns(gram[:, some], size)
        price = np.repeat(pen[wanted][:, None], len(some), axis=1)
        if len(wanted) >= MANY:
            smallest = pen[wanted].min()
            levels = min(size // MIN_SIZE, int((columns[size][0].max() + 1e-6) / smallest)) if smallest > 0 else size // MIN_SIZE
            best = _segments(lambda j: columns[j], levels, size, len(some))
            told = _late(best, columns[size], size, price)
        else:
            best = np.full((size, len(wanted), len(some)), np.inf)
            best[0] = -price
            for j in range(MIN_SIZE, size - MIN_SIZE + 1):
                best[j] = (best[: j - MIN_SIZE + 1] + columns[j][:, None]).min(0) + price
            near = int(_near(size))
            value = best[: size - MIN_SIZE + 1] + columns[size][:, None]
            told = value[near:].min(0) < value[:near].min(0)
        told &= asked[np.ix_(wanted, some)]
        out[rows[some][None, :], wanted[:, None], t] = told
        open_[np.ix_(wanted, some)] &= ~(told & first[rows[some]][None, :])


def flags(detector: str, z: np.ndarray, penalties: Sequence[float], offset: int, first_only: bool | np.ndarray = False) -> np.ndarray:
    """``(rows, penalties, month)``: does the window ending at the month show a break near its end?

    ``first_only``, for all rows or one by one: months after the first flag of a penalty may be left out.
    """
    rows, n = z.shape
    if detector not in SEGMENTERS:
        raise KeyError(f"unknown detector {detector!r}; known: {sorted(SEGMENTERS)}")
    out = np.zeros((rows, len(penalties), n + offset), dtype=bool)
    if n + offset <= MIN_HISTORY or not len(penalties):
        return out
    pen, first = np.asarray(penalties, dtype=float), np.broadcast_to(np.asarray(first_only, dtype=bool), (rows,))
    if detector == "kernel_rbf":
        _kernel_flags(z, pen, offset, first, out)
    elif detector == "pelt":
        _pelt_flags(z, pen, offset, first, out)
    else:
        _linked_flags(detector, z, pen, offset, first, out)
    return out


def breaks_near_ends(detector: str, z: np.ndarray, penalty: float, sizes: Sequence[int], first: Sequence[int]) -> list[bool]:
    """Does the window of the first ``size`` points of a series show a break at the place ``first`` or later, for each size?"""
    if detector != "pelt":
        return [bool(breaks(detector, z[None, :size], [penalty])[0, 0, k:].any()) for size, k in zip(sizes, first)]
    s1, s2 = (np.concatenate([[0.0], x.cumsum()])[:, None] for x in (z, z * z))

    def costs(j: int) -> np.ndarray:
        m = j - MIN_SIZE + 1
        return np.maximum((s2[j] - s2[:m]) - (s1[j] - s1[:m]) ** 2 / (j - np.arange(m))[:, None], 0.0)

    most = max(sizes)
    best = _segments(costs, most // MIN_SIZE, most + 1, 1)
    return [bool(_late(best, costs(size), size, np.array([[penalty * z[:size].var()]]), k)[0, 0]) for size, k in zip(sizes, first)]


def _by_length(series: pd.Series, offsets: pd.Series | None = None):
    """Row numbers, stacked values and month offset of usable series, in chunks of equal shape."""
    groups: dict[tuple[int, int], list[int]] = {}
    values = series.tolist()
    shifts = [0] * len(values) if offsets is None else offsets.tolist()
    for i, y in enumerate(values):
        if y is not None and len(y) >= 2 * MIN_SIZE:
            groups.setdefault((len(y), int(shifts[i])), []).append(i)
    for (_, offset), members in groups.items():
        for s in range(0, len(members), CHUNK):
            part = members[s : s + CHUNK]
            stacked = np.stack([np.asarray(values[i], dtype=float) for i in part])
            usable = np.isfinite(stacked).all(1)
            if usable.any():
                yield [i for i, ok in zip(part, usable) if ok], stacked[usable], offset


def flag_column(z: Column, offset: Column, detector: str, penalties: Sequence[float], first_only: bool | Column = False) -> Column:
    """``array<array<int>>``: flagged months per penalty, or only the first. A series too short for the detector is NULL."""
    grid = [float(p) for p in penalties]

    @F.pandas_udf("array<array<int>>")
    def run(series: pd.Series, offsets: pd.Series, firsts: pd.Series) -> pd.Series:
        out: list = [None] * len(series)
        single = firsts.to_numpy(dtype=bool)
        for members, values, shift in _by_length(series, offsets):
            found = flags(detector, values, grid, shift, single[members])
            found[single[members]] &= found[single[members]].cumsum(2) == 1
            row, p, month = (x.tolist() for x in np.nonzero(found))
            for i in members:
                out[i] = [[] for _ in grid]
            for a, b, m in zip(row, p, month):
                out[members[a]][b].append(m)
        return pd.Series(out)

    return run(z, offset, F.lit(first_only) if isinstance(first_only, bool) else first_only)


def break_column(z: Column, detector: str, penalties: Sequence[float]) -> Column:
    """``array<array<int>>``: breaks of the whole series per penalty."""
    grid = [float(p) for p in penalties]

    @F.pandas_udf("array<array<int>>")
    def run(series: pd.Series) -> pd.Series:
        out: list = [None] * len(series)
        for members, values, _ in _by_length(series):
            mask = breaks(detector, values, grid)
            for row, i in enumerate(members):
                out[i] = [list(map(int, np.flatnonzero(mask[row, p]))) for p in range(len(grid))]
        return pd.Series(out)

    return run(z)
