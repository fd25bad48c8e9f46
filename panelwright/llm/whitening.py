"""Whitening of vectors from exact integer cross-products, counted by bit planes.

An entry ``c`` counts as the integer ``x = floor(64 * c) + 1000000``. Sums and cross-products of all
dimensions are exact, whatever the order or the split of the rows:

1. One pass finds the smallest and largest ``x`` of each dimension. The shift by the smallest leaves few
   bits; a covariance doesn't feel it.
2. A task packs bit ``a`` of a dimension over its rows into 64-bit words (a plane). The cross-product of two
   dimensions is the sum over pairs of planes of ``2**(a+b)`` times the number of ones in their AND. A
   dimension of ones gives the sums and the number of rows on the way. Counts are added by 16-bit limbs of
   the weight, so that no 64-bit sum overflows below 2**40 rows.
3. The driver gets one number for each pair of dimensions and limb (their number doesn't grow with the rows),
   forms ``n * XY - S_x * S_y`` as integers, divides once and takes the eigenvectors.
4. A pass over the rows projects the centred vectors. Another one sums their products, so that the
   reported distance from the identity is measured, not derived.

Rows: vectors that are null or empty or hold null or non-finite entries are dropped; so are vectors whose
length isn't the most frequent one (of equals the longer). Entries beyond ``2**61 / 64`` count as that
bound. Repeated rows and ids, null ids among them, count and are returned each. A component without variance (its
eigenvalue is at most ``trace * 1e-14``, or there is one row only) has a null ``whitened`` and is no part
of the identity error; ``explained`` is then 0. A ``deviation`` beyond 64 bits is null. No row left: no
rows. Other columns are not read.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import giving_back

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, OFFSET, BOUND = 64.0, 1_000_000, float(1 << 61)
LIMB = 16
ROWS_AT_ONCE = 1 << 13


def integers(vectors: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of ``size`` entries and their integers, one row each."""
    lengths = np.diff(vectors.offsets.to_numpy())
    at = np.flatnonzero(lengths == size)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = vectors.offsets.to_numpy()[:-1][at]
    with np.errstate(over="ignore"):
        x = np.floor(flat[starts[:, None] + np.arange(size)] * SCALE).clip(-BOUND, BOUND)
    return at, x.astype(np.int64) + OFFSET


def planes(y: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative integers (rows, dimensions), by dimension and bit, as 64-bit words over the rows."""
    pad = -len(y) % 64
    y = np.vstack([y, np.zeros((pad, y.shape[1]), dtype=np.int64)]) if pad else y
    first = np.concatenate([[0], np.cumsum(widths)[:-1]])
    out = np.empty((int(widths.sum()), len(y) // 64), dtype=np.uint64)
    for bit in range(int(widths.max(initial=0))):
        wide = np.flatnonzero(widths > bit)
        ones = ((y[:, wide] >> bit) & 1).astype(np.uint8)
        out[first[wide] + bit] = np.packbits(np.ascontiguousarray(ones.T), axis=1, bitorder="little").view(np.uint64)
    return out


def add_products(total: np.ndarray, bits: np.ndarray, widths: np.ndarray) -> None:
    """Adds the cross-products of all pairs of dimensions to ``total`` (dimension, dimension, limb), upper half."""
    first = np.concatenate([[0], np.cumsum(widths)[:-1]])
    of_bit = np.arange(len(bits)) - np.repeat(first, widths)
    for d, width in enumerate(widths):
        rest = slice(first[d], None)
        at = first[d:] - first[d]
        for a in range(width):
            ones = np.bitwise_count(bits[first[d] + a] & bits[rest]).sum(axis=1, dtype=np.int64)
            level = of_bit[rest] + a
            weighted = ones << (level % LIMB)
            for limb in range(total.shape[2]):
                total[d, d:, limb] += np.add.reduceat(np.where(level // LIMB == limb, weighted, 0), at)


@dataclass
class Moments:
    """Number of rows, smallest integers, sums and cross-products of the shifted integers (exact, Python's)."""

    n: int
    low: list[int]
    sums: list[int]
    products: list[list[int]]

    def scatter(self) -> list[list[int]]:
        """n times the sum of products of deviations, exact."""
        s, p, k = self.sums, self.products, range(len(self.low))
        return [[self.n * p[min(i, j)][max(i, j)] - s[i] * s[j] for j in k] for i in k]


@dataclass
class Whitening:
    """Components as rows, numbered by falling eigenvalue."""

    moments: Moments
    components: np.ndarray
    values: np.ndarray
    trace: float

    def plain(self) -> dict:
        """As arrays and numbers, for tasks."""
        m = self.moments
        with_variance = self.values > self.trace * 1e-14
        scale = np.where(with_variance, 1 / np.sqrt(np.where(with_variance, self.values, 1.0)), np.nan)
        return {"n": m.n, "low": np.array(m.low, dtype=np.int64), "whole": np.array([s // m.n for s in m.sums], dtype=np.int64),
                "part": np.array([(s % m.n) / m.n for s in m.sums]), "sums": m.sums, "axes": (self.components * np.nan_to_num(scale)[:, None]).T,
                "explained": np.where(with_variance, self.values / (self.trace or 1.0), 0.0), "void": ~with_variance}


def project(x: np.ndarray, fit: dict) -> np.ndarray:
    """Whitened components of integer vectors; 0 for components without variance."""
    return ((x - fit["low"] - fit["whole"]).astype(np.float64) - fit["part"]) @ fit["axes"]


def deviations(x: np.ndarray, fit: dict) -> list[int | None]:
    """Sum over dimensions of (n*x - S)**2, exact; None beyond 64 bits."""
    y, n = x - fit["low"], fit["n"]
    rough = (((y - fit["whole"]).astype(np.float64) - fit["part"]) * float(n)) ** 2
    size = rough.sum(axis=1)
    wrapped = [np.uint64(s % (1 << 64)) for s in fit["sums"]]
    apart = y.astype(np.uint64) * np.uint64(n) - np.array(wrapped, dtype=np.uint64)
    exact = (apart * apart).sum(axis=1, dtype=np.uint64)  # modulo 2**64, which is all of a sum that is smaller
    out: list[int | None] = [int(v) for v in exact]
    for k in np.flatnonzero(size > 2.0**62):
        whole = sum((n * v - s) ** 2 for v, s in zip(y[k].tolist(), fit["sums"])) if size[k] < 2.0**64 else 1 << 63
        out[k] = whole if whole < 1 << 63 else None
    return out


def _vectors(df: DataFrame, vector: str, *others: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(vector).isNotNull() & finite).select(*others, v.alias("__vector"))


def _entries(batch: pa.RecordBatch) -> pa.ListArray:
    return batch.column(batch.schema.get_field_index("__vector"))


def spread(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Smallest and largest integer of each dimension of the vectors of the most frequent length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            entries = _entries(batch)
            for size in np.unique(np.diff(entries.offsets.to_numpy())).tolist():
                if not size:
                    continue
                at, x = integers(entries, size)
                n, low, high = seen.get(size, [0, x[0], x[0]])
                seen[size] = [n + len(at), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))]
        for size, (n, low, high) in seen.items():
            each = [np.full(size, size), np.arange(size), np.full(size, n), low, high]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in each], names=["size", "dim", "n", "low", "high"])

    found = vectors.select("__vector").mapInArrow(giving_back(run), "size long, dim long, n long, low long, high long")
    ranges = found.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    # one row for each dimension of the winning length
    most = ranges.where("dim = 0").orderBy(F.desc("n"), F.desc("size")).select("size").first()
    if most is None:
        return None
    rows = ranges.where(F.col("size") == most["size"]).orderBy("dim").collect()
    return np.array([r["low"] for r in rows], dtype=np.int64), np.array([r["high"] for r in rows], dtype=np.int64)


def moments(vectors: DataFrame, low: np.ndarray, high: np.ndarray) -> Moments:
    """Exact sums and cross-products by bit planes."""
    size = len(low)
    widths = np.array([*(int(h - lo).bit_length() for lo, h in zip(low.tolist(), high.tolist())), 1])
    kept = np.flatnonzero(widths > 0)  # a constant dimension has no plane
    limbs = max(1, -(-(2 * int(widths.max()) - 1) // LIMB))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(kept), len(kept), limbs), dtype=np.int64)
        for batch in batches:
            _, x = integers(_entries(batch), size)
            y = np.hstack([x - low, np.ones((len(x), 1), dtype=np.int64)])[:, kept]
            for k in range(0, len(y), ROWS_AT_ONCE):
                add_products(total, planes(y[k : k + ROWS_AT_ONCE], widths[kept]), widths[kept])
        d, e, limb = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept[d], pa.int32()), pa.array(kept[e], pa.int32()), pa.array(limb, pa.int32()), pa.array(total[d, e, limb], pa.int64())], names=["d", "e", "limb", "n"])

    counted = vectors.select("__vector").mapInArrow(giving_back(run), "d int, e int, limb int, n long").groupBy("d", "e", "limb").agg(F.sum("n").alias("n"))
    products = [[0] * (size + 1) for _ in range(size + 1)]
    for r in counted.collect():  # dimensions squared rows
        products[r["d"]][r["e"]] += r["n"] << (LIMB * r["limb"])
    return Moments(products[size][size], low.tolist(), [products[d][size] for d in range(size)], [row[:size] for row in products[:size]])


def eigen(m: Moments, top: int) -> Whitening:
    scatter, square = m.scatter(), m.n * m.n
    covariance = np.array([[v / square for v in row] for row in scatter])  # one correctly rounded division each
    values, vectors = np.linalg.eigh(covariance)
    values, axes = values[::-1][:top], vectors.T[::-1][:top]
    largest = np.abs(axes).argmax(axis=1)
    axes = axes * np.sign(axes[np.arange(len(axes)), largest])[:, None]
    return Whitening(m, axes, values, sum(scatter[d][d] for d in range(len(scatter))) / square)


def fit(df: DataFrame, vector: str = "embedding", top: int = 32) -> Whitening | None:
    """The first ``top`` components of all usable vectors; None if there is none."""
    vectors = _vectors(df, vector)
    found = spread(vectors)
    return None if found is None else eigen(moments(vectors, *found), top)


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, measured over all rows."""
    k, size = len(model.values), len(model.moments.low)
    shared = df.sparkSession.sparkContext.broadcast(model.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, plain = np.zeros((k + 1, k + 1)), shared.value
        for batch in batches:
            z = project(integers(_entries(batch), size)[1], plain)
            z = np.hstack([z, np.ones((len(z), 1))])
            total += z.T @ z
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    total = np.zeros((k + 1, k + 1))
    for r in _vectors(df, vector).mapInArrow(giving_back(run), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]  # (top + 1) squared rows
    mean = total[:k, k] / model.moments.n
    apart = total[:k, :k] / model.moments.n - np.outer(mean, mean) - np.eye(k)
    used = ~model.plain()["void"]
    return float(np.abs(apart[used][:, used]).max(initial=0.0))


COLUMNS = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, vector: str = "embedding", id: str = "vec_id", top: int = 32) -> DataFrame:
    """One row for each usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    kind = df.schema[id].dataType.simpleString()
    model = fit(df, vector, top)
    if model is None:
        return df.sparkSession.createDataFrame([], COLUMNS.format(id=kind))
    error, size, k, n = identity_error(df, model, vector), len(model.moments.low), len(model.values), model.moments.n
    shared = df.sparkSession.sparkContext.broadcast(model.plain())
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = shared.value
        for batch in batches:
            at, x = integers(_entries(batch), size)
            if not len(at):
                continue
            z = project(x, plain)
            rows = np.repeat(np.arange(len(at)), k)
            deviation = pa.array(deviations(x, plain), pa.int64()).take(pa.array(rows))
            void = np.tile(plain["void"], len(at))
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("__id")).take(pa.array(at[rows])), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                pa.array(np.full(len(rows), n), pa.int64()), deviation, pa.array(z.ravel(), mask=void),
                pa.array(np.tile(plain["explained"], len(at))), pa.array(np.full(len(rows), error))], names=names)

    return _vectors(df, vector, F.col(id).alias("__id")).mapInArrow(giving_back(run), COLUMNS.format(id=kind))
