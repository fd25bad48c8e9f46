from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from panelwright.llm import queries, whitening


def expected(vectors):
    """Integers, number, exact sums and exact covariance of plain lists."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, size = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(size)]
    v = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(size)] for i in range(size)]
    return x, n, s, v


def check(rows, usable, top=32):
    """``usable``: (id, vector) pairs whose rows must come, by definition in exact numbers."""
    x, n, s, v = expected([w for _, w in usable])
    size, k = len(s), min(top, len(s))
    values, axes = np.linalg.eigh(np.array([[float(c) for c in row] for row in v]))
    values, axes = values[::-1][:k], axes.T[::-1][:k]
    trace = float(sum(v[d][d] for d in range(size)))
    got = defaultdict(list)
    for r in rows:
        got[r.vec_id].append(r)
    assert len(rows) == k * len(usable) and set(got) == {i for i, _ in usable}
    sign = None
    for (i, _), own in zip(usable, x):
        mine = sorted(got[i], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, k + 1))
        assert {r.n for r in mine} == {n} and {r.deviation for r in mine} == {sum((n * a - b) ** 2 for a, b in zip(own, s))}
        centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(own, s)])
        want = axes @ centred / np.sqrt(values)
        have = np.array([r.whitened for r in mine])
        sign = np.where(np.abs(want) > 1e-6, np.sign(want * have), sign if sign is not None else 1.0) if sign is None else sign
        assert np.allclose(np.abs(have), np.abs(want), atol=1e-6)
        assert np.allclose([r.explained for r in mine], values / trace, rtol=1e-9)
        assert all(r.identity_error <= 1e-9 for r in mine)
    return got


def test_whole_table(spark, small):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    rows = queries.QUERIES["op11_whiten_by_bit_planes"](spark, small).collect()
    check(rows, vectors)
    z = np.zeros((len(vectors), 32))
    at = {v: k for k, (v, _) in enumerate(vectors)}
    for r in rows:
        z[at[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(np.cov(z.T, bias=True) - np.eye(32)).max() < 1e-9


def frame(spark, rows, extra=False):
    ddl = "vec_id long, embedding array<double>" + (", component string, n string, __vector int" if extra else "")
    return spark.createDataFrame([(*r, "x", "y", 3) if extra else r for r in rows], ddl)


def test_edges(spark):
    draw = np.random.RandomState(3)
    good = [(i, (draw.randn(3) * [1, 20, 300]).tolist()) for i in range(200)]
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [1.0, float("nan"), 0.0]), (904, [float("inf"), 0.0, 0.0]), (905, [1.0, 2.0])]
    got = check(whitening.whiten(frame(spark, bad + good, extra=True)).collect(), good)
    assert not set(got) & {i for i, _ in bad}
    again = whitening.whiten(frame(spark, (good + bad)[::-1]).repartition(7)).collect()
    key = lambda r: (r.vec_id, r.component)
    for a, b in zip(sorted((r for own in got.values() for r in own), key=key), sorted(again, key=key)):
        assert a[:5] == b[:5]  # exact numbers don't depend on the split
    assert whitening.whiten(frame(spark, bad[:5])).count() == 0 and whitening.whiten(frame(spark, [])).count() == 0


def test_no_variance_and_repeats(spark):
    one = whitening.whiten(frame(spark, [(7, [0.5, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, 0.0)] * 2
    flat = whitening.whiten(frame(spark, [(None, [1.0, 0.0, 5.0]), (1, [2.0, 0.0, 5.0]), (1, [2.0, 0.0, 5.0])])).collect()
    assert len(flat) == 9 and {r.n for r in flat} == {3}
    for r in flat:
        assert (r.whitened is None) == (r.component > 1) and r.explained == pytest.approx(1.0 if r.component == 1 else 0.0)
        assert r.deviation == (128**2 if r.vec_id is None else 64**2)


def test_huge_entries_and_overflow(spark):
    rows = [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, 3.0]), (3, [0.25, 1.0])]
    found = whitening.whiten(frame(spark, rows)).collect()
    assert all(r.deviation is None for r in found if r.vec_id < 2)
    for r in found:  # beside the huge entries the other dimension is below the precision of a double
        assert (r.whitened is None) == (r.component == 2) and r.identity_error < 1e-4


def test_products_by_planes_equal_plain_products():
    draw = np.random.RandomState(11)
    for rows, size, top in ((1, 1, 2), (63, 3, 9), (64, 5, 1 << 20), (1000, 4, 1 << 40), (130, 2, 1 << 62)):
        y = draw.randint(0, top, (rows, size), dtype=np.int64)
        widths = np.array([max(1, int(v).bit_length()) for v in y.max(axis=0)])
        limbs = -(-(2 * int(widths.max()) - 1) // whitening.LIMB)
        total = np.zeros((size, size, limbs), dtype=np.int64)
        for part in (y[: rows // 2], y[rows // 2 :]):
            if len(part):
                whitening.add_products(total, whitening.planes(part, widths), widths)
        for i in range(size):
            for j in range(i, size):
                assert sum(int(v) << (16 * k) for k, v in enumerate(total[i, j])) == sum(a * b for a, b in zip(y[:, i].tolist(), y[:, j].tolist()))


def test_deviation_is_exact_up_to_64_bits():
    fit = {"n": 3_000_000_000, "low": np.array([0]), "whole": np.array([1]), "part": np.array([0.5]), "sums": [4_500_000_000]}
    assert whitening.deviations(np.array([[0], [1], [2], [4]]), fit) == [None, 1_500_000_000**2, 1_500_000_000**2, None]
