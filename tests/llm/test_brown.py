import math
import zlib
from collections import Counter

import numpy as np
import pytest

from panelwright.llm import brown, queries


def base(docs):
    """Contract's base score with a dictionary; docs: (doc_id, text)."""
    tokens = {i: [w.decode() for w in (t or "").encode().lower().split()] + [" end"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens.items()}


def test_whole_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = base(docs)
    rows = queries.QUERIES["op4_brown_class_scores"](spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        held, n, known, total, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9) and r.score < 0
    held = [r for r in rows if r.held_out]
    per_token = lambda c: sum(getattr(r, c) for r in held) / sum(r.n_tokens for r in held)
    assert per_token("score") > per_token("base_score") + 0.2


def test_exchange_gain_is_the_change_of_the_likelihood():
    rng = np.random.RandomState(1)
    x = brown.Exchange(rng.poisson(2.0, (12, 12)).astype(float), 4)
    x.run(1)
    for w in range(12):
        p, old = x.profile(w), int(x.of[w])
        x.put(w, old, -1, *p)
        before, gains = x.likelihood(), x.gains(*p)
        for c in range(4):
            x.put(w, c, 1, *p)
            assert x.likelihood() - before == pytest.approx(gains[c], abs=1e-8)
            x.put(w, c, -1, *p)
        x.put(w, old, 1, *p)


def test_classes_are_found():
    """Words of two alternating kinds end in different classes."""
    g = np.zeros((20, 20))
    g[:10, 10:], g[10:, :10] = 7, 5
    of = brown.Exchange(g + 0.01, 2).run(10)
    assert len(set(of[:10])) == 1 and len(set(of[10:])) == 1 and of[0] != of[10]


def test_probabilities_sum_to_one():
    """Over all known words and the unknown one, after any known word, also by way of unknown ones."""
    rng = np.random.RandomState(2)
    c, cls = rng.randint(1, 9, 40), np.arange(40) % 4
    sizes, kinds = np.bincount(cls, c, 4), np.bincount(cls, minlength=4)
    model = brown.Model(int(c.sum()), 40, 0.4, sizes, kinds.astype(float))
    model.transitions = brown.smoothed(rng.poisson(3.0, (4, 4)).astype(float))
    scorer = brown.Scorer(model, 0)
    emission = 10 ** model.emission(c, cls)
    for gap in (0, 1, 3):
        for a in range(4):
            reach = 10 ** scorer.after(gap)[a] @ np.ones(4)
            known = sum(10 ** scorer.after(gap)[a, k] * e for k, e in zip(cls, emission))
            unknown = (np.linalg.matrix_power(scorer.step, gap) @ scorer.step)[a].sum()
            assert known + unknown == pytest.approx(reach)
    y = np.array([1, 255, 255, 2, 0], dtype=np.uint8)
    walk = np.eye(4)[0]
    for k in y:
        walk = walk @ model.transitions * (model.unknown() if k == 255 else np.eye(4)[k])
    assert scorer.score(y) == pytest.approx(math.log10(walk.sum()))


@pytest.mark.parametrize("texts, ids", [([], []), ([None, ""], [None, 1]), (["A b", "a B c " * 2000, None, "a b", "a b"], [1, 2, 3, 4, 4]), (["x y"], [20])])
def test_edges(documents, texts, ids):
    rows = brown.score(documents(texts, ids=ids, extra=True), classes=3, frequent=4).collect()
    assert len(rows) == len(texts) and all(r.score <= 0 and r.n_tokens >= 1 for r in rows)
    assert sorted(r.n_tokens for r in rows) == sorted(len((t or "").split()) + 1 for t in texts)
