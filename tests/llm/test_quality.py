import zlib

import numpy as np
import pytest

from panelwright.llm import quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op5_quality_positive_unlabelled"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == q for p, q in held]) > 0.97
    assert np.mean([p for p, q in held if q == 1]) > 0.99


def test_prior_and_risk():
    """Two overlapping clouds: the prior is found and the risk separates them without a negative label."""
    rng = np.random.RandomState(0)
    cloud = lambda n, at: rng.normal(at, 1.0, (n, 4)).astype(np.float32)
    xp, xu = cloud(2000, 1.5), np.vstack([cloud(1400, 1.5), cloud(600, -1.5)])
    model = quality.fit(xp, xu)
    assert abs(model.prior - 0.7) < 0.08
    assert model.score(cloud(500, 1.5)).mean() > 0.95 and model.score(cloud(500, -1.5)).mean() < 0.1


@pytest.mark.parametrize("labels", [[], [(1, None), (2, 0), (None, 1)], [(0, 1), (0, 0)]])
def test_nothing_to_learn_from(spark, documents, labels):
    docs = documents([None, "", "a b"], extra=True)
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model is None and [r.score for r in quality.score(docs, model).collect()] == [0.5] * 3


def test_edges(spark, documents):
    texts = [None, "", "x" * 200_000, *["good words here"] * 20, *["|| $$ 11"] * 20]
    ids = [None, *range(1, len(texts) - 1), 7]
    docs = documents(texts, ids=ids, extra=True)
    model = quality.train(docs, spark.createDataFrame([(k, 1) for k in range(3, 15)] + [(3, 1)], "doc_id long, quality int"))
    out = quality.score(docs, model, name="score").collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 for r in out)
    assert quality.score(documents([]), model).count() == 0
