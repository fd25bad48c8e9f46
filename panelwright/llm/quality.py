"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Training data are trusted positives and unlabelled web text; no negative label is used. The class
prior is estimated first (best bin estimate): a plain positive-against-unlabelled classifier is
fitted on one half, and on the other half the smallest ratio of the two tail frequencies, over all
thresholds and with a margin for the sample, bounds the share of positives. Then a linear model on
the features below minimises

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

with the logistic loss, so the sigmoid of g estimates the probability of label 1; where the second
part falls below zero the step goes against it, as the method says.

Features see the text only: frequencies of byte pairs in hashed bins and a few ratios (letter case,
digits, marks, word lengths, repeated words and lines). Scoring is one pass without a shuffle.
Fitting reads at most ``sample`` positives and ``sample`` unlabelled documents, taken by hash of the
id; that bound is the only one.

Rows: a null or empty text has the features of an empty text and gets a score; labels that are
null, or that differ for one id, are not trusted; a null id can't be labelled; repeated ids train
once. Without positives or documents to learn from every score is 0.5. Extra columns stay as they are.
"""
from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import column, grown, remainder, with_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 512
MARKS = [ord(c) for c in ".,;:!?|*#%$&@_=/\\()[]{}<>\"'+-~^`"]
WIDTH = BINS + len(MARKS) + 18


def features(text: str | None) -> np.ndarray:
    """One row of float32; lengths never dominate, as all entries are ratios or logarithms."""
    raw = text.encode("utf-8", "replace") if text else b""
    out = np.zeros(WIDTH, dtype=np.float32)
    if not raw:
        out[-1] = 1.0
        return out
    codes = np.frombuffer(raw, dtype=np.uint8)
    n = len(codes)
    if n > 1:
        pairs = (codes[:-1].astype(np.uint32) << 8) | codes[1:]
        out[:BINS] = np.bincount(((pairs * np.uint32(2654435761)) >> np.uint32(23)).astype(np.int64), minlength=BINS)
        out[:BINS] /= n - 1
        np.sqrt(out[:BINS], out=out[:BINS])
    single = np.bincount(codes, minlength=256) / n
    out[BINS : BINS + len(MARKS)] = np.sqrt(single[MARKS])
    words = raw.split()
    lines = raw.split(b"\n")
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    upper, lower, digit = single[65:91].sum(), single[97:123].sum(), single[48:58].sum()
    kinds = set(words)
    at = BINS + len(MARKS)
    out[at : at + 17] = (
        upper, lower, digit, upper / (upper + lower + 1e-9), single[[9, 10, 11, 12, 13, 32]].sum(), single[128:].sum(),
        np.log1p(n) / 12, np.log1p(len(words)) / 10, min(lengths.mean(), 50) / 10, min(lengths.std(), 50) / 10, min(lengths.max(), 200) / 50,
        len(kinds) / max(1, len(words)), len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 10,
        sum(1 for w in words if len(w) == 1) / max(1, len(words)),
        sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words) - 1),
        len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-g.clip(-30, 30)))


def _descend(xp: np.ndarray, xu: np.ndarray, prior: float | None, steps: int, penalty: float, rate: float) -> np.ndarray:
    """Adam on whole samples. Without a prior: plain positives against unlabelled, evenly weighted."""
    w = np.zeros(xp.shape[1] + 1)
    if prior is not None:
        w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    xp, xu = one(xp), one(xu)
    for t in range(1, steps + 1):
        gp, gu = xp @ w, xu @ w
        sp, su = 1 / (1 + np.exp(-gp.clip(-30, 30))), 1 / (1 + np.exp(-gu.clip(-30, 30)))
        up = xp.T @ (sp - 1) / len(xp)  # gradient of the mean of l(g) over positives
        down_p, down_u = xp.T @ sp / len(xp), xu.T @ su / len(xu)
        if prior is None:
            grad = 0.5 * up + 0.5 * down_u
        else:
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            rest = down_u - prior * down_p
            grad = prior * up + rest if negative >= 0 else -rest
        grad[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(sp: np.ndarray, su: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores of both on data the scorer has not seen."""
    cut = np.unique(sp)
    above = lambda s: 1 - np.searchsorted(np.sort(s), cut, side="left") / len(s)
    qp, qu = above(sp), above(su)
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    k = int(np.argmin((qu + margin) / qp))
    return float(np.clip(qu[k] / qp[k], 0.02, 0.98))


def fit(xp: np.ndarray, xu: np.ndarray, prior: float | None = None, steps: int = 600) -> Model:
    """Fit on feature rows of positives and unlabelled documents."""
    everything = np.vstack([xp, xu]).astype(np.float64)
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    z = lambda x: ((x - mean) / scale).clip(-8, 8)
    zp, zu = z(xp), z(xu)
    if prior is None:
        w = _descend(zp[::2], zu[::2], None, steps // 3, 1e-2, 0.02)
        prior = estimate_prior(zp[1::2] @ w[:-1], zu[1::2] @ w[:-1]) if len(zp) > 1 and len(zu) > 1 else 0.5
    return Model(mean, scale, _descend(zp, zu, prior, steps, 5e-4, 0.02), prior)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, folds: int) -> DataFrame:
    """Features of at most ``sample`` trusted positives and as many unlabelled documents outside fold 0."""
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != 0))
    trusted = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id").agg(F.min("quality").alias("low")).where("low = 1").select("doc_id"))
    order = F.xxhash64("doc_id", F.lit("positive-unlabelled"))
    positive = trusted.join(grown(docs.select("doc_id")), "doc_id", "left_semi").orderBy(order, "doc_id").limit(sample)
    free = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("web")), "doc_id").limit(sample)
    chosen = positive.withColumn("positive", F.lit(True)).unionByName(free.withColumn("positive", F.lit(False)))
    # at most 2 * sample ids: the bound makes the hint safe
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([features(t).astype("<f4").tobytes() for t in column(batch, "text")], pa.binary())]

        return work

    return with_batches(texts, make, "x binary", ["positive", "doc_id"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, folds: int = 5, prior: float | None = None) -> Model | None:
    rows = training_rows(docs, labels, sample, folds).orderBy("positive", "doc_id").collect()  # at most 2 * sample rows
    part = lambda want: np.array([np.frombuffer(r["x"], dtype="<f4") for r in rows if r["positive"] == want]).reshape(-1, WIDTH)
    xp, xu = part(True), part(False)
    return fit(xp, xu, prior) if len(xp) and len(xu) else None


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else vars(model))  # plain values: no worker has to import the class

    def make():
        model = None if shared.value is None else Model(**shared.value)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(batch.schema.get_field_index("text"))
            if model is None:
                return [pa.array([0.5] * len(texts), pa.float64())]
            out: list[float] = []
            for k in range(0, len(texts), 256):
                part = [features(t.as_py()) for t in texts[k : k + 256]]
                out += model.score(np.array(part, dtype=np.float64)).tolist()
            return [pa.array(out, pa.float64())]

        return work

    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    return with_batches(docs, make, f"{name} double", kept)
