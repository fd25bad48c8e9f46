"""Language-model scoring with Brown classes: exchange clustering and a class bigram model.

Tokens are words between white space, A-Z lower-cased, and one end after each text. Words travel as
64-bit hashes. The model of a token after another is

    P(w | v) = P(class(w) | class(v)) * P(w | class(w))

* Counts of all training tokens are summed on both sides of a shuffle.
* Exchange clustering: bigram counts of the ``frequent`` most frequent words (a dense matrix of fixed
  size) are counted over all training texts; words enter in order of frequency and are then moved, one
  by one, to the class that raises the class bigram likelihood most, until a sweep moves few. Every
  other word, however rare, is placed by the same gain from the classes of the nearest frequent words
  on its left and right: each split of the input makes the choice from all the word's places in it, and
  the choice with most places wins.
* Transitions are counted over all training tokens and mixed with class frequencies (Witten-Bell).
* Emissions take an absolute discount from each word; what a class saves is its probability of an
  unknown word, which is one type, as in the base. The class of an unknown word is summed over.

Scoring brings words and texts together by split of the input: the distinct words of a split meet
their counts in a join and come back as one sorted array, so no vocabulary is broadcast, and no text
meets more of it than it has. A split's group holds at most ``split_bytes`` of its file.

Rows: a null or empty text is one end. A row without id is never held out. Repeated rows count and
score each. Without training tokens the score is the base score. An empty table gives no rows; other
columns are not read.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import column, remainder, with_batches, words_of
from panelwright.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = b" "
TOKENS_AT_ONCE = 1_000_000


def hashes(text: str | None) -> np.ndarray:
    """Signed 64-bit hashes of the tokens of a text, the end included."""
    words = words_of(text)
    words.append(END)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64)


END_HASH = int(hashes(None)[0])


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for text in batch.column(batch.schema.get_field_index("text")):
            yield hashes(text.as_py())


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Token arrays in lists of about ``TOKENS_AT_ONCE`` tokens."""
    held, size = [], 0
    for tokens in texts_of(batches):
        held.append(tokens)
        size += len(tokens)
        if size >= TOKENS_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_counts(docs: DataFrame) -> DataFrame:
    """``w, c`` over all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches):
            w, c = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(c.astype(np.int64))], names=["w", "c"])

    return docs.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def places(sorted_words: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Index of every token in ``sorted_words``, -1 where it is not there."""
    if not len(sorted_words):
        return np.full(len(tokens), -1)
    at = np.searchsorted(sorted_words, tokens).clip(max=len(sorted_words) - 1)
    return np.where(sorted_words[at] == tokens, at, -1)


def frequent_bigrams(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """Counts of pairs of frequent words; a text begins after an end."""
    n = len(words)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = shared.value, np.zeros(n * n, dtype=np.int64)
        first = np.array([END_HASH])
        for held in gathered(batches):
            at = places(words, np.concatenate([first, *held]))
            pair = (at[:-1] * n + at[1:])[(at[:-1] >= 0) & (at[1:] >= 0)]
            total += np.bincount(pair, minlength=n * n)
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], names=["pair", "n"])

    rows = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n)  # at most n * n rows came back
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(n, n)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


class Exchange:
    """Class bigram counts under moves of single words."""

    def __init__(self, bigrams: np.ndarray, classes: int):
        self.g, self.k = bigrams, classes
        self.of = np.full(len(bigrams), -1)
        self.m = np.zeros((classes, classes))

    def profile(self, w: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Class counts on the left and on the right of a word, itself left out, and its own pairs."""
        placed = self.of >= 0
        placed[w] = False
        left = np.bincount(self.of[placed], self.g[placed, w], self.k)
        right = np.bincount(self.of[placed], self.g[w, placed], self.k)
        return left, right, self.g[w, w]

    def put(self, w: int, c: int, sign: int, left: np.ndarray, right: np.ndarray, own: float) -> None:
        self.m[:, c] += sign * left
        self.m[c, :] += sign * right
        self.m[c, c] += sign * own
        self.of[w] = c if sign > 0 else -1

    def gains(self, left: np.ndarray, right: np.ndarray, own: float) -> np.ndarray:
        """Change of the log likelihood if the word enters each class."""
        m, f = self.m, _f(self.m)
        into, out = _f(m + left[:, None]) - f, _f(m + right[None, :]) - f
        d = np.diag(m)
        gain = into.sum(0) - np.diag(into) + out.sum(1) - np.diag(out) + _f(d + left + right + own) - _f(d)
        rows, cols = m.sum(1), m.sum(0)
        # a class row grows by the right counts, every other row by the left counts of its class
        gain -= _f(rows + right.sum() + own + left) - _f(rows) + (_f(rows + left) - _f(rows)).sum() - (_f(rows + left) - _f(rows))
        gain -= _f(cols + left.sum() + own + right) - _f(cols) + (_f(cols + right) - _f(cols)).sum() - (_f(cols + right) - _f(cols))
        return gain

    def likelihood(self) -> float:
        return float(_f(self.m).sum() - _f(self.m.sum(1)).sum() - _f(self.m.sum(0)).sum())

    def run(self, sweeps: int) -> np.ndarray:
        order = np.argsort(-self.g.sum(1), kind="stable")
        for i, w in enumerate(order):
            p = self.profile(w)
            self.put(w, i if i < self.k else int(np.argmax(self.gains(*p))), 1, *p)
        for _ in range(sweeps):
            moved = 0
            for w in order:
                p, old = self.profile(w), int(self.of[w])
                self.put(w, old, -1, *p)
                gain = self.gains(*p)
                new = int(np.argmax(gain))
                new = new if gain[new] > gain[old] + 1e-9 else old
                self.put(w, new, 1, *p)
                moved += new != old
            if moved <= len(order) // 200:
                break
        return self.of


def place_rest(docs: DataFrame, words: np.ndarray, of: np.ndarray, m: np.ndarray) -> DataFrame:
    """``w, cls`` for every word that is not frequent, from its nearest frequent neighbours."""
    k = len(m)
    smooth = m + 0.5
    into = np.log(smooth) - np.log(smooth.sum(1, keepdims=True)) - np.log(smooth.sum(0, keepdims=True))  # [left class, class]
    shared = docs.sparkSession.sparkContext.broadcast((words, of, into.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of, into = shared.value
        first = np.array([END_HASH])
        for held in gathered(batches):
            tokens = np.concatenate([first, *held])
            at = places(words, tokens)
            rest = np.flatnonzero(at < 0)
            index = np.arange(len(tokens))
            before = np.maximum.accumulate(np.where(at >= 0, index, 0))
            after = np.minimum.accumulate(np.where(at >= 0, index, len(tokens) - 1)[::-1])[::-1]
            left, right = of[at[before[rest]]], of[at[after[rest]]]
            w, number, n = np.unique(tokens[rest], return_inverse=True, return_counts=True)
            for lo in range(0, len(w), 20_000):
                part = (number >= lo) & (number < lo + 20_000)
                size = min(20_000, len(w) - lo)
                a = np.bincount((number[part] - lo) * k + left[part], minlength=size * k).reshape(size, k).astype(np.float32)
                b = np.bincount((number[part] - lo) * k + right[part], minlength=size * k).reshape(size, k).astype(np.float32)
                best = (a @ into + b @ into.T).argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[lo : lo + size]), pa.array(best.astype(np.int32)), pa.array(n[lo : lo + size].astype(np.int64))], names=["w", "cls", "n"])

    votes = docs.select("text").mapInArrow(run, "w long, cls int, n long")
    # a word has at most as many rows here as there are classes
    return votes.groupBy("w", "cls").agg(F.sum("n").alias("n")).groupBy("w").agg(F.max(F.struct("n", "cls")).getField("cls").alias("cls"), F.sum("n").alias("c"))


@dataclass
class Model:
    train_tokens: int
    types: int
    discount: float
    class_tokens: np.ndarray
    class_types: np.ndarray
    transitions: np.ndarray | None = None

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.train_tokens + 0.1 * (self.types + 1)))

    def emission(self, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return np.log10((c - self.discount) / self.class_tokens[cls])

    def unknown(self) -> np.ndarray:
        return self.discount * self.class_types / np.maximum(self.class_tokens, 1)


class Scorer:
    """Log10 probability of class sequences; unknown words (255) are summed over their class."""

    def __init__(self, model: Model, end_class: int):
        self.t, self.end = model.transitions, end_class
        self.step = self.t * model.unknown()[None, :]
        self.logs: dict[int, np.ndarray] = {}

    def after(self, gap: int) -> np.ndarray:
        """Log10 of reaching a class from another over ``gap`` unknown words."""
        if gap not in self.logs:
            power, scale = np.eye(len(self.t)), 0.0
            for _ in range(gap):
                power = power @ self.step
                top = power.max()
                if top <= 0:
                    break
                power, scale = power / top, scale + np.log10(top)
            if len(self.logs) > 500:
                self.logs.clear()
            self.logs[gap] = np.log10(np.maximum(power @ self.t, 1e-300)) + scale
        return self.logs[gap]

    def score(self, classes: np.ndarray) -> float:
        known = np.flatnonzero(classes != 255)
        y = classes[known].astype(np.int64)
        previous = np.concatenate([[self.end], y[:-1]])
        gaps = np.diff(known, prepend=-1) - 1
        total = 0.0
        for gap in np.unique(gaps):
            at = gaps == gap
            total += float(self.after(int(gap))[previous[at], y[at]].sum())
        return total


def by_split(docs: DataFrame, split_bytes: int) -> DataFrame:
    """``docs`` with ``split``: the part of the input file that a row comes from, in ``split_bytes`` pieces."""
    spark = docs.sparkSession
    whole = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(whole[-1:], 1)
    parts = max(1, -(-int(whole.rstrip("kmg")) * unit // split_bytes))
    return docs.withColumn("split", F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))))


def vocabulary_by_split(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``split, w, c, cls``: the known words of each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for split, parts in held.items():
                w = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), split)), pa.array(w)], names=["split", "w"])
            held.clear()

        for batch in batches:
            for split, text in zip(column(batch, "split"), batch.column(batch.schema.get_field_index("text"))):
                tokens = hashes(text.as_py())
                held.setdefault(split, []).append(tokens)
                size += len(tokens)
                if size >= 4 * TOKENS_AT_ONCE:
                    yield from flush()
                    size = 0
        yield from flush()

    pairs = docs.select("split", "text").mapInArrow(run, "split long, w long")
    return pairs.join(vocabulary, "w").select("split", "w", "c", "cls")


ENCODED = "doc_id {id}, held_out boolean, n_tokens long, n_known long, base_score double, emission double, classes binary"


def encoded(docs: DataFrame, vocabulary: DataFrame, model: Model) -> DataFrame:
    """Counts, base score, emission part and class sequence of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model = Model(**shared.value)
        w = right.column("w").to_numpy()
        order = np.argsort(w)
        w, c, cls = w[order], right.column("c").to_numpy()[order], right.column("cls").to_numpy()[order]
        first = np.concatenate([[True], w[1:] != w[:-1]]) if len(w) else np.zeros(0, dtype=bool)
        w, c, cls = w[first], c[first], cls[first]
        base, unseen = model.base(c), float(model.base(np.zeros(1))[0])
        emission = model.emission(c, cls)
        out: list[list] = [[] for _ in range(5)]
        for text in left.column("text"):
            at = places(w, hashes(text.as_py()))
            known = at >= 0
            k = at[known]
            classes = np.full(len(at), 255, dtype=np.uint8)
            classes[known] = cls[k]
            for column_, value in zip(out, (len(at), len(k), float(base[k].sum()) + unseen * (len(at) - len(k)), float(emission[k].sum()), classes.tobytes())):
                column_.append(value)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.table([left.column("doc_id"), left.column("held_out"), *[pa.array(v, t) for v, t in zip(out, kinds)]],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emission", "classes"])

    schema = ENCODED.format(id=docs.schema["doc_id"].dataType.simpleString())
    words = vocabulary_by_split(docs, vocabulary)
    return docs.select("split", "doc_id", "held_out", "text").groupBy("split").cogroup(words.groupBy("split")).applyInArrow(run, schema)


def class_transitions(rows: DataFrame, classes: int, end_class: int) -> np.ndarray:
    """Counts of class pairs over the training texts, a text beginning after an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            for y in batch.column(0):
                y = np.frombuffer(y.as_py(), dtype=np.uint8).astype(np.int64)
                total += np.bincount(np.concatenate([[end_class], y[:-1]]) * classes + y, minlength=classes * classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes * classes)), pa.array(total)], names=["pair", "n"])

    out = np.zeros(classes * classes)
    counted = rows.where("not held_out").select("classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # classes squared rows
        out[r["pair"]] = r["n"]
    return out.reshape(classes, classes)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Rows as probabilities: counts mixed with class frequencies, the more the more followers a class has."""
    overall = (counts.sum(0) + 0.1) / (counts.sum(0) + 0.1).sum()
    kinds = np.maximum((counts > 0).sum(1, keepdims=True), 1)
    return (counts + kinds * overall[None, :]) / (counts.sum(1, keepdims=True) + kinds)


def score(docs: DataFrame, classes: int = 64, frequent: int = 1024, sweeps: int = 8, split_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), (remainder(F.col("doc_id"), 10) == 0).alias("held_out"))
    train = docs.where("not held_out")
    counts = cut_lineage(word_counts(train), "counts")
    tokens, types, once, twice = counts.agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    if not tokens:
        model = Model(0, 0, 0.0, np.zeros(classes), np.zeros(classes))
        none = counts.select("w", "c", F.lit(0).alias("cls"))
        rows = encoded(by_split(docs, split_bytes), none, model)
        return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(0).cast("long").alias("train_tokens"), "base_score", F.col("base_score").alias("score"))

    top = {r["w"] for r in counts.orderBy(F.desc("c"), "w").limit(frequent).collect()} | {END_HASH}
    words = np.array(sorted(top), dtype=np.int64)
    exchange = Exchange(frequent_bigrams(train, words), min(classes, len(words)))
    of = exchange.run(sweeps)
    fixed = docs.sparkSession.createDataFrame([(int(w), int(c)) for w, c in zip(words, of)], "w long, cls int")
    vocabulary = place_rest(train, words, of, exchange.m).select("w", "c", "cls").unionByName(
        counts.join(F.broadcast(fixed), "w").select("w", "c", "cls"))  # at most frequent + 1 rows
    vocabulary = cut_lineage(vocabulary, "vocabulary")

    sizes, kinds = np.zeros(classes), np.zeros(classes)
    for r in vocabulary.groupBy("cls").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        sizes[r["cls"]], kinds[r["cls"]] = r["c"], r["n"]
    model = Model(tokens, types, (once + 1) / (once + 1 + 2 * (twice + 1)), sizes, kinds)
    rows = cut_lineage(encoded(by_split(docs, split_bytes), vocabulary, model), "encoded")
    end_class = int(of[np.searchsorted(words, END_HASH)])
    model.transitions = smoothed(class_transitions(rows, classes, end_class))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def make():
        scorer = Scorer(Model(**shared.value), end_class)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            parts = zip(batch.column(batch.schema.get_field_index("classes")), column(batch, "emission"))
            return [pa.array([e + scorer.score(np.frombuffer(y.as_py(), dtype=np.uint8)) for y, e in parts], pa.float64())]

        return work

    out = with_batches(rows, make, "score double", ["doc_id", "held_out", "n_tokens", "n_known", "base_score"])
    return out.withColumn("train_tokens", F.lit(tokens)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
