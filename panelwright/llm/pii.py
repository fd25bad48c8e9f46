"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns find the base spans (e-mail, IP, card, phone); they always stay. The field labels the
tokens between white space that hold a digit or an ``@`` or repeat a part of a found e-mail ("active"
tokens; all others are observed as plain) with begin and inside labels of the four kinds, or none. A
part is a name before the ``@`` that has a mark inside (``john.smith``), or any such name with its domain
within three tokens after it. Factors:

* unary: a bounded pattern of counts of the token (digits, letters, marks, checksum) with the label;
* chain: labels of neighbouring tokens, plain neighbours being observed;
* skip: labels of tokens of a document whose digits, or whose letters and digits, are the same, or that
  repeat a part of the same e-mail: all are linked through one cluster variable (long repeats stay
  linear). Where base spans cover some of them, it has their labels as evidence, so that every repeat is
  reached in two steps and no number of unlabelled repeats outvotes it.

Factors are trained piece by piece: each is a table estimated from counts over all documents, where
tokens inside base spans have their kind (the skip table from each token of a cluster and the one before
it; tokens active only as parts are not counted, their label being unknown). In a document the tokens of
base spans are evidence; loopy belief propagation passes it along both kinds of edges until no message
changes by more than ``TOLERANCE``, so a cut or reformatted repeat of a found entity takes its label. The
damping grows with the rounds, which ends cycles; a text that still had one after 2,000 rounds would keep
its averaged messages (random dense texts took at most 148 rounds, given documents 24). Runs with a posterior of at least ``threshold`` and the number of
digits of their kind become further spans.

Two passes over the text without a shuffle of texts; the driver sees only the factor tables, whose
size is bounded by the pattern alphabet. Memory of a task: the active tokens of one document.

Rows: a null or empty text has no spans; repeated rows are judged one by one (and count each in the
tables); an empty table gives no rows and an untrained field; other columns are not read.
"""
from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import NUMBER, giving_back, with_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
ACTIVE = re.compile(r"[0-9@]")
KEEP = re.compile(r"[A-Za-z0-9+(@].*[A-Za-z0-9)]|[A-Za-z0-9]", re.S)
DIGITS = {"email": (0, 10**9), "ip": (4, 12), "card": (13, 19), "phone": (7, 15)}
LABELS = ["none"] + [f"{p}-{k}" for k in KINDS for p in ("begin", "inside")]
L = len(LABELS)
PLAIN = L
TOLERANCE = 1e-4


def letters_and_digits(word: str) -> str:
    return "".join(c for c in word if c.isalnum()).lower()


def parts_of(text: str, spans: list[tuple[str, int, int]]) -> dict[str, set[str]]:
    """Names before the ``@`` of found e-mails with their domains, both in letters and digits."""
    out: dict[str, set[str]] = {}
    for kind, a, b in spans:
        if kind == "email":
            name, _, domain = text[a:b].rpartition("@")
            if len(letters_and_digits(name)) >= 3:
                out.setdefault(letters_and_digits(name), set()).add(letters_and_digits(domain))
    return out


def repeated_parts(words: list[str], parts: dict[str, set[str]]) -> dict[int, tuple[str, str]]:
    """Places of the tokens that repeat a part of an e-mail, with the key of its cluster."""
    out: dict[int, tuple[str, str]] = {}
    plain = [letters_and_digits(w) for w in words]
    for k, name in enumerate(plain):
        if name in parts and "@" not in words[k]:
            domain = next((j for j in range(k + 1, min(k + 4, len(plain))) if plain[j] in parts[name]), None)
            core = KEEP.search(words[k])
            if domain is not None:
                out[domain] = ("m", name)
            if domain is not None or (core and not core[0].isalnum() and len(name) >= 6):
                out[k] = ("m", name)
    return out


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards: linear in texts without spaces."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans in the order of the kinds, then by start."""
    out = [("email", a, b) for a, b in emails(text)]
    if NUMBER.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class Tokens:
    """Active tokens of one text with their patterns, observed labels and edges."""

    def __init__(self, text: str, spans: list[tuple[str, int, int]]):
        self.spans: list[tuple[int, int]] = []
        self.patterns: list[tuple] = []
        self.chain: list[tuple[int, int]] = []
        self.left_plain: list[bool] = []
        self.right_plain: list[bool] = []
        self.skip: list[tuple[int, int]] = []
        self.clusters: list[list[int]] = []
        self.part_only: set[int] = set()
        self.observed: list[int] = []
        parts = parts_of(text, spans)
        again = repeated_parts(TOKEN.findall(text), parts) if parts else {}
        last_index, last_active, seen = -2, -1, {}
        for index, m in enumerate(TOKEN.finditer(text)):
            word = m[0]
            if not ACTIVE.search(word):
                if index not in again:
                    continue
                self.part_only.add(len(self.spans))
            core = KEEP.search(word)
            start = m.start() + (core.start() if core else 0)
            end = m.start() + (core.end() if core else len(word))
            word = text[start:end]
            k = len(self.spans)
            self.spans.append((start, end))
            digits = "".join(c for c in word if "0" <= c <= "9")
            letters = sum(c.isalpha() for c in word)
            valid = (13 <= len(digits) <= 19 and luhn(digits)) or (word.count(".") == 3 and not letters and all(p.isascii() and p.isdigit() and int(p[:4]) <= 255 for p in word.split(".")))
            self.patterns.append((min(len(digits), 20), min(letters, 3), "@" in word, min(word.count("."), 4), word[:1] == "+", word[:1] == "(", "-" in word, bool(valid)))
            adjacent = last_index == index - 1
            if adjacent:
                self.chain.append((last_active, k))
                self.right_plain[last_active] = False
            self.left_plain.append(not adjacent)
            self.right_plain.append(True)
            name = letters_and_digits(word.rpartition("@")[0]) if parts else ""
            keys = {("d", digits) if len(digits) >= 6 else None, ("w", letters_and_digits(word)) if len(word) >= 6 else None,
                    again.get(index), ("m", name) if name in parts else None}
            for key in keys - {None}:
                seen.setdefault(key, []).append(k)
            self.observed.append(-1)
            last_index, last_active = index, k
        self.clusters = sorted(map(list, {tuple(c) for c in seen.values() if len(c) > 1}))
        self.skip = sorted({pair for c in self.clusters for pair in zip(c, c[1:])})
        starts = np.array([s for s, _ in self.spans], dtype=np.int64)
        for kind, a, b in reversed(spans):  # the first kinds win
            begin = 1 + 2 * KINDS.index(kind)
            i = max(0, int(np.searchsorted(starts, a, side="right")) - 1)
            first = True
            while i < len(starts) and starts[i] < b:
                if self.spans[i][1] > a:
                    self.observed[i] = begin if first else begin + 1
                    first = False
                i += 1


def count_factors(text: str | None) -> Counter:
    """Counts of (factor, pattern or label, label) in one text."""
    out: Counter = Counter()
    if not text or not ACTIVE.search(text):
        return out
    t = Tokens(text, base_spans(text))
    y = [max(0, v) for v in t.observed]
    for k, pattern in enumerate(t.patterns):
        if k in t.part_only:
            continue
        out["unary", repr(pattern), y[k]] += 1
        if t.left_plain[k]:
            out["chain", str(PLAIN), y[k]] += 1
        if t.right_plain[k]:
            out["chain", str(y[k]), PLAIN] += 1
    for factor, edges in (("chain", t.chain), ("skip", t.skip)):
        for a, b in edges:
            if a not in t.part_only and b not in t.part_only:
                out[factor, str(y[a]), y[b]] += 1
    return out


class Field:
    """Factor tables as log potentials. Tasks get the counts and build it themselves: no worker has to import this class."""

    def __init__(self, counts: dict[tuple[str, str, int], int]):
        self.counts = counts
        marginal = np.zeros(L)
        for (factor, _, y), n in counts.items():
            if factor == "unary":
                marginal[y] += n
        self.prior = (marginal + 0.1) / (marginal + 0.1).sum()
        rows: dict[str, np.ndarray] = {}
        chain, skip = np.full((L + 1, L + 1), 0.05), np.full((L, L), 0.05)
        skip[np.arange(L), np.arange(L)] += 1.0
        for (factor, key, y), n in counts.items():
            if factor == "unary":
                rows.setdefault(key, np.zeros(L))[y] += n
            elif factor == "chain":
                chain[int(key), y] += n
            else:
                skip[int(key), y] += n
        self.unary = {k: np.log((v + self.prior) / (v.sum() + 1)) for k, v in rows.items()}
        self.unseen = np.log(self.prior)
        gain = lambda t: np.log(t / t.sum()) - np.log(t.sum(1, keepdims=True) / t.sum()) - np.log(t.sum(0, keepdims=True) / t.sum())
        self.chain, self.skip = gain(chain), gain(skip)

    def posterior(self, t: Tokens, rounds: int = 2000) -> np.ndarray:
        """Marginals by loopy belief propagation, iterated until it has converged; all messages of a round are made at once."""
        n = len(t.spans)
        theta = np.array([self.unary.get(repr(p), self.unseen) for p in t.patterns])
        theta[np.array(t.left_plain)] += self.chain[PLAIN, :L]
        theta[np.array(t.right_plain)] += self.chain[:L, PLAIN]
        for k, y in enumerate(t.observed):
            if y >= 0:
                theta[k] = -60.0
                theta[k, y] = 0.0
        evidence = np.zeros((len(t.clusters), L))
        known = np.zeros(n + len(t.clusters), dtype=bool)
        for c, members in enumerate(t.clusters):
            labels = [t.observed[k] for k in members if t.observed[k] >= 0]
            if labels:
                known[n + c] = True
                evidence[c] = np.log(np.maximum(np.bincount(labels, minlength=L) / len(labels), 1e-26))
        theta = np.concatenate([theta, evidence])
        edges = t.chain + [(n + c, k) for c, members in enumerate(t.clusters) for k in members]
        if edges:
            pairs = np.array(edges)
            src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
            e, chained = len(pairs), len(t.chain)
            back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
            kind = np.tile(np.arange(e) >= chained, 2) + 2 * (np.arange(2 * e) >= e)
            tables = np.stack([self.chain[:L, :L], self.skip, self.chain[:L, :L].T, self.skip.T])
            messages = np.zeros((2 * e, L))
            closed = known[dst]  # a cluster with evidence listens to nothing else
            for turn in range(rounds):
                belief = theta.copy()
                np.add.at(belief, dst, messages)
                out = belief[src] - messages[back]
                fresh = np.empty_like(messages)
                for lo in range(0, 2 * e, 20_000):
                    part = slice(lo, lo + 20_000)
                    fresh[part] = np.logaddexp.reduce(out[part, :, None] + tables[kind[part]], axis=1)
                fresh -= fresh.max(axis=1, keepdims=True)
                fresh[closed] = 0.0
                change = np.abs(fresh - messages).max()
                if change < TOLERANCE:
                    break
                keep = 1 - 0.5 ** (1 + turn // 200)
                messages = keep * messages + (1 - keep) * fresh
            np.add.at(theta, dst, messages)
        theta = theta[:n]
        theta -= np.logaddexp.reduce(theta, axis=1)[:, None]
        return np.exp(theta).reshape(n, L)

    def spans(self, text: str, base: list[tuple[str, int, int]], threshold: float) -> list[tuple[str, int, int]]:
        """Spans that the field adds to the base ones."""
        t = Tokens(text, base)
        if not t.spans or all(y > 0 for y in t.observed):
            return []
        p = self.posterior(t)
        kinds = p[:, 1:].reshape(len(p), len(KINDS), 2).sum(axis=2)
        best = np.where((kinds.max(axis=1) >= threshold) & (np.array(t.observed) < 0), kinds.argmax(axis=1), -1)
        linked = {b for _, b in t.chain}
        out, k = [], 0
        while k < len(best):
            j = k + 1
            if best[k] >= 0:
                while j < len(best) and best[j] == best[k] and j in linked:
                    j += 1
                kind, start, end = KINDS[best[k]], t.spans[k][0], t.spans[j - 1][1]
                low, high = DIGITS[kind]
                if low <= sum("0" <= c <= "9" for c in text[start:end]) <= high and not any(a < end and start < b for _, a, b in base):
                    out.append((kind, start, end))
            k = j
        return out


def train(docs: DataFrame) -> Field:
    """Factor tables counted over all texts, summed before and after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(batch.schema.get_field_index("text")):
                total.update(count_factors(text.as_py()))
        rows = [(*k, n) for k, n in total.items()]
        if rows:
            a, b, c, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c, pa.int32()), pa.array(n, pa.int64())], names=["factor", "key", "label", "n"])

    counts = docs.select("text").mapInArrow(giving_back(run), "factor string, key string, label int, n long")
    rows = counts.groupBy("factor", "key", "label").agg(F.sum("n").alias("n")).collect()  # bounded by the pattern alphabet
    return Field({(r["factor"], r["key"], r["label"]): r["n"] for r in rows})


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def all_spans(text: str, field: Field, threshold: float) -> tuple[list, list]:
    """Base spans of one text and those that the field adds."""
    if not ACTIVE.search(text):
        return [], []
    base = base_spans(text)
    return base, field.spans(text, base, threshold)


def find(docs: DataFrame, field: Field, keep: list[str] | None = None, threshold: float = 0.95) -> DataFrame:
    """Counts and digest of base spans and all spans of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(field.counts)
    added = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def make():
        field = Field(shared.value)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            counts, digests, spans, more = {k: [] for k in KINDS}, [], [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                base, extra = all_spans(text.as_py() or "", field, threshold)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + extra))
                more.append(len(extra))
            return [pa.array(counts[k], pa.int64()) for k in KINDS] + [pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())]

        return work

    names = [f.split()[0] for f in added.split(", ")]
    return with_batches(docs, make, added, [c for c in (docs.columns if keep is None else keep) if c not in names])


def masked(text: str, spans: str) -> str:
    """``text`` with every span, or run of overlapping spans, replaced by the name of its first kind."""
    parts, at = [], 0
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, field: Field, threshold: float = 0.95) -> DataFrame:
    """``docs`` with personal data masked in ``text``; a null text stays null."""
    own = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c != "text"})
    shared = docs.sparkSession.sparkContext.broadcast(field.counts)

    def make():
        field = Field(shared.value)

        def clean(text: str | None) -> str | None:
            base, extra = all_spans(text or "", field, threshold)
            return masked(text, joined(base + extra)) if base or extra else text

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([clean(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))], pa.string())]

        return work

    out = with_batches(own, make, "__text string", [c for c in own.columns if c != "text"])
    return out.select(*[F.col("__text").alias("text") if c == "text" else F.col(f"__own_{c}").alias(c) for c in docs.columns])
