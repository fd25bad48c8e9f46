"""Byte-level BPE by dynamic programming over prefixes.

The merge order gives every prefix of a piece exactly one last token: the encoding of a prefix is the
encoding of what stands before that token, and the token. So one token for each prefix describes the
encodings of all of them:

* a suffix automaton of the vocabulary reads the piece byte by byte; its links list the tokens that end at
  the current byte, longest first;
* the first of them that stays apart from the last token of the prefix before it is the one. Two tokens stay
  apart if no merge across their border comes before the merges that made the two sides of it; this is seen
  by undoing the later merge, side by side, down to single bytes;
* following the tokens back from the end gives the ids.

This costs a bounded number of steps a byte (at most the number of tokens that are suffixes of each
other), however long the piece is, and needs no heap of merges.

Pieces are split as the file says (byte-level pattern, no prefix space). Texts within Latin letters are
split by a pattern, others by the tokenizer library's own splitter, so that both agree on every character.
Strings of added tokens in a text become their ids. Tables are made on the driver from the file, whose
size is fixed, and broadcast as arrays; executors need no file. Each process keeps the ids of at most
``KNOWN`` short pieces. There is no shuffle; a lost task repeats alone.

Decoding joins the bytes of the ids; bytes that are no UTF-8 become U+FFFD, as in the library.

Rows: a null text counts as an empty text (no ids, decoded as an empty text); repeated rows and ids are
encoded one by one; an empty table gives no rows; a table with a column named as one that is added loses
its own; a null id list decodes to null, an id outside the vocabulary is skipped, as in the library.
"""
from __future__ import annotations

import hashlib
import json
import re
import sys
import uuid
from collections.abc import Callable
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from panelwright.llm.common import column, process_cache, with_batches
from panelwright.llm.packing import BEYOND, LATIN

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Short pieces whose ids a process keeps, and pairs of tokens whose test it keeps.
KNOWN, SHORT, PAIRS = 200_000, 64, 1_000_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable Latin-1 characters for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(0x100 + k): b for k, b in enumerate(rest)}}


def merged(raw: bytes, single: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> tuple[list[int], tuple]:
    """Ids by merging step by step, and the last merge as (rank, left, right)."""
    ids, last = [single[b] for b in raw], (-1, -1, -1)
    while len(ids) > 1:
        rank, k = min((merges[pair][0], k) if pair in merges else (1 << 40, k) for k, pair in enumerate(zip(ids, ids[1:])))
        if rank == 1 << 40:
            break
        last = (rank, ids[k], ids[k + 1])
        ids[k : k + 2] = [merges[ids[k], ids[k + 1]][1]]
    return ids, last


def suffix_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Transitions, links and lengths of the automaton of all parts of all words; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def split(p: int, c: int, q: int) -> int:
        """A state for the part of ``q`` that is one longer than ``p``."""
        if length[q] == length[p] + 1:
            return q
        copy = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy

    for word in words:
        at = 0
        for c in word:
            q = step[at].get(c)
            if q is not None:
                at = split(at, c, q)
                continue
            fresh = len(step)
            step.append({})
            link.append(0)
            length.append(length[at] + 1)
            p = at
            while p >= 0 and c not in step[p]:
                step[p][c] = fresh
                p = link[p]
            if p >= 0:
                link[fresh] = split(p, c, step[p][c])
            at = fresh
    return step, link, length


def tables(path: str) -> dict:
    """What a worker needs, as arrays and plain values, from a tokenizer file."""
    with open(path, encoding="utf-8") as lines:
        file = json.load(lines)
    model, splitter = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or file["normalizer"] or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
        raise ValueError(f"{path} is no byte-level BPE file with the usual splitter")
    letters = byte_letters()
    spell = lambda token: bytes(letters[c] for c in token)
    vocabulary: dict[str, int] = model["vocab"]
    single = [vocabulary[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.setdefault((vocabulary[left], vocabulary[right]), (rank, vocabulary[left + right]))
    words, made = {}, []
    for token, i in vocabulary.items():
        if all(c in letters for c in token):
            ids, last = merged(spell(token), single, merges)
            if ids == [i]:  # any other token can't be in an encoding
                words[spell(token)] = i
                made.append((i, *last))
    step, link, length = suffix_automaton(list(words))
    token = np.full(len(step), -1, dtype=np.int32)
    for word, i in words.items():
        at = 0
        for c in word:
            at = step[at][c]
        token[at] = i
    up = np.zeros(len(step), dtype=np.int32)  # nearest state over the links that is a token
    for s in np.argsort(length, kind="stable").tolist()[1:]:
        up[s] = link[s] if token[link[s]] >= 0 else up[link[s]]
    size = [[s] * len(d) for s, d in enumerate(step)]
    states = np.fromiter((s for own in size for s in own), dtype=np.int64)
    codes = np.fromiter((c for d in step for c in d), dtype=np.int64)
    return {
        "moves": states << 8 | codes, "to": np.fromiter((t for d in step for t in d.values()), dtype=np.int32),
        "link": np.array(link, dtype=np.int32), "length": np.array(length, dtype=np.int32), "token": token, "up": up,
        "made": np.array(made, dtype=np.int32), "spelling": {**{i: spell(t) for t, i in vocabulary.items() if all(c in letters for c in t)}, **{t["id"]: t["content"].encode() for t in file["added_tokens"]}},
        "merges": np.array([(a, b, rank) for (a, b), (rank, _) in merges.items()], dtype=np.int32).reshape(-1, 3),
        "added": {t["content"]: t["id"] for t in file["added_tokens"]}, "added_flags": any(t.get(k) for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip")),
    }


class Pieces(dict):
    """Packed ids by piece. A missing piece is encoded; short ones stay until ``KNOWN`` others, twice, were new."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.encode(piece.encode("utf-8"))
            ids = pack(f"<{len(found)}I", *found)
        if len(piece) <= SHORT:
            if len(self) >= KNOWN:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class PrefixBpe:
    """Encoder and decoder over the tables of one file."""

    def __init__(self, t: dict):
        self.step = dict(zip(t["moves"].tolist(), t["to"].tolist()))
        self.link, self.length, self.token, self.up = (t[k].tolist() for k in ("link", "length", "token", "up"))
        self.made = {i: (rank, left, right) for i, rank, left, right in t["made"].tolist()}
        self.merges = {(a, b): rank for a, b, rank in t["merges"].tolist()}
        self.spelling, self.added = t["spelling"], t["added"]
        self.word = {self.spelling[i]: i for i in self.made}
        if t["added_flags"]:
            raise ValueError("added tokens that take white space or whole words only are not known here")
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.packed = Pieces(self.encode_piece).__getitem__
        self.bytes_of = np.full(max(self.spelling) + 2, b"", dtype=object)
        for i, raw in self.spelling.items():
            self.bytes_of[i] = raw
        self.tested: dict[tuple[int, int], bool] = {}
        self.letters: dict[str, int] | None = None
        self.splitter = None

    def _apart(self, a: int, b: int) -> bool:
        before = 1 << 40
        while True:
            if self.merges.get((a, b), before) < before:
                return False
            rank_a, _, inner_a = self.made[a]
            rank_b, inner_b, _ = self.made[b]
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_b >= rank_a:  # of two equal merges the left one came first
                before, b = rank_b + 1, inner_b
            else:
                before, a = rank_a, inner_a

    def apart(self, a: int, b: int) -> bool:
        """Whether token ``a`` before token ``b`` is how the bytes of both are encoded."""
        known = self.tested.get((a, b))
        if known is None:
            if len(self.tested) >= PAIRS:
                self.tested.clear()
            known = self.tested[a, b] = self._apart(a, b)
        return known

    def encode_piece(self, raw: bytes) -> list[int]:
        whole = self.word.get(raw)
        if whole is not None:
            return [whole]
        move, link, length, token, up, tested = self.step.get, self.link, self.length, self.token, self.up, self.tested.get
        last, at, matched = [-1], 0, 0
        for end, c in enumerate(raw, 1):
            to = move(at << 8 | c)
            while to is None:
                at = link[at]
                matched = length[at]
                to = move(at << 8 | c)
            at, matched = to, matched + 1
            s = at if token[at] >= 0 and length[at] <= matched else up[at]
            while True:
                rest, t = end - length[s], token[s]
                if not rest:
                    break
                pair = (last[rest], t)
                fits = tested(pair)
                if self.apart(*pair) if fits is None else fits:
                    break
                s = up[s]
            last.append(t)
        out, end = [], len(raw)
        while end:
            out.append(last[end])
            end -= len(self.spelling[last[end]])
        out.reverse()
        return out

    def pieces(self, text: str) -> list[str]:
        if not BEYOND.search(text):
            return LATIN.findall(text)
        if self.splitter is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.splitter, self.letters = ByteLevel(add_prefix_space=False, use_regex=True), byte_letters()
        return [bytes(map(self.letters.__getitem__, piece)).decode("utf-8") for piece, _ in self.splitter.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        for m in self.special.finditer(text or "") if self.special else ():
            out += [*map(self.packed, self.pieces(text[at : m.start()])), pack("<I", self.added[m[0]])]
            at = m.end()
        return b"".join([*out, *map(self.packed, self.pieces((text or "")[at:]))])

    def decode(self, ids: np.ndarray) -> str:
        known = np.minimum(ids.astype(np.uint32), len(self.bytes_of) - 1)  # the last place is empty
        return b"".join(self.bytes_of[known].tolist()).decode("utf-8", "replace")


def _added(df: DataFrame, path: str, work: Callable, ddl: str, names: list[str], keep: list[str] | None) -> DataFrame:
    shared, key = df.sparkSession.sparkContext.broadcast(tables(path)), uuid.uuid4().hex

    def make():
        cache = process_cache("prefix_bpe")
        if key not in cache:
            cache.clear()
            cache[key] = PrefixBpe(shared.value)
        bpe = cache[key]
        return lambda batch: work(bpe, batch)

    return with_batches(df, make, ddl, [c for c in (df.columns if keep is None else keep) if c not in names])


def encode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids array<int>`` of the whole text."""

    def work(bpe: PrefixBpe, batch: pa.RecordBatch) -> list[pa.Array]:
        found = [np.frombuffer(bpe.encode(t.as_py()), dtype="<u4").astype(np.int32) for t in batch.column(batch.schema.get_field_index("text"))]
        return [pa.array(found, pa.list_(pa.int32()))]

    return _added(docs, path, work, "ids array<int>", ["ids"], keep)


def decode(rows: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``rows`` with ``decoded``, the text of the list ``ids``."""

    def work(bpe: PrefixBpe, batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([None if ids is None else bpe.decode(np.array([-1 if i is None else i for i in ids], dtype=np.int64)) for ids in column(batch, "ids")], pa.string())]

    return _added(rows, path, work, "decoded string", ["decoded"], keep)


def digests(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the number and digest of the ids of every text, and the digest of what they decode to, in one pass."""

    def work(bpe: PrefixBpe, batch: pa.RecordBatch) -> list[pa.Array]:
        sizes, encoded, decoded = [], [], []
        for text in batch.column(batch.schema.get_field_index("text")):
            ids = bpe.encode(text.as_py())
            sizes.append(len(ids) // 4)
            encoded.append(hashlib.sha256(ids).hexdigest())
            decoded.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, dtype="<u4")).encode("utf-8")).hexdigest())
        return [pa.array(sizes, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return _added(docs, path, work, "n_tokens long, ids_sha256 string, decoded_sha256 string", names, keep)
