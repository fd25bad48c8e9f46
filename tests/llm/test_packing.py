import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelwright.llm import packing, queries

FILES = queries.tokenizer_files()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILES[0])


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def check(rows, expected, size):
    """Every id in one piece, sequences gapless and never above the size. ``expected``: arrays by document."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == set(expected)
    for doc, own in pieces.items():
        ids, at = expected[doc], 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_whole_table(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    expected = {d.doc_id: ids_of(tokenizer, d.text) for d in docs}
    rows = queries.QUERIES["op1_pack_sum_of_squares"](spark, small).collect()
    assert check(rows, expected, 2048) == 0


def test_edges(documents, tokenizer):
    texts = [None, "", " ", "a", "one two three " * 3000, "日本語 текст 😀 naïve", "x<|endoftext|>y", "\n\n  \t a" * 50, "a", " " * 5000, "'s 've don't"]
    rows = packing.pack(documents(texts, extra=True).repartition(1), *FILES).collect()
    assert check(rows, {i: ids_of(tokenizer, t) for i, t in enumerate(texts)}, 2048) == 0
    assert packing.pack(documents([]), *FILES).count() == 0


def test_null_and_repeated_ids(documents):
    rows = packing.pack(documents(["a b c", "d e", "d e"], ids=[None, 5, 5]), *FILES).collect()
    assert {r.doc_tokens for r in rows if r.doc_id is None} == {4} and {r.doc_tokens for r in rows if r.doc_id == 5} == {3}
    assert sum(r.length for r in rows if r.doc_id is None) == 4 and sum(r.length for r in rows if r.doc_id == 5) == 6


def naive_choice(levels, n, size):
    """The sum of squares written out for every level."""
    best = None
    for h in [0] + [h for h in range(1, size) if levels[h] and h + n <= size]:
        after = list(levels)
        if h:
            after[h] -= 1
        if h + n < size:
            after[h + n] += 1
        key = (sum(x * x for x in after[1:size]), h == 0, -h)
        best = min(best or (key, h), (key, h))
    return best[1]


def test_choice_minimises_the_sum_of_squares():
    rng, size = np.random.RandomState(3), 16
    packer, levels = packing.Packer(size, 0, 1 << 40), [0] * (size + 1)
    for k in range(600):
        n = int(rng.randint(1, size))
        want = naive_choice(levels, n, size)
        assert packer.choose(n) == want
        if want:
            levels[want] -= 1
        if want + n < size:
            levels[want + n] += 1
        packer.place((k, 0, np.ones(n, dtype="<u4"), n))
        assert packer.level[:size].tolist() == levels[:size]


def test_small_memory_bound_loses_nothing():
    packer = packing.Packer(32, 0, 64)
    rng, expected = np.random.RandomState(5), {}
    for k in range(500):
        expected[k] = rng.randint(0, 50000, rng.randint(1, 90)).astype("<u4")
        packer.add(k, expected[k])
        assert packer.held < 64 + 32
    packer.flush()
    rows = [type("R", (), dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), r))) for r in packer.done]
    assert check(rows, expected, 32) == 0
