import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from panelwright.llm import queries, winnowing

UNIT = re.compile("[^\x20\x09-\x0D]{1,8}")


def brute_choices(hashes, w):
    """Positions that winnowing chooses from a list of hashes, window by window."""
    if len(hashes) <= w:
        starts, w = [0], len(hashes)
    else:
        starts = range(len(hashes) - w + 1)
    out = []
    for s in starts if hashes else []:
        low = min(hashes[s : s + w])
        at = max(i for i in range(s, s + w) if hashes[i] == low)
        if at not in out:
            out.append(at)
    return out


def test_choices(spark, documents):
    """Positions against a plain walk; the hashes themselves come from the engine, one run at a time."""
    texts = ["a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3, "x " * 60, "short one", "", None, "ü" * 100, "one two three four", " \n\t"]
    docs = documents(texts).select("doc_id", "text")
    rows = {r.doc_id: r.c for r in winnowing.with_choices(docs, "text", "c", ["doc_id"]).collect()}
    for k, text in enumerate(texts):
        units = UNIT.findall(text or "")
        runs = [units[i : i + winnowing.K] for i in range(len(units) - winnowing.K + 1)] or ([units] if units else [])
        if not runs:
            assert rows[k] == []
            continue
        if len(units) >= winnowing.K:
            frame = spark.createDataFrame([(i, *r) for i, r in enumerate(runs)], ["i", *"abcd"]).select("i", F.xxhash64(*"abcd").alias("h"))
        else:
            frame = spark.createDataFrame([(0, units)], "i int, u array<string>").select("i", F.xxhash64("u").alias("h"))
        hashes = [(r.h & (2**64 - 1)) >> 28 for r in frame.orderBy("i").collect()]
        at = brute_choices(hashes, winnowing.W)
        top = (1 << winnowing.POSITION_BITS) - 1
        assert [(x >> winnowing.POSITION_BITS, top - (x & top)) for x in rows[k]] == [(hashes[i], i) for i in at]


def test_shared_passage_is_found(documents):
    passage = " ".join(f"p{k}" for k in range(winnowing.K + winnowing.W - 1))
    texts = [" ".join(f"a{k}" for k in range(50)) + " " + passage, "b " + passage + " " + " ".join(f"c{k}" for k in range(77))]
    sets = winnowing.with_choices(documents(texts), "text", "c", ["doc_id"]).select(winnowing.hash_set("c").alias("h")).collect()
    assert set(sets[0].h) & set(sets[1].h)


def test_whole_table(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.QUERIES["op10_winnowing_fingerprints"](spark, small).collect()}
    order = sorted(texts, reverse=True)
    assert len(rows) == len(order)
    sets = {i: set(x.split("@")[0] for x in r.fingerprint.split(",")) for i, r in rows.items()}
    for k, i in enumerate(order):
        j = order[(k + 1) % len(order)]
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[j][:half]
        assert rows[i].n_chars == len(texts[i]) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].near_next == pytest.approx(len(sets[i] & sets[j]) / len(sets[i] | sets[j]))
        other = set(x.split("@")[0] for x in rows[i].edited_fingerprint.split(","))
        assert rows[i].near_edited == pytest.approx(len(sets[i] & other) / len(sets[i] | other))


@pytest.mark.parametrize("texts, ids", [([], []), (["alone here"], [4]), (["a", "b", None, "d", ""], [None, 3, 3, 9, None])])
def test_edges(documents, texts, ids):
    rows = winnowing.compare_with_edits(documents(texts, ids=ids, extra=True)).collect()
    order = sorted([(i is None, -(i or 0), t or "") for i, t in zip(ids, texts)])
    want = []
    for k, (_, _, t) in enumerate(order):
        n = order[(k + 1) % len(order)][2]
        want.append(hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest())
    assert sorted(r.edited_sha256 for r in rows) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_sliding_units(spark):
    """Words of up to eight characters whole, of longer ones every eight characters in a row."""
    texts = ["a bb\tccccdddd eeeeffffg", "x" * 11, "", "1234567 123456789012 z", "é中" * 7]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.regexp_extract_all("t", F.lit(winnowing.SLIDING), 1).alias("u"))
    got = {r.i: r.u for r in frame.collect()}
    for i, text in enumerate(texts):
        assert got[i] == [run[k : k + 8] for run in text.split() for k in range(max(1, len(run) - 7))]


@pytest.mark.parametrize("alphabet", ["".join(map(chr, range(0x4E00, 0x5200))), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_one_inserted_character(documents, alphabet):
    """In a long text without spaces an insertion leaves the fingerprint of the rest, as the query makes it."""
    rng = random.Random(5)
    long = "".join(rng.choice(alphabet) for _ in range(3000))
    moved = long[:100] + "!" + long[100:]
    rows = {r.doc_id: r for r in winnowing.compare_with_edits(documents([moved, long])).collect()}
    assert rows[0].near_next > 0.95 and rows[1].near_next > 0.95
