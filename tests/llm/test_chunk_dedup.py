import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from panelwright.llm import chunk_dedup, queries


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 10))) for _ in range(n))


def test_gear_is_the_rolling_recurrence():
    data = np.frombuffer(random.Random(1).randbytes(500), dtype=np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunk_dedup.gear(data).tolist() == want


@pytest.mark.parametrize("n", [0, 1, 19, 20, 5000])
def test_chunks_are_whole_and_resist_shifts(n):
    rng = random.Random(n)
    text = words(rng, n) if n > 100 else "é" * n
    data = text.encode()
    ends = chunk_dedup.borders(data)
    pieces = [data[a:b] for a, b in zip([0, *ends], ends)]
    assert b"".join(pieces) == data and all(p.decode() and len(p) <= chunk_dedup.LARGEST for p in pieces)
    if n > 100:
        moved = ("new start " + text).encode()
        other = chunk_dedup.borders(moved)
        again = {moved[a:b] for a, b in zip([0, *other], other)}
        assert sum(p not in again for p in pieces) <= 3


def brute(rows, least_words):
    """Spans by dictionaries; rows: (doc_id, text) with different ids."""
    places = defaultdict(list)
    chunks = {}
    for doc, text in rows:
        data = (text or "").encode()
        ends, at = chunk_dedup.borders(data) if data else [], 0
        chunks[doc] = []
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            size = len(data[a:b].decode())
            chunks[doc].append((at, at + size, len(data[a:b].split()), data[a:b]))
            places[data[a:b]].append((doc, k))
            at += size
    out = {}
    for doc, own in chunks.items():
        found = []
        for later in (False, True):
            runs, run = [], []
            for k, c in enumerate(own):
                p = places[c[3]]
                if len(p) > 1 and (not later or min(p) != (doc, k)):
                    run.append(c)
                elif run:
                    runs.append(run)
                    run = []
            runs += [run] if run else []
            found.append([(r[0][0], r[-1][1]) for r in runs if sum(c[2] for c in r) >= least_words])
        out[doc] = found
    return out


def spans(text):
    return [tuple(map(int, s.split(":"))) for s in text.split(",") if s]


LEAST = 50 / 3


def test_whole_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want, texts = brute(docs, LEAST), dict(docs)
    rows = queries.QUERIES["op3_substring_dedup"](spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert [spans(r.repeats), spans(r.removed)] == want[r.doc_id]
        clean, at = "", 0
        for a, b in spans(r.removed):
            clean, at = clean + texts[r.doc_id][at:a], b
        clean += texts[r.doc_id][at:]
        assert r.clean_sha256 == hashlib.sha256(clean.encode()).hexdigest() and r.clean_chars == len(clean) and r.n_chars == len(texts[r.doc_id])


def test_passages_of_more_than_fifty_words_are_caught(documents):
    rng = random.Random(7)
    caught, passage = 0, [words(rng, 55) for _ in range(30)]
    texts = [words(rng, rng.randrange(20, 200)) + " " + p + " " + words(rng, 80) for p in passage for _ in range(2)] + [words(rng, 300) for _ in range(30)]
    rows = {r.doc_id: r for r in chunk_dedup.deduplicated(documents(texts, extra=True)).collect()}
    for k in range(60):
        caught += bool(rows[k].repeats)
        assert bool(rows[k].removed) == (bool(rows[k].repeats) and k % 2 == 1)
    assert caught >= 56 and not any(rows[k].repeats for k in range(60, 90))
    assert rows[0].clean_text == texts[0] and len(rows[1].clean_text) < len(texts[1])


def test_edges(documents):
    long = " ".join(f"word{k}" for k in range(200))
    rows = chunk_dedup.deduplicated(documents([None, "", long, long, long, long, "x " * 20_000], ids=[1, 2, None, 4, 5, 5, 6], extra=True)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[1][0].clean_text is None and by[2][0].clean_text == "" and by[None][0].clean_text == long and by[4][0].clean_text == long
    assert [r.clean_text for r in by[5]] == ["", ""] and len(by[6][0].clean_text) < 2000
    assert chunk_dedup.deduplicated(documents([])).count() == 0
