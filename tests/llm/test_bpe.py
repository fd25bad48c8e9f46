import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import bpe, queries

FILE = queries.tokenizer_files()[0]
TEXTS = [
    None, "", " ", "a", "one two three " * 3000, "日本語 текст 😀 naïve", "x<|endoftext|>y<|endoftext|>", "<|endoftext|>", "\n\n  \t a" * 50, "a", " " * 5000,
    "'s 've don't 'S", "a" * 3000, "abab" * 2000, "ẹ́ ​  \u0085x", "\x00\x1c\x1f\x7f 0²³ ١٢٣ Ⅷ", "=-" * 4000 + "end"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(FILE)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def own():
    return bpe.PrefixBpe(bpe.tables(FILE))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_whole_table_equals_the_library(spark, small, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op12_byte_bpe_by_prefixes"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ids_of(library, texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark, documents, library):
    docs = documents(TEXTS, ids=[1, 1, None, *range(3, len(TEXTS))], extra=True).withColumn("ids", F.lit("clash"))
    rows = bpe.encode(docs, FILE)
    assert rows.columns == [c for c in docs.columns if c != "ids"] + ["ids"]
    for r in bpe.decode(rows, FILE).collect():
        assert r.ids == ids_of(library, r.text) and r.decoded == (r.text or "")
    assert bpe.digests(documents([]), FILE, ["doc_id"]).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([50256, 60000, None, 64],), ([447],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, FILE).collect()] == [None, "", "<|endoftext|>a", library.decode([447])]


def test_random_texts_equal_the_library(own, library):
    draw = random.Random(5)
    letters = [chr(c) for c in range(0x250)] + list("日本😀́ 　٠​")
    for k in range(4000):
        text = "".join(draw.choice(letters if k % 3 else "aabbcc  et\n'sthe1") for _ in range(draw.randint(0, 60)))
        ids = ids_of(library, text)
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == ids
        assert own.decode(np.array(ids, dtype=np.int64)) == library.decode(ids, skip_special_tokens=False) == text


def test_every_prefix_has_the_last_token_of_merging(tmp_path):
    """A tiny vocabulary with overlapping merges and a token that merging never makes, against merging step by step."""
    letters = {b: c for c, b in bpe.byte_letters().items()}
    vocab = {letters[b]: b for b in range(256)}
    merges = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "a"), ("aa", "ba"), ("aa", "aa"), ("b", "b"), ("bb", "ab"), ("ab", "ab"), ("a", "bb")]
    for left, right in merges:
        vocab.setdefault(left + right, len(vocab))
    file = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "added_tokens": [],
            "model": {"type": "BPE", "vocab": vocab, "merges": [" ".join(m) for m in merges]}}
    path = tmp_path / "tiny.json"
    path.write_text(json.dumps(file))
    own = bpe.PrefixBpe(bpe.tables(str(path)))
    assert vocab["abb"] not in own.made  # "a" and "b" merge before "a" and "bb" can
    table = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(merges)}
    draw = random.Random(7)
    for _ in range(3000):
        raw = bytes(draw.choice(b"aaab" if draw.random() < 0.5 else b"abc") for _ in range(draw.randint(1, 40)))
        assert own.encode_piece(raw) == bpe.merged(raw, list(range(256)), table)[0]


def test_the_automaton_knows_every_part():
    words = [b"abcbc", b"bcb", b"cab", b"abab"]
    step, link, length = bpe.suffix_automaton(words)
    parts = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}

    def state(part):
        at = 0
        for c in part:
            at = step[at].get(c)
            if at is None:
                return None
        return at

    texts = {bytes(t) for n in range(1, 5) for t in __import__("itertools").product(b"abc", repeat=n)}
    assert {t for t in texts if state(t) is not None} == {p for p in parts if len(p) < 5}
    ends = lambda p: {(k, i + len(p)) for k, w in enumerate(words) for i in range(len(w)) if w.startswith(p, i)}
    for p in parts:
        s = state(p)
        assert length[link[s]] < len(p) <= length[s]
        assert all((state(q) == s) == (ends(q) == ends(p)) for q in parts)


def test_other_files_are_refused(tmp_path):
    with open(FILE, encoding="utf-8") as lines:
        file = json.load(lines)
    file["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file))
    with pytest.raises(ValueError):
        bpe.tables(str(path))
