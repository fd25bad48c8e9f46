import hashlib
import random
import re

import numpy as np
import pytest

from panelwright.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")


def brute(text):
    """The patterns as they are written."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        total = 0
        for k, c in enumerate(reversed(s)):
            v = int(c) * (1 + k % 2)
            total += v - 9 * (v > 9)
        return total % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if max(map(int, m[0].split("."))) <= 255]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


@pytest.mark.parametrize("alphabet", ["aB1.@-+ é%", "12.. 5", "0123456789 -", "+1() .-23456789"])
def test_base_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("4539 1488 0343 6467")[0][0] == "card"


def test_whole_table(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_personal_data"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert set(line.split(",")) <= set(r.spans.split(","))
    assert sum(r.n_added for r in rows) < 20


TEXTS = [f"Call +1 ({k}32) 555-{7700 + k} today or mail a.{k}@mail3.example.com, host 10.0.{k}.7, card 4041894974608795." for k in range(1, 9)] * 5


def test_repeats_take_the_label(documents):
    field = pii.train(documents(TEXTS))
    text = "Ring +1 (132) 555-7713 by day. At night (132) 555-7713, version 4.0. and 12 pages."
    base = pii.base_spans(text)
    assert [text[a:b] for _, a, b in base] == ["+1 (132) 555-7713"]
    assert [(k, text[a:b]) for k, a, b in field.spans(text, base, 0.95)] == [("phone", "(132) 555-7713")]
    clean = "In 1999 the 2nd edition had 345 pages, v. 1.2.3, price +1 and (3)."
    assert pii.base_spans(clean) == [] and field.spans(clean, [], 0.95) == []


def test_belief_propagation_is_exact_on_a_chain(documents):
    """Without skip edges the messages give the marginals of the enumerated chain."""
    import itertools

    import numpy as np

    field = pii.train(documents(TEXTS))
    t = pii.Tokens("+1 (132) 555", [])
    assert len(t.spans) == 3 and t.chain == [(0, 1), (1, 2)] and not t.skip
    p = np.zeros((3, pii.L))
    for y in itertools.product(range(pii.L), repeat=3):
        s = sum(field.unary.get(repr(f), field.unseen)[v] for f, v in zip(t.patterns, y))
        s += field.chain[pii.PLAIN, y[0]] + field.chain[y[2], pii.PLAIN] + field.chain[y[0], y[1]] + field.chain[y[1], y[2]]
        for k, v in enumerate(y):
            p[k, v] += np.exp(s)
    assert np.allclose(field.posterior(t, rounds=60), p / p.sum(axis=1, keepdims=True), atol=2e-3)


def test_edges_and_masking(documents):
    docs = documents([None, "", "a@b.co and a@b.co", "1 " * 30_000, "x" * 100_000 + "@", TEXTS[0]], ids=[None, 1, 1, 2, 3, 4], extra=True)
    field = pii.train(docs)
    rows = pii.find(docs, field, ["doc_id"]).collect()
    assert [r.n_email for r in rows] == [0, 0, 2, 0, 0, 1]
    masked = pii.redact(docs, field)
    assert masked.columns == docs.columns
    out = masked.collect()
    assert out[0].text is None and out[2].text == "[EMAIL] and [EMAIL]" and out[2].spans == "x"
    assert out[5].text == "Call [PHONE] today or mail [EMAIL], host [IP], card [CARD]."
    assert pii.find(documents([]), pii.train(documents([]))).count() == 0


def test_digits_of_other_alphabets(documents):
    """Characters that are digits for Unicode only are no numbers here."""
    docs = documents(["see 1²3.4.5.6 here", "①.2.3.4", "٣.٤.٥.٦ and 1.2.3.4", "card ４１１１ 1111 1111 1111"])
    rows = pii.find(docs, pii.train(docs), ["doc_id"]).orderBy("doc_id").collect()
    assert [r.n_ip for r in rows] == [1 if "3.4.5.6" in "see 1²3.4.5.6 here" else 0, 0, 1, 0]
    assert pii.redact(docs, pii.train(docs)).count() == 4


def test_every_repeat_is_reached(documents):
    """One found number and a hundred bare repeats far behind it, which take its label all the same."""
    field = pii.train(documents(TEXTS))
    bare = "(132) 555-7713"
    text = "Ring +1 (132) 555-7713 by day. " + "".join(f"word {k} then {bare} again. " for k in range(100))
    base = pii.base_spans(text)
    assert [text[a:b] for _, a, b in base] == ["+1 (132) 555-7713"]
    assert [(k, text[a:b]) for k, a, b in field.spans(text, base, 0.95)] == [("phone", bare)] * 100
    t = pii.Tokens(text, base)
    assert max(map(len, t.clusters)) == 101
    assert np.allclose(field.posterior(t), field.posterior(t, rounds=1999), atol=1e-6)


def test_parts_of_a_found_mail(documents):
    """A repeat of a found e-mail without its mark is labelled; other words of the text are not."""
    field = pii.train(documents([f"mail a.{k}x@mail3.example.com or again a.{k}x@mail3.example.com today" for k in range(40)]))
    text = "Mail john.smith@example.com now. He is john.smith at example.com there; see example.com or contact john of smith."
    base = pii.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in sorted(field.spans(text, base, 0.95), key=lambda s: s[1])] == [("email", "john.smith"), ("email", "example.com")]
    assert pii.repeated_parts("write to info or info at x.org".split(), {"info": {"xorg"}}) == {4: ("m", "info"), 6: ("m", "info")}


def test_propagation_with_a_cluster_is_exact_without_loops(documents):
    """A cluster without evidence: the messages give the marginals of the enumerated star."""
    field = pii.train(documents(TEXTS))
    t = pii.Tokens("5557713 and 555-7713 or 555.7713", [])
    assert len(t.spans) == 3 and not t.chain and t.clusters == [[0, 1, 2]]
    own = np.array([field.unary.get(repr(f), field.unseen) for f in t.patterns]) + field.chain[pii.PLAIN, : pii.L] + field.chain[: pii.L, pii.PLAIN]
    p = np.zeros((3, pii.L))
    for z in range(pii.L):
        each = np.exp(own + field.skip[z])
        for k in range(3):
            p[k] += each[k] * np.prod(np.delete(each.sum(1), k))
    assert np.allclose(field.posterior(t), p / p.sum(axis=1, keepdims=True), atol=1e-3)
