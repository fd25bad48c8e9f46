import hashlib
import itertools
import random
import re
import zlib

import pytest

from panelwright.llm import queries, repair

SHAPE = re.compile("(s?(ua)+)?")
BLANK = re.compile("[^\x20\x09-\x0d]")


def brute(rows, inserts=2):
    """Cheapest edits of a few (role, text) rows, by trying them all; at most ``inserts`` insertions in a gap."""
    bad, seen = [], set()
    for role, text in rows:
        letters = BLANK.findall(text)
        bad.append("b" if not letters else "d" if (role, text) in seen else "" if letters[-1] in ".!?" else "t")
        seen.add((role, text))
    choices = []
    for k in range(len(rows) + 1):
        choices.append([p for n in range(inserts + 1) for p in itertools.product([("I", "user"), ("I", "assistant")], repeat=n)])
        if k < len(rows):
            choices.append([("D", None)] + ([] if bad[k] in "bd" and bad[k] else [("K", rows[k][0]), ("R", "user"), ("R", "assistant")]))
    best = None
    for way in itertools.product(*choices):
        edits, cost, out, at = [], 0, [], 0
        for k, step in enumerate(way):
            for letter, role in [step] if k % 2 else step:
                edits.append(letter)
                cost += {"K": 0, "R": 1, "D": 2, "I": 5}[letter]
                if letter != "D":
                    out.append((role, rows[at][1] if k % 2 else ""))
                    cost += 5 if k % 2 and bad[at] == "t" else 0
            at += k % 2
        if SHAPE.fullmatch("".join(role[:1] or " " for role, _ in out)) and (best is None or (cost, "".join(edits)) < best[:2]):
            best = cost, "".join(edits), out
    return best


def facts(rows):
    return [(role[:1], bad) for (role, _), bad in zip(rows, repair.faults(rows))]


def stepwise(rows):
    """The same for long conversations: best (cost, audit) of every state, row by row."""
    bad = repair.faults(rows)
    labels = {0: (0, "")}

    def inserted(labels):
        labels = dict(labels)
        for _ in range(4):
            for q, (c, a) in list(labels.items()):
                to = {0: 2, 1: 2, 2: 3, 3: 2}[q]
                labels[to] = min(labels.get(to, (10**9, "")), (c + 5, a + "I"))
        return labels

    for (role, _), fault in zip(rows, bad):
        fresh = {}
        for q, (c, a) in inserted(labels).items():
            ways = [(q, 2, "D")]
            if fault not in ("b", "d"):
                more = 5 * (fault == "t")
                ways.append(({0: 2, 1: 2, 2: 3, 3: 2}[q], 1 + more, "R"))
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], q))
                ways += [(to, more, "K")] if to else []
            for to, cost, letter in ways:
                fresh[to] = min(fresh.get(to, (10**9, "")), (c + cost, a + letter))
        labels = fresh
    labels = inserted(labels)
    return min(labels[q] for q in (0, 3) if q in labels)


def expected(rows):
    """Result of a table of (conv_id, turn, role, text) by plain Python."""
    named = lambda v: " " if v is None else str(v)
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            kind = zlib.crc32(f"{named(conv)}:{named(turn)}".encode()) % 20
            role, text = named(role), named(text)
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        turns = [(role, text) for _, role, text in own]
        bad = repair.faults(turns)
        known = [t for t, _, _ in own if t is not None]
        cost, audit = stepwise(turns)
        pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(turns, turns[1:])]
        text = "\n".join(f"{r}:{t}" for r, t in repair.applied(turns, audit))
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, bad.count("b"), bad.count("d"), bad.count("t"),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def check(found, rows):
    got = {r.conv_id: tuple(r[c] for c in repair.RESULTS) for r in found}
    want = expected(rows)
    assert len(found) == len(want) == len(got)
    for conv in want:
        assert got[conv] == want[conv], conv


def test_edits_equal_all_edits():
    draw = random.Random(2)
    texts = ["A.", "B!", "", " \t", "cut", "A."]
    for _ in range(120):
        rows = [(draw.choice(["system", "user", "assistant", "user", "assistant", "tool", " "]), draw.choice(texts)) for _ in range(draw.randint(0, 3))]
        cost, audit, out = brute(rows)
        assert repair.cheapest(facts(rows)) == (cost, audit)
        assert repair.applied(rows, audit) == out


def test_searches_equal_stepwise_labels():
    draw = random.Random(4)
    for k in range(1500):
        roles = ["system", "user", "assistant", "tool"] if k % 2 else ["user", "assistant"]
        rows = [(draw.choice(roles), draw.choice(["x%d." % draw.randint(0, 30), "cut%d" % draw.randint(0, 9), ""])) for _ in range(draw.randint(0, 14))]
        assert repair.cheapest(facts(rows)) == stepwise(rows)


def test_blocks_join_to_the_whole():
    draw = random.Random(6)
    for _ in range(400):
        rows = [(draw.choice(["system", "user", "assistant", "tool"]), draw.choice(["x%d." % draw.randint(0, 99), "cut%d" % draw.randint(0, 9), ""])) for _ in range(draw.randint(0, 20))]
        own, parts = facts(rows), []
        while own or not parts:
            n = draw.randint(0, 4)
            parts.append(own[:n])
            own = own[n:]
        paths = [[{"start": p, "end": q, "cost": f[0], "audit": f[1]} for p in range(4) for q in range(4) if (f := repair.cheapest(part, p, (q,)))] for part in parts]
        cost, ways = repair.joined_paths(paths)
        assert (cost, "".join(a for _, a in ways)) == stepwise(rows) and len(ways) == len(parts)
        done, at = [], 0
        for part, (state, audit) in zip(parts, ways):
            done += repair.applied(rows[at : at + len(part)], audit, state)
            at += len(part)
        assert done == repair.applied(rows, stepwise(rows)[1])


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(queries.QUERIES["op13_conversation_repair"](spark, small).collect(), rows)


DDL = "conv_id long, turn long, role string, text string, part string, cost int, turns date"


@pytest.fixture
def odd():
    """Nulls, empty and long texts, one long conversation, a repeated row, a conversation that loses every row."""
    draw = random.Random(8)
    gone = next(i for i in range(10**6, 10**7) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (None, None, None, None), (1, None, "system", "S."), (1, None, "user", ""), (gone, 0, "user", "A."),
            (2, 5, "user", "x" * 300_000 + "."), (2, 9, "assistant", "日本語。"), (3, 1, "", "a."), (3, 1, "user", "a."), (3, 1, "user", "a."), (4, -3, "tool", " . ")]
    return rows + [(7, t, draw.choice(["user", "assistant", "system"]), draw.choice([f"text {draw.randint(0, 400)}.", "cut", " ", "ok?"])) for t in range(1500)]


@pytest.mark.parametrize("size", [4, 256])
def test_edges_and_long_conversations(spark, odd, size, monkeypatch):
    monkeypatch.setattr(repair, "ROWS", size)
    table = spark.createDataFrame([(*r, "x", 1, None) for r in odd], DDL)
    # rows of one turn are taken by role, then by hash of the text: the same order for the plain version
    check(repair.repair(repair.damaged(table)).collect(), sorted(odd, key=lambda r: r[2] or " "))
    assert repair.repair(repair.damaged(table.limit(0))).count() == 0


def test_repaired_turns(spark, odd):
    table = spark.createDataFrame([(*r, "x", 1, None) for r in odd], DDL)
    turns = repair.repaired_turns(repair.damaged(table)).collect()
    digests = {r.conv_id: r.repaired_sha256 for r in repair.repair(repair.damaged(table)).collect()}
    for conv, digest in digests.items():
        own = sorted((r for r in turns if r.conv_id == conv), key=lambda r: (r.part, r.block, r.place))
        assert SHAPE.fullmatch("".join(r.role[:1] for r in own))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == digest
