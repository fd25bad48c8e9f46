"""Repair of conversations: the cheapest edits that give turns of user and assistant after an optional system turn.

A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation), truncated (the
last character that is no white space ends no sentence). Edits in order of the rows: Keep (0), Rerole to user
or assistant (1), Delete (2; blank and duplicate rows have to go), Insert an empty turn of user or
assistant (5); a truncated row that isn't deleted adds 5. The initials of the roles must be ``(s?(ua)+)?``;
of equal costs the audit (the edits' initials) that is least in ASCII order is taken.

The edits are paths in a lattice: a place between rows and the last initial so far. A forward and a
reverse Dijkstra search meet in it; both go on while a path of the best cost can still cross, and the least
concatenation over all crossings is the audit. Of two equally cheap ways into a node neither audit begins
with the other, so the least audit of a node stays least whatever follows.

Conversations of any length: rows are sorted by conversation and turn over all tasks (by range, so that a long
conversation spreads over several), and a task reads its share as a stream, in blocks of at most ``ROWS``
rows and ``BYTES`` of text. A conversation that fits one block is repaired there. A block of any other one
is searched from each of the four initials to each; a step per conversation then joins the blocks' paths
(it holds sixteen audits of a block, no text), and the text is hashed as a sorted stream, one block at a
time. Rows of a conversation that agree in turn, role and text share a task.

Rows: nulls count as one space in role, text and the names that choose a damage; a null turn sorts
first and says nothing about gaps; a null ``conv_id`` is a conversation. Rows of one turn are taken by
role, then by a hash of the text, then by the text. A conversation without rows: zeros, an empty audit and the digest of nothing. An
empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

import hashlib
import heapq
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import giving_back
from panelwright.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS, BYTES = 256, 4 << 20
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, OPEN_END = 0, 1, 2, 5, 5
#: States are the last initial so far: none, s, u, a. What an initial leads to, and what a free turn leads to.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FREE = (2, 2, 3, 2)
BEFORE_FREE = tuple(tuple(p for p in range(4) if FREE[p] == q) for q in range(4))
NAME = {2: "user", 3: "assistant"}
FINAL = (0, 3)
LEGAL = frozenset(("su", "ua", "au"))


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """First fault of each (role, text) of a whole conversation: b, d, t or nothing."""
    seen, out = set(), []
    for row in rows:
        own = fault(row[1])
        out.append("d" if own != "b" and row in seen else own)
        seen.add(row)
    return out


def fault(text: str) -> str:
    """b for a blank text, t for one that ends no sentence."""
    body = text.rstrip(SPACE)
    return "b" if not body else "" if body[-1] in ".!?" else "t"


def forward(rows: list[tuple[str, str]], i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
    """Edits from a node: place, state, cost, initial. ``rows``: initial of the role and fault."""
    yield i, FREE[q], INSERT, "I"
    if i < len(rows):
        initial, bad = rows[i]
        yield i + 1, q, DELETE, "D"
        if bad not in ("b", "d"):
            more = OPEN_END if bad else 0
            yield i + 1, FREE[q], REROLE + more, "R"
            to = NEXT.get((q, initial))
            if to is not None:
                yield i + 1, to, KEEP + more, "K"


def reverse(rows: list[tuple[str, str]], i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
    """Edits into a node, by the node they come from."""
    for p in BEFORE_FREE[q]:
        yield i, p, INSERT, "I"
    if i:
        initial, bad = rows[i - 1]
        yield i - 1, q, DELETE, "D"
        if bad not in ("b", "d"):
            more = OPEN_END if bad else 0
            for p in BEFORE_FREE[q]:
                yield i - 1, p, REROLE + more, "R"
            for p in range(4):
                if NEXT.get((p, initial)) == q:
                    yield i - 1, p, KEEP + more, "K"


def cheapest(rows: list[tuple[str, str]], start: int = 0, ends: tuple[int, ...] = FINAL) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits from ``start`` before the rows to one of ``ends`` after them.

    Ways of no cost only lead on by a row, so a search that settles equal costs in the order of the rows
    has the least audit of a node when it settles it.
    """
    n = len(rows)
    labels: tuple[dict, dict] = ({(0, start): (0, "")}, {(n, q): (0, "") for q in ends})
    heaps = ([(0, 0, start)], [(0, -n, q) for q in ends])
    heapq.heapify(heaps[1])
    settled: tuple[set, set] = (set(), set())
    best = min((labels[0][x][0] for x in labels[1] if x in labels[0]), default=None)
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, i, q = heapq.heappop(heaps[side])
        i = abs(i)
        if (i, q) in settled[side]:
            continue
        settled[side].add((i, q))
        own, other = labels[side], labels[1 - side]
        audit = own[i, q][1]
        for j, p, more, letter in (reverse if side else forward)(rows, i, q):
            fresh = (cost + more, letter + audit if side else audit + letter)
            old = own.get((j, p))
            if old is None or fresh < old:
                own[j, p] = fresh
                if old is None or fresh[0] < old[0]:
                    heapq.heappush(heaps[side], (fresh[0], -j if side else j, p))
                if (j, p) in other and (best is None or fresh[0] + other[j, p][0] < best):
                    best = fresh[0] + other[j, p][0]
    if best is None:
        return None
    ahead, back = labels
    return best, min(a + back[x][1] for x, (c, a) in ahead.items() if x in back and c + back[x][0] == best)


def applied(rows: list[tuple[str, str]], audit: str, state: int = 0) -> list[tuple[str, str]]:
    """(role, text) after the edits."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            state = FREE[state]
            out.append((NAME[state], ""))
            continue
        role, text = rows[at]
        at += 1
        if edit == "K":
            state = NEXT[state, role[:1]]
            out.append((role, text))
        elif edit == "R":
            state = FREE[state]
            out.append((NAME[state], text))
    return out


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def spelled(rows: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in rows).encode("utf-8")


def damaged(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy, gone`` after the damage of the contract; dropped rows stay as ``gone`` without text."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", name("conv_id"), name("turn"))) % 20
    out = df.select("conv_id", F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), kind.alias("kind"))
    return out.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") <= 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"), (F.col("kind") == 0).alias("gone"))


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULTS = [c.split()[0] for c in RESULT.split(", ")]
TURNS = "array<struct<turn:long,role:string,text:string>>"


def _summary(turns: list, rows: list[tuple[str, str]]) -> dict:
    """Counts of a block; ``turns`` in order, ``rows`` as initial and fault."""
    known = [t for t in turns if t is not None]
    return {"first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": len(set(known)), **{
        name: sum(bad == letter for _, bad in rows) for name, letter in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))},
        "illegal": illegal([i for i, _ in rows]), "first_initial": rows[0][0] if rows else None, "last_initial": rows[-1][0] if rows else None}


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of the sorted rows: those of one block, inside a task's share, with their result; the others open.

    ``turns`` has the repaired turns of the first kind (with a null turn) and the rows as they are of the second.
    """
    ordered = ["conv_id", "turn", "role", F.xxhash64("text")]
    rows = rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered, "text", "copy")
    kind = rows.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, part int, block int, whole boolean, {RESULT}, turns {TURNS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, types = TaskContext.get().partitionId(), [], None
        held: list[tuple] = []
        key, block, size, begun, edge = None, 0, 0, False, True

        def close(last: bool, whole: bool) -> None:
            nonlocal held, size, block
            if whole and not block and not edge and not last:
                own = [(role, text) for _, role, text in held]
                facts = [(role[:1], bad) for (role, _), bad in zip(own, faults(own))]
                s = _summary([t for t, _, _ in held], facts)
                cost, audit = cheapest(facts)
                repaired = applied(own, audit)
                gaps = s["last_turn"] - s["first_turn"] + 1 - s["turns"] if s["turns"] else 0
                found = (gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost, audit, hashlib.sha256(spelled(repaired)).hexdigest())
                done.append((key, part, 0, True, *found, [(None, *r) for r in repaired]))
            else:
                done.append((key, part, block, False, *[None] * len(RESULTS), held))
            held, size, block = [], 0, block + 1

        def drain() -> Iterator[pa.RecordBatch]:
            if done:
                columns = list(zip(*done))
                fields = [pa.array(c, type=t) for c, t in zip(columns[:-1], types)]
                turns = pa.array([[dict(zip(("turn", "role", "text"), r)) for r in own] for own in columns[-1]], type=pa.list_(
                    pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))
                yield pa.RecordBatch.from_arrays([*fields, turns], names=["conv_id", "part", "block", "whole", *RESULTS, "turns"])
                done.clear()

        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "turn", "role", "text", "gone")}
            types = [columns["conv_id"].type, pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.string()]
            for conv, turn, role, text, gone in zip(*(c.to_pylist() for c in columns.values())):
                if not begun or conv != key:
                    if begun:
                        close(False, True)
                        edge = False
                    key, begun, block = conv, True, 0
                if not gone:
                    if held and (len(held) >= ROWS or size >= BYTES):
                        close(False, False)
                    held.append((turn, role, text))
                    size += len(text)
                if len(done) >= 1000:
                    yield from drain()
            yield from drain()
        if begun:
            close(True, True)
        yield from drain()

    return rows.select("conv_id", "turn", "role", "text", "gone").mapInArrow(giving_back(run), schema)


FACTS = ("first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
         "paths array<struct<start:int,end:int,cost:long,audit:string>>")


def _searched(open_blocks: DataFrame) -> DataFrame:
    """Counts of each open block and its cheapest edits from every state to every state."""
    at = ["conv_id", "part", "block"]
    rows = open_blocks.select(*at, F.posexplode_outer("turns").alias("place", "row"))
    body = F.regexp_extract("row.text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = rows.select(*at, "place", "row.turn", "row.role", F.sha2("row.text", 256).alias("digest"),
                       F.when(body == "", "b").when(body.isin(".", "!", "?"), "").otherwise("t").alias("own"))
    place = F.struct("part", "block", "place")
    first = rows.where("place is not null and own <> 'b'").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"))
    first = first.withColumnsRenamed({"conv_id": "__conv", "role": "__role", "digest": "__digest"})
    known = rows.join(first, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest")), "left")
    again = (F.col("own") != "b") & (F.col("first") < place)
    row = F.struct("place", "turn", F.substring("role", 1, 1).alias("initial"), F.when(again, "d").otherwise(F.col("own")).alias("fault"))
    packed = known.groupBy(*at).agg(F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), row))).alias("rows"))
    kind = open_blocks.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column(batch.schema.get_field_index("rows")).to_pylist():
                facts = [(r["initial"], r["fault"]) for r in rows]
                paths = [{"start": p, "end": q, "cost": found[0], "audit": found[1]} for p in range(4) for q in range(4) if (found := cheapest(facts, p, (q,))) is not None]
                out.append({**_summary([r["turn"] for r in rows], facts), "paths": paths})
            whole = pa.array(out, type=pa.struct([
                *[(c, pa.int64()) for c in ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")], ("first_initial", pa.string()), ("last_initial", pa.string()),
                ("paths", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]))
            keys = [batch.column(batch.schema.get_field_index(c)) for c in at]
            yield pa.RecordBatch.from_arrays([*keys, *whole.flatten()], names=[*at, *[f.name for f in whole.type]])

    return packed.mapInArrow(giving_back(run), f"conv_id {kind}, part int, block int, {FACTS}")


def joined_paths(found: list[list[dict]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of the cheapest way through all blocks, and the start and audit of its least one in each block.

    Costs come first, from the end; then all cheapest ways go on together. What they have in common is
    settled and let go, so that only the letters that still differ are compared.
    """
    cost: list[dict[int, int]] = [{q: 0 for q in FINAL}]
    for paths in reversed(found):
        after = cost[-1]
        ways = [(p["start"], p["cost"] + after[p["end"]]) for p in paths if p["end"] in after]
        cost.append({s: min(c for q, c in ways if q == s) for s in {q for q, _ in ways}})
    cost.reverse()
    settled: list[tuple[int, str]] = []
    alive: dict[int, list[tuple[int, str]]] = {0: []}
    for k, paths in enumerate(found):
        fresh: dict[int, list[tuple[int, str]]] = {}
        for p in paths:
            if p["start"] in alive and p["end"] in cost[k + 1] and p["cost"] + cost[k + 1][p["end"]] == cost[k][p["start"]]:
                way = [*alive[p["start"]], (p["start"], p["audit"])]
                old = fresh.get(p["end"])
                if old is None or "".join(a for _, a in way) < "".join(a for _, a in old):
                    fresh[p["end"]] = way
        alive = fresh
        ways = list(alive.values())
        while ways[0] and all(w and w[0] == ways[0][0] for w in ways):
            settled.append(ways[0][0])
            for w in ways:
                del w[0]
    return cost[0][0], settled + min(alive.values(), key=lambda w: "".join(a for _, a in w))


def _chained(searched: DataFrame) -> DataFrame:
    """Edits of each open block; the first block of a conversation has its counts and audit too."""
    kind = searched.schema["conv_id"].dataType.simpleString()
    counts = RESULTS[:-1]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
        cost, ways = joined_paths([r["paths"] for r in rows])
        filled = [r for r in rows if r["last_initial"] is not None]
        timed = [r for r in rows if r["turns"]]
        distinct = sum(r["turns"] for r in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
        gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - distinct if timed else 0
        wrong = sum(r["illegal"] for r in rows) + illegal_borders(filled)
        total = (gaps, *[sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")], wrong, cost, "".join(a for _, a in ways))
        own = {"part": pa.array([r["part"] for r in rows], pa.int32()), "block": pa.array([r["block"] for r in rows], pa.int32()),
               "state": pa.array([s for s, _ in ways], pa.int32()), "edits": pa.array([a for _, a in ways], pa.string())}
        own |= {c: pa.array([v] + [None] * (len(rows) - 1), pa.string() if c == "audit" else pa.int64()) for c, v in zip(counts, total)}
        return pa.table({"conv_id": table.column("conv_id"), **own})

    return searched.groupBy("conv_id").applyInArrow(run, f"conv_id {kind}, part int, block int, state int, edits string, {RESULT.rsplit(', ', 1)[0]}")


def illegal_borders(filled: list[dict]) -> int:
    return sum(a["last_initial"] + b["first_initial"] not in LEGAL for a, b in zip(filled, filled[1:]))


def _repaired_open(open_blocks: DataFrame, chained: DataFrame) -> DataFrame:
    """Repaired turns of each open block."""
    way = chained.select(F.col("conv_id").alias("__conv"), F.col("part").alias("__part"), F.col("block").alias("__block"), "state", "edits")
    rows = open_blocks.join(way, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("part") == F.col("__part")) & (F.col("block") == F.col("__block")))
    kind = open_blocks.schema["conv_id"].dataType.simpleString()
    at = ["conv_id", "part", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
            out = [[{"turn": None, "role": role, "text": text} for role, text in applied([(r["role"], r["text"]) for r in rows], edits, state)]
                   for rows, edits, state in zip(get("turns"), get("edits"), get("state"))]
            turns = pa.array(out, type=pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in at), turns], names=[*at, "turns"])

    return rows.select(*at, "turns", "state", "edits").mapInArrow(giving_back(run), f"conv_id {kind}, part int, block int, turns {TURNS}")


def _digests(repaired: DataFrame) -> DataFrame:
    """Digest of each conversation's text, over its sorted blocks as a stream."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, filled, begun, out, kind_ = None, None, False, False, [], None

        def drain() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], type=kind_), pa.array([d for _, d in out], pa.string())], names=["conv_id", "repaired_sha256"])
                out.clear()

        for batch in batches:
            ids, turns = (batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "turns"))
            kind_ = ids.type
            for conv, rows in zip(ids.to_pylist(), turns):
                if not begun or conv != key:
                    if begun:
                        out.append((key, state.hexdigest()))
                    key, state, filled, begun = conv, hashlib.sha256(), False, True
                rows = [(r["role"], r["text"]) for r in rows.as_py()]
                if rows:
                    state.update(b"\n" if filled else b"")
                    state.update(spelled(rows))
                    filled = True
            yield from drain()
        if begun:
            out.append((key, state.hexdigest()))
        yield from drain()

    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return ordered.select("conv_id", "turns").mapInArrow(giving_back(run), f"conv_id {kind}, repaired_sha256 string")


def _solved(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, the edits of the open ones, and the repaired turns of these; each written once."""
    found = cut_lineage(blocks(rows), "conversation-blocks")
    open_blocks = found.where("not whole").select("conv_id", "part", "block", "turns")
    chained = cut_lineage(_chained(_searched(open_blocks)), "conversation-edits")
    return found, chained, _repaired_open(open_blocks, chained)


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id`` with counts, cost, audit and digest of every conversation. ``rows``: as :func:`damaged` gives them."""
    found, chained, repaired = _solved(rows)
    digests = _digests(repaired).withColumnRenamed("conv_id", "__conv")
    totals = chained.where("audit is not null").join(digests, F.col("conv_id").eqNullSafe(F.col("__conv")))
    return found.where("whole").select("conv_id", *RESULTS).unionByName(totals.select("conv_id", *RESULTS))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, part, block, place, role, text``: the repaired conversations, in order of part, block and place."""
    found, _, repaired = _solved(rows)
    at = ["conv_id", "part", "block"]
    every = found.where("whole").select(*at, "turns").unionByName(repaired)
    return every.select(*at, F.posexplode("turns").alias("place", "row")).select(*at, "place", "row.role", "row.text")
