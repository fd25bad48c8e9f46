"""Substring deduplication by content-defined chunks with a gear rolling hash.

The gear hash of a place depends on the 32 bytes before it only, so a chunk border moves with the
text: an insertion changes the chunks it touches and no other. A border stands where the ``BITS`` high
bits of the hash are zero and no such place is in the ``SMALLEST`` bytes before: a rule about the
text alone, so that two texts agree from the first border in a common passage on. A chunk that grows
beyond ``LARGEST`` bytes is cut there. Borders never fall inside a character. Chunks are compared by a 64-bit digest; a chance collision is one chunk,
never a passage. The first occurrence (smallest id, then smallest place) stays; later ones are repeats.

A single repeated chunk may be a common phrase. Repeats count as a passage of ``words`` words when a
run of touching repeated chunks holds at least a third as many: at either end of a passage the part of
a chunk is lost that reaches beyond it. Only passages are taken out.

Digests collapse to one row per task and digest before the shuffle. Chunks go back to their digest
by a join, which adaptive execution splits where a passage is in a third of all documents.

Rows: a null or empty text has no chunks; documents without id can't be told apart or come first, so
they are left as they are and are nobody's first occurrence; of rows that repeat an id none is a later
copy of another. An empty table gives no rows.
"""
from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import with_batches
from panelwright.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SMALLEST, LARGEST, BITS = 8, 512, 5
GEAR = np.random.RandomState(19790104).randint(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte: the sum of the table values of the last 32 bytes, shifted by age."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        older = h[:-step] << np.uint32(step) if step < len(h) else h[:0]
        h = h.copy()
        h[step:] += older
    return h


def borders(data: bytes) -> list[int]:
    """Ends of the chunks of one text."""
    codes = np.frombuffer(data, dtype=np.uint8)
    n = len(codes)
    starts_char = np.append((codes & 0xC0) != 0x80, True)
    wanted = np.flatnonzero((gear(codes) >> np.uint32(32 - BITS)) == 0) + 1
    wanted = wanted[starts_char[wanted]]
    if len(wanted):
        wanted = wanted[np.diff(wanted, prepend=-SMALLEST - 1) > SMALLEST]
    out, last = [], 0
    for end in [*wanted.tolist(), n]:
        while end - last > LARGEST:
            forced = last + LARGEST
            while not starts_char[forced]:
                forced -= 1
            out.append(forced)
            last = forced
        if end > last:
            out.append(end)
            last = end
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, version, mark, digest`` of the chunks of every text.

    ``version`` tells apart rows that repeat an id. ``mark`` is twice the number of the chunk, plus one
    if its text had the same chunk before.
    """
    names = ["doc_id", "version", "mark", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in names]
        kinds = [None, pa.int64(), pa.int32(), pa.int64()]

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(rows, kinds)], names=names)
            for v in rows:
                v.clear()
            return out

        for batch in batches:
            ids, texts = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("text"))
            kinds[0] = ids.type
            for doc, text in zip(ids.to_pylist(), texts):
                data = (text.as_py() or "").encode("utf-8", "replace")
                if doc is None or not data:
                    continue
                seen: set[int] = set()
                last, before = 0, len(rows[3])
                for at, end in enumerate(borders(data)):
                    digest = xxhash.xxh3_64_intdigest(data[last:end]) - (1 << 63)
                    rows[2].append(2 * at + (digest in seen))
                    rows[3].append(digest)
                    seen.add(digest)
                    last = end
                rows[0].extend([doc] * (len(rows[3]) - before))
                rows[1].extend([zlib.crc32(data)] * (len(rows[3]) - before))
                if len(rows[0]) >= 50_000:
                    yield flush()
        if rows[0]:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, version long, mark int, digest long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, version, marks``: twice the numbers of the chunks that stand elsewhere too, plus one for later copies."""
    pieces = cut_lineage(chunks(docs), "chunks")
    known = pieces.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    again = F.col("mark").bitwiseAND(F.lit(1)) == 1
    later = F.when(again | (F.col("doc_id") > F.col("first")), 1).otherwise(0)
    marked = pieces.join(known, "digest").select("doc_id", "version", F.shiftright("mark", 1).alias("at"), later.alias("later"))
    # a text has at most as many marks as chunks, so the sets are bounded by it
    return marked.groupBy("doc_id", "version").agg(F.collect_set(2 * F.col("at") + F.col("later")).alias("marks"))


def runs(flags: np.ndarray, words: np.ndarray, ends: np.ndarray, least: float) -> list[dict]:
    """Spans of runs of flagged chunks that hold at least ``least`` words."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total, place = np.concatenate([[0], np.cumsum(words)]), np.concatenate([[0], ends])
    return [{"start": int(place[a]), "end": int(place[b])} for a, b in zip(first, stop) if total[b] - total[a] >= least]


def deduplicated(docs: DataFrame, words: int = 50, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``repeats`` (spans that stand elsewhere too), ``removed`` (later copies) and ``clean_text`` without those."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("repeats", "removed", "clean_text")]
    found = repeated_chunks(docs).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("marks").alias("__marks"))
    same = (F.col("doc_id") == F.col("__id")) & (F.crc32(F.col("text").cast("binary")) == F.col("__version"))
    wide = docs.select(*dict.fromkeys([*keep, "doc_id", "text"])).join(found, same, "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            repeats, removed, clean = [], [], []
            for text, marks in zip(batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("__marks"))):
                text = text.as_py()
                marks = marks.as_py()
                known, later = [], []
                if text and marks:
                    data = text.encode("utf-8", "replace")
                    ends = np.array(borders(data))
                    places = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)[ends - 1]
                    size = np.array([len(data[a:b].split()) for a, b in zip([0, *ends[:-1]], ends)])
                    marks = np.array(marks)
                    on, late = np.zeros(len(ends), dtype=bool), np.zeros(len(ends), dtype=bool)
                    on[marks >> 1] = True
                    late[marks[marks & 1 == 1] >> 1] = True
                    known, later = runs(on, size, places, words / 3), runs(late, size, places, words / 3)
                    at, parts = 0, []
                    for s in later:
                        parts.append(text[at : s["start"]])
                        at = s["end"]
                    text = "".join(parts) + text[at:]
                repeats.append(known)
                removed.append(later)
                clean.append(text)
            return [pa.array(repeats, span), pa.array(removed, span), pa.array(clean, pa.string())]

        return work

    kind = "array<struct<start:long,end:long>>"
    return with_batches(wide, make, f"repeats {kind}, removed {kind}, clean_text string", keep)
