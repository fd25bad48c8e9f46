"""Benchmark decontamination with one Aho-Corasick automaton over normalised item windows.

Words are runs of ASCII letters and digits and of characters above U+007F, A-Z lower-cased. A
window is ``n`` consecutive words of an item; an item with fewer words is one window. Windows are
written as ``" w1 w2 ... "``, a document likewise, so that the automaton matches whole words only,
and the place of a match in that string gives word numbers and through them the offsets in the
original text.

The automaton goes to the executors in blocks of at most ``block_chars`` characters of windows; a
usual benchmark is one block. For a larger one the documents pass once for each block, what was
found so far being carried in the row, with a written table in between; memory stays bounded.

Rows: a null or empty text, or one without words, has no words and no hits. Items with a null or
empty text have no windows; an item without id marks words but is not named. Items that repeat an
id are one item. Repeated documents are judged row by row. Empty tables give no rows or no hits.
"""
from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import column, lower_ascii, pack_spans, with_batches
from panelwright.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
FOUND = "__n_words long, __ranges array<struct<first:long,last:long>>, __spans array<struct<start:long,end:long>>, __items array<string>"


def windows(text: str | None, n: int) -> set[str]:
    words = WORD.findall(lower_ascii(text)) if text else []
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def blocks(items: DataFrame, n: int, block_chars: int) -> Iterator[list[tuple[str, list[str]]]]:
    """Windows with the items that have them; no block holds more than about ``block_chars``."""
    block: dict[str, set[str]] = {}
    size = 0
    for item_id, text in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        for window in windows(text, n):
            size += 0 if window in block else len(window) + 2
            owners = block.setdefault(window, set())
            if item_id is not None and item_id not in owners:
                owners.add(item_id)
                size += len(item_id)
        if size >= block_chars:
            yield [(w, sorted(o)) for w, o in block.items()]
            block, size = {}, 0
    if block:
        yield [(w, sorted(o)) for w, o in block.items()]


def scan(docs: DataFrame, block: list[tuple[str, list[str]]], keep: list[str]) -> DataFrame:
    """One pass: word numbers, spans and items of all matches, joined with those of earlier passes."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    before = "__ranges" in docs.columns

    def make():
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for window, owners in shared.value:
            automaton.add_word(f" {window} ", (window.count(" ") + 1, owners))
        automaton.make_automaton()
        searchable = len(automaton) > 0

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(batch.schema.get_field_index("text"))
            old_ranges, old_items = (column(batch, "__ranges"), column(batch, "__items")) if before else ([[]] * len(texts), [[]] * len(texts))
            counts, ranges, spans, items = [], [], [], []
            for text, had, named in zip(texts, old_ranges, old_items):
                text = text.as_py()
                low = lower_ascii(text) if text else ""
                words = WORD.findall(low)
                hits = list(automaton.iter(f" {' '.join(words)} ")) if words and searchable else []
                counts.append(len(words))
                where = [(r["first"], r["last"] + 1) for r in had]
                if hits:
                    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words)))
                    last = np.searchsorted(ends, np.fromiter((end for end, _ in hits), dtype=np.int64, count=len(hits)))
                    where += [(int(e) - k + 1, int(e) + 1) for e, (_, (k, _)) in zip(last, hits)]
                where = pack_spans(where)
                ranges.append([{"first": a, "last": b - 1} for a, b in where])
                items.append(sorted({*named, *(o for _, (_, owners) in hits for o in owners)}))
                if where:
                    at = [m.span() for m in WORD.finditer(low)]
                    spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in where])
                else:
                    spans.append([])
            pair = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
            return [pa.array(counts, pa.int64()), pa.array(ranges, pair("first", "last")), pa.array(spans, pair("start", "end")), pa.array(items, pa.list_(pa.string()))]

        return work

    return with_batches(docs, make, FOUND, keep)


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, block_chars: int = 4_000_000, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (the columns in ``keep``, all by default) with what the benchmark has in common with them.

    Adds ``n_words``, ``n_hit`` (words inside a window), ``n_items``, ``item_ids`` (sorted as
    strings), ``hit_spans`` (offsets in the original text) and ``contaminated``. Columns of these
    names in ``docs`` are replaced.
    """
    keep = list(docs.columns if keep is None else keep)
    keep = [c for c in keep if c not in ("n_words", "n_hit", "n_items", "item_ids", "hit_spans", "contaminated")]
    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    waiting: list | None = None
    for block in blocks(items, n, block_chars):
        if waiting is not None:
            docs = cut_lineage(scan(docs, waiting, docs_columns(docs)), "contamination")
        waiting = block
    found = scan(docs, waiting or [], keep)
    hit = F.aggregate("__ranges", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return found.select(
        *keep, F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.col("__items").alias("item_ids"), F.col("__spans").alias("hit_spans"), (F.size("__ranges") > 0).alias("contaminated"))


def docs_columns(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("__n_words", "__ranges", "__spans", "__items")]
