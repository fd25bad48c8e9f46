"""Near-duplicates by MinHash: universal hash minima, banding, signature check, exact check, components.

A document's set is its distinct five-word shingles. Two documents are linked if their sets share at
least 85 % of their union.

1. Documents with the same word sequence have the same set: one node, numbered as it is written, stands for
   all of them; ids, of any type, come back at the end.
2. Each representative gets ``BANDS * ROWS`` minima of universal hashes (multiply and shift of a 64-bit
   shingle hash). At 85 % a pair misses all bands with a chance below 1e-6, at 80 % below 1e-4.
3. Representatives that share a band meet in a bucket. No bucket emits its pairs. First each
   representative is compared with the smallest one it meets anywhere, then with the smallest of each
   bucket; after each step what is linked becomes one component, and pairs within a component need
   no further look. At last the documents outside the largest component of what meets are compared
   with all they meet, in blocks of bounded size, so that no link is lost.
4. A comparison looks at the sizes, then at the signatures, then at the full sets; in blocks at the
   full sets at once.
5. Components come from alternating large-star and small-star.

Copies and hub documents never meet in one task: they are collapsed by minima before the shuffle,
and pair tables join with the sets row by row, which adaptive execution splits when a key is hot.

Rows: a null or empty text has no set and is linked with nothing. A row without id is its own
component (null) and is kept. Rows that repeat an id with the same text are one document; with
other texts each row has the component of its own text, so several texts of an id may be kept.
:func:`survivors` names one row of each component, whatever ids repeat. An empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import column, grown, with_batches, words_of
from panelwright.llm.components import components
from panelwright.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BANDS, ROWS = 32, 6
_draws = np.random.RandomState(20240607)
FACTOR = (_draws.randint(0, 2**63 - 1, BANDS * ROWS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
SHIFT = _draws.randint(0, 2**63 - 1, BANDS * ROWS, dtype=np.int64).astype(np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``n`` words; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        run = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            run = run * BASE + each[k : len(each) - n + 1 + k]
        return np.unique(mixed(run))


def minima(items: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash over a set, as 32 bits."""
    best = np.full(len(FACTOR), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(items), 2048):
            np.minimum(best, (items[k : k + 2048, None] * FACTOR + SHIFT).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def text_mark() -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, digest, n_shingles, bands, signature`` of every row; bands and signature are packed bytes."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            digest, sizes, bands, signature = [], [], [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                words = words_of(text.as_py())
                items = shingles(words)
                sizes.append(len(items))
                if len(items):
                    digest.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                    best = minima(items)
                    rows = best.reshape(BANDS, ROWS)
                    bands.append(b"".join(xxhash.xxh3_64_digest(r.tobytes(), seed=k) for k, r in enumerate(rows)))
                    signature.append((best & np.uint32(255)).astype(np.uint8).tobytes())
                else:
                    digest.append(None)
                    bands.append(None)
                    signature.append(None)
            return [pa.array(digest, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.binary()), pa.array(signature, pa.binary())]

        return work

    marked = docs.select("doc_id", "text", text_mark().alias("mark"))
    return with_batches(marked, make, "digest binary, n_shingles long, bands binary, signature binary", ["doc_id", "mark"])


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``node`` with its whole set as packed sorted 64-bit hashes."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([shingles(words_of(t.as_py())).tobytes() for t in batch.column(batch.schema.get_field_index("text"))], pa.binary())]

        return work

    return with_batches(docs, make, "items binary", ["node"])


def _filtered(pairs: DataFrame, left: str, right: str, passes) -> DataFrame:
    """Rows of ``pairs`` whose two byte columns pass a check."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([passes(x, y) for x, y in zip(column(batch, left), column(batch, right))], pa.bool_())]

        return work

    return with_batches(pairs, make, "ok boolean", ["a", "b"]).where("ok").select("a", "b")


def verified(pairs: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar: sizes, then signatures, then sets."""
    slack = percent / 100 - 0.16  # six standard deviations of the estimate

    def alike(x: bytes, y: bytes) -> bool:
        return float(np.mean(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8))) >= slack

    def same(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    one = marks.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a"))
    two = marks.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b"))
    near = pairs.join(grown(one), "a").join(grown(two), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    likely = _filtered(near, "s_a", "s_b", alike)
    x = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return _filtered(likely.join(grown(x), "a").join(grown(y), "b"), "x", "y", same)


def _blocks_linked(key: tuple, table: pa.Table, percent: int) -> pa.Table:
    """Links between the two sides of a block pair, or within one block, that join two components.

    The sets of a block are one flat array of numbers; a document marks its own numbers and sums the
    marks over the others. What is linked is one component from then on.
    """
    same_block = key[3].as_py() == "s" and key[1].as_py() == key[2].as_py()
    table = table.sort_by("node")
    node, component, left = (table.column(c).to_pylist() for c in ("node", "component", "left"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    component = np.array(component)
    flat, number = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(len(flat), dtype=np.int32)
    left = np.array(left)
    a, b = [], []
    for k in range(len(node)):
        if not left[k]:
            continue
        own = number[starts[k] : starts[k] + sizes[k]]
        free = (component != component[k]) & (100 * np.minimum(sizes, sizes[k]) >= percent * np.maximum(sizes, sizes[k]))
        free &= (np.arange(len(node)) > k) if same_block else ~left
        if not free.any():
            continue
        mark[own] = 1
        common = np.add.reduceat(mark[number], starts)
        mark[own] = 0
        for j in np.flatnonzero(free & (100 * common >= percent * (sizes + sizes[k] - common))):
            if component[j] != component[k]:
                a.append(node[k])
                b.append(node[j])
                component[component == component[j]] = component[k]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def cross_links(rest: DataFrame, marks: DataFrame, sets: DataFrame, percent: int, docs_in_block: int = 256, shingles_in_block: int = 1_000_000) -> DataFrame:
    """Links (a, b) between components that still share a bucket. ``rest``: node, component, lead of a bucket.

    Nodes that meet through buckets are one family. The nodes outside its largest component are the
    queries; they are compared in blocks with each other and with the largest component, whose own
    nodes are never compared. A task holds two blocks, whose documents and shingles are bounded; pairs
    that fail are never rows.
    """
    families = components(rest.select(F.col("node").alias("u"), F.col("lead").alias("v"))).select("node", F.col("component").alias("family"))
    members = cut_lineage(rest.select("node", "component").distinct().join(grown(families), "node").join(grown(marks.select("node", "n")), "node"), "members")
    parts = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    largest = F.max(F.struct("docs", "component")).getField("component")
    top = parts.groupBy("family").agg(largest.alias("main"))
    sized = parts.join(grown(top), "family").groupBy("family").agg(F.first("main").alias("main"), *[
        F.greatest(F.ceil(F.sum(F.when(side, F.col("docs")).otherwise(0)) / docs_in_block), F.ceil(F.sum(F.when(side, F.col("shingles")).otherwise(0)) / shingles_in_block)).cast("int").alias(name)
        for name, side in (("open_blocks", F.col("component") != F.col("main")), ("main_blocks", F.col("component") == F.col("main")))])
    placed = members.join(grown(sized), "family").withColumn("left", F.col("component") != F.col("main"))
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.when(F.col("left"), F.col("open_blocks")).otherwise(F.col("main_blocks"))).cast("int")
    pair = lambda lo, hi, kind: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.lit(kind).alias("kind"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    with_open = F.transform(upto("open_blocks"), lambda j: pair(F.least("block", j), F.greatest("block", j), "s"))
    with_main = F.transform(upto("main_blocks"), lambda j: pair(F.col("block"), j, "o"))
    as_main = F.transform(upto("open_blocks"), lambda j: pair(j, F.col("block"), "o"))
    placed = placed.withColumn("block", block)
    spread = placed.select(
        "node", "component", "family", "left", F.col("block").alias("own"), F.explode(F.when(F.col("left"), F.concat(with_open, with_main)).otherwise(as_main)).alias("at"))
    # in a pair of open blocks the lower block asks the higher one
    asks = F.when(F.col("at.kind") == "s", F.col("at.lo") == F.col("own")).otherwise(F.col("left"))
    rows = spread.select("node", "component", "family", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"), F.col("at.kind").alias("kind"), asks.alias("left"))
    rows = rows.join(grown(sets), "node")

    def linked(key: tuple, table: pa.Table) -> pa.Table:
        return _blocks_linked(key, table, percent)

    return rows.groupBy("family", "lo", "hi", "kind").applyInArrow(linked, "a long, b long")


def _relabelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after joining the components of linked nodes."""
    at = lambda c: nodes.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    between = links.join(grown(at("a")), "a").join(grown(at("b")), "b").select(F.col("c_a").alias("u"), F.col("c_b").alias("v"))
    merged = components(between).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    return cut_lineage(nodes.join(grown(merged), "component", "left").select("node", F.coalesce("merged", "component").alias("component")), "nodes")


def _found(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of every row, and ``digest, head`` of every text that is linked or a copy: the smallest (id, mark) of its component."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sketches = cut_lineage(sketch(docs), "sketches")
    known = sketches.where("doc_id is not null and digest is not null")
    first = [F.first(c).alias(c) for c in ("bands", "signature")]
    groups = known.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("head"), F.first("n_shingles").alias("n"), *first)
    groups = cut_lineage(groups.withColumn("node", F.monotonically_increasing_id()), "groups")  # the numbers hold once written
    bucket: Column = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.alias("band"), F.substring("bands", k * 8 + 1, F.lit(8)).alias("key")))
    placed = groups.select("node", F.explode(bucket).alias("at")).select("node", F.xxhash64("at.band", "at.key").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last").select("bucket", "centre")
    met = cut_lineage(placed.join(grown(shared), "bucket"), "buckets")

    met_nodes = met.select("node").distinct()
    marks = cut_lineage(groups.join(grown(met_nodes), "node", "left_semi").select("node", "n", "signature", "head"), "marks")
    heads = marks.select("node", F.col("head.doc_id").alias("doc_id"), F.col("head.mark").alias("mark"))
    texts = docs.withColumn("mark", text_mark()).join(grown(heads), ["doc_id", "mark"]).select("node", "text")
    sets = cut_lineage(shingle_sets(texts).dropDuplicates(["node"]), "sets")

    nodes = met_nodes.select("node", F.col("node").alias("component"))
    first_met = met.where("centre <> node").groupBy("node").agg(F.min("centre").alias("b")).select(F.col("node").alias("a"), "b")
    nodes = _relabelled(nodes, verified(first_met, marks, sets, percent))

    labelled = met.join(grown(nodes), "node")
    centres = nodes.select(F.col("node").alias("centre"), F.col("component").alias("centre_component"))
    open_stars = labelled.join(grown(centres), "centre").where("component <> centre_component").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    nodes = _relabelled(nodes, verified(open_stars, marks, sets, percent))

    labelled = met.join(grown(nodes), "node")
    torn = labelled.groupBy("bucket").agg(F.min("node").alias("lead"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket", "lead")
    rest = cut_lineage(labelled.join(grown(torn), "bucket").select("node", "component", "lead").distinct(), "open")
    nodes = _relabelled(nodes, cross_links(rest, marks, sets, percent))

    # only components of several nodes need their smallest id
    sizes = nodes.join(grown(marks.select("node", "head")), "node").groupBy("component").agg(F.min("head").alias("lowest"), F.count(F.lit(1)).alias("size")).where("size > 1")
    lowest = nodes.join(grown(sizes), "component").select("node", "lowest")
    named = groups.select("digest", "node", "head").join(grown(lowest), "node", "left").select("digest", F.coalesce("lowest", "head").alias("head"))
    return sketches, named


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    sketches, named = _found(docs, percent)
    out = sketches.select("doc_id", "digest", "n_shingles").join(grown(named), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("head.doc_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def survivors(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, mark`` of one row of each component with an id; rows without words stay each, by id."""
    sketches, named = _found(docs, percent)
    bare = sketches.where("doc_id is not null and digest is null").select("doc_id", "mark")
    return named.select("head.doc_id", "head.mark").unionByName(bare).distinct()
