"""Document fingerprints by winnowing, in column expressions only.

A text is read as units: words between white space, and of longer ones every ``UNIT`` characters in a
row, one unit beginning at each character. So units don't depend on where a run without spaces begins,
and an inserted character changes the units and runs that hold it and no later ones. (``TILED`` units
cut a long word after every ``UNIT`` characters instead; the comparison doesn't use them.) Each run of ``k`` units gets a hash; of every window of ``w``
hashes the smallest is chosen, the rightmost of equal ones, and a choice that stays the same over
several windows counts once. Hash (36 bits) and position (27 bits, counted down so that a minimum
prefers the right) travel in one number. Two texts that share ``w + k - 1`` units in a row share a
chosen hash. A text with fewer than ``k`` units has the hash of all its units.

The hash of a run is taken over its ``k`` units at once: ``k`` is small, and a recurrence would have
to carry state from element to element.

Rows: a null or empty text, or one of white space, has the empty fingerprint; two empty ones are
alike (1.0), an empty one and another are not (0.0). Repeated rows have equal fingerprints.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W, UNIT = 4, 8, 8
POSITION_BITS = 27
NO_SPACE = "[^\\x20\\x09-\\x0D]"
TILED = f"({NO_SPACE}{{1,{UNIT}}})"
SLIDING = f"(?=((?<!{NO_SPACE}){NO_SPACE}{{1,{UNIT - 1}}}+(?!{NO_SPACE})|{NO_SPACE}{{{UNIT}}}))(?:{NO_SPACE}{{1,{UNIT}}}+(?!{NO_SPACE})|{NO_SPACE})"


def _packed(h: Column, at: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, 64 - 36), POSITION_BITS).bitwiseOR(F.lit((1 << POSITION_BITS) - 1) - at)


def with_choices(df: DataFrame, text: str, name: str, keep: list[str], k: int = K, w: int = W, unit: str = TILED) -> DataFrame:
    """``keep`` and the chosen numbers of ``text`` as array ``name``, by ascending position. ``unit`` is the first group of a pattern.

    The steps are columns of their own; each is used several times, so none is evaluated inside a lambda.
    """
    units = df.select(*keep, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(unit), 1).alias("__u"))
    n = F.size("__u")
    runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: _packed(F.xxhash64(*[F.get("__u", i + j) for j in range(k)]), i.cast("long")))
    hashes = units.select(*keep, F.when(n >= k, runs).when(n > 0, F.array(_packed(F.xxhash64("__u"), F.lit(0).cast("long")))).otherwise(F.array().cast("array<long>")).alias("__p"))
    m = F.size("__p")
    least = F.transform(F.sequence(F.lit(1), m - w + 1), lambda i: F.array_min(F.slice("__p", i, w)))
    chosen = F.when(m > w, F.array_distinct(least)).when(m > 0, F.array(F.array_min("__p"))).otherwise(F.col("__p"))
    return hashes.select(*keep, chosen.alias(name))


def position(x: Column) -> Column:
    return F.lit((1 << POSITION_BITS) - 1) - x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))


def as_text(choices: str) -> Column:
    """``hash@unit`` of every choice, comma-joined: equal texts have equal strings."""
    return F.array_join(F.transform(choices, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, POSITION_BITS))), F.lit("@"), position(x).cast("string"))), ",")


def hash_set(choices: str) -> Column:
    return F.array_distinct(F.transform(choices, lambda x: F.shiftrightunsigned(x, POSITION_BITS)))


def likeness(a: str, b: str) -> Column:
    """Share of the union of two hash sets that both have; 1.0 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def _block(doc_id: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (a power of two, less one, of them) below the id, by bisection; null: 0."""
    if not bounds:
        return F.lit(0)
    known, steps = F.array(*[F.lit(b).cast("long") for b in bounds]), (len(bounds) + 1).bit_length() - 1
    return F.aggregate(
        F.array(*[F.lit(1 << (steps - 1 - s)) for s in range(steps)]), F.lit(0),
        lambda at, step: F.when(F.get(known, at + step - 1) < doc_id.cast("long"), at + step).otherwise(at))


def in_blocks(docs: DataFrame) -> DataFrame:
    """``docs`` with ``block`` and ``guest``, for a walk along descending ids in blocks.

    Ids are cut into blocks of about equal size at approximate quantiles. The first row of a block also
    stands as a guest at the end of the block before it, that of the first block in the last one. Rows
    without id are in the last block.
    """
    spark = docs.sparkSession
    blocks = 1 << max(2, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    cuts = docs.agg(F.percentile_approx("doc_id", [(i + 1) / blocks for i in range(blocks - 1)], 20 * blocks)).first()[0] or []
    block = _block(F.col("doc_id"), [int(c) for c in cuts])
    heads = docs.select("doc_id", block.alias("block")).groupBy("block").agg(F.max("doc_id").alias("head"))
    down = Window.orderBy(F.col("block").desc())  # over one row for each block
    guests = heads.select("head", F.coalesce(F.lag("block").over(down), F.min("block").over(Window.partitionBy())).alias("block"))
    # at most one row for each block: the bound makes the hint safe
    moved = docs.join(F.broadcast(guests), F.col("doc_id") == F.col("head")).drop("head").withColumn("guest", F.lit(1))
    return docs.withColumn("block", block).withColumn("guest", F.lit(0)).unionByName(moved)


def with_next(blocked: DataFrame, carried: list[str]) -> DataFrame:
    """Every row with the ``carried`` columns of the next document (``next_...``) by descending id.

    After the last document comes the first. Rows of one id are ordered by text; rows without id come last.
    """
    order = Window.partitionBy("block").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    led = blocked.select("*", *[F.coalesce(F.lead(c).over(order), F.col(c)).alias(f"next_{c}") for c in carried])
    return led.where("guest = 0").drop("guest", "block")


def compare_with_edits(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Edited: the last half of the code points gives way to as many first ones of the next document.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = with_choices(in_blocks(docs), "text", "chosen", ["doc_id", "text", "block", "guest"], k, w, SLIDING)
    led = with_next(own, ["text", "chosen"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = led.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "chosen", "next_chosen",
        F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 2)))"), F.substring("next_text", F.lit(1), half)).alias("edited"))
    edited = edited.select("doc_id", "n_chars", "chosen", "next_chosen", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    both = with_choices(edited, "edited", "edited_chosen", ["doc_id", "n_chars", "chosen", "next_chosen", "edited_sha256"], k, w, SLIDING)
    sets = both.select("doc_id", "n_chars", "edited_sha256", as_text("chosen").alias("fingerprint"), as_text("edited_chosen").alias("edited_fingerprint"),
                       hash_set("chosen").alias("a"), hash_set("edited_chosen").alias("b"), hash_set("next_chosen").alias("c"))
    return sets.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"))
