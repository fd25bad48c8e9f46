"""Registered queries of this subpackage: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import bpe, brown, chunk_dedup, decontamination, extraction, licenses, neardup, packing, pii, quality, repair, whitening, winnowing
from panelwright.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op1_pack_sum_of_squares")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents", "doc_id", "text"), *tokenizer_files())


WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS_SQL} AS w FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM items WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM starts),
sizes AS (SELECT DISTINCT k FROM item_windows),
places AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= k),
doc_windows AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM places),
hits AS (SELECT doc_id, doc_windows.k, i, item_id FROM doc_windows JOIN item_windows USING (win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op2_decontaminate", DECONTAMINATION_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.contamination(
        table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "benchmark", "item_id", "text"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@query("op5_quality_positive_unlabelled")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text")
    model = quality.train(docs, table(spark, sf, "labels", "doc_id", "quality"))
    return quality.score(docs, model, ["doc_id"]).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op6_minhash_near_duplicates")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents", "doc_id", "text"))


@query("op9_personal_data")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text")
    return pii.find(docs, pii.train(docs), ["doc_id"])


@query("op10_winnowing_fingerprints")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return winnowing.compare_with_edits(table(spark, sf, "documents", "doc_id", "text"))


@query("op7_extract_main_text")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extract(table(spark, sf, "pages", "page_id", "url", "html"), ["page_id", "url"])


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: passages that stand elsewhere too, those taken out as later copies, digest of the rest."""
    found = chunk_dedup.deduplicated(table(spark, sf, "documents", "doc_id", "text"), keep=["doc_id", "text"])
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.size("repeats").cast("long").alias("n_repeats"), total("repeats").alias("repeated_chars"),
        spans("repeats").alias("repeats"), F.size("removed").cast("long").alias("n_removed"), total("removed").alias("removed_chars"), spans("removed").alias("removed"),
        F.coalesce(F.length("clean_text"), F.lit(0)).cast("long").alias("clean_chars"), F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"))


@query("op8_license_scan")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``; licences of documents that are little else hold for their directory."""
    docs = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


@query("op4_brown_class_scores")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return brown.score(table(spark, sf, "documents", "doc_id", "text"))


@query("op11_whiten_by_bit_planes")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings", "vec_id", "embedding"))


@query("op12_byte_bpe_by_prefixes")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents", "doc_id", "text"), tokenizer_files()[0], ["doc_id"])


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf, "conversations", "conv_id", "turn", "role", "text")))
