"""A corpus pipeline: quality, near-duplicates, benchmark decontamination, personal data, packing.

Each stage works on all rows that the one before kept. All but the last return the columns of
``documents``. Rows: see the operators; a document without id is never a duplicate and stays.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontamination, neardup, packing, pii, quality
from panelwright.llm.common import grown, table
from panelwright.llm.queries import tokenizer_files
from panelwright.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives at least 0.3 for label 1."""
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score(docs, model, name="__score").where("__score >= 0.3").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (80 % of shingles and more): the one with the smallest id, once.

    A row is told by its id and its text, so that no text goes without a kept one that resembles it.
    """
    key = ["doc_id", "__mark"]
    kept = neardup.survivors(docs, percent=80).withColumnRenamed("mark", "__mark")
    once = docs.withColumn("__mark", neardup.text_mark()).join(grown(kept), key, "left_semi")
    return once.dropDuplicates(key).select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    named = docs.toDF(*[c if c == "text" else f"__own_{c}" for c in docs.columns])
    clean = decontamination.contamination(named, table(spark, sf_dir, "benchmark", "item_id", "text")).where("not contaminated")
    return clean.select(*[F.col(n).alias(c) for n, c in zip(named.columns, docs.columns)])


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked in the text; ``n_chars`` follows the text."""
    masked = pii.redact(docs, pii.train(docs))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), length).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, *tokenizer_files())


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
