"""Versioned geographic dimension."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelwright.sources.readers import normalise_name

LOOKUP = ("region_name", "region_code", "oktmo", "territory_id", "municipal_district_type")

# fixed values: the two spellings of a renamed district type
RETYPE_FROM = "муниципальный округ"
RETYPE_TO = "муниципальный район"


def unique_keys(dictionary: DataFrame) -> DataFrame:
    """Candidates per key, and the latest version where the key means one territory.

    All versions of a key fold into one row map-side, so a much repeated name stays small.
    """
    versions = dictionary.groupBy("key", "territory_id").agg(
        F.max(F.struct("year_to", *[c for c in LOOKUP if c != "territory_id"])).alias("v")
    )
    return versions.groupBy("key").agg(
        F.count(F.lit(1)).cast("int").alias("n_candidates"),
        F.max_by(F.struct("v.*", "territory_id"), "v.year_to").alias("v"),
    )


def attach_regions(
    entities: DataFrame, dictionary: DataFrame, retype: tuple[str, str] = (RETYPE_FROM, RETYPE_TO)
) -> DataFrame:
    """Left join entities (``mo``) to the dictionary.

    A homonym stays unresolved. An unresolved key is tried once more with the district
    type swapped. No side is forced to broadcast: the dictionary may be large, and the
    adaptive planner knows its size.
    """
    keys = unique_keys(dictionary)
    counts = keys.select("key", "n_candidates")
    lookup = keys.where(F.col("n_candidates") == 1).select(F.col("key").alias("alt_key"), *[f"v.{c}" for c in LOOKUP])
    ent = entities.withColumn("key", normalise_name("mo"))
    known = ent.join(counts, "key", "left")
    direct = F.coalesce(F.col("n_candidates"), F.lit(0)) == 1
    known = known.withColumn("alt_key", F.when(direct, F.col("key")).otherwise(F.replace("key", F.lit(retype[0]), F.lit(retype[1]))))
    joined = known.join(lookup, "alt_key", "left")
    return joined.select(
        *entities.columns,
        *LOOKUP,
        F.coalesce("n_candidates", F.lit(0)).cast("int").alias("n_candidates"),
        F.col("region_name").isNotNull().alias("region_resolved"),
    )


def join_report(joined: DataFrame) -> DataFrame:
    resolved = F.col("region_resolved")
    return joined.agg(
        F.count(F.lit(1)).alias("n_series"),
        F.count(F.when(resolved, 1)).alias("n_resolved"),
        F.count(F.when(F.col("n_candidates") > 1, 1)).alias("n_ambiguous"),
        F.count(F.when(~resolved & (F.col("n_candidates") <= 1), 1)).alias("n_unmatched"),
    )
