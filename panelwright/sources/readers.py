"""Readers. Each takes frames or paths and returns a frame with a fixed schema."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PANEL_COLUMNS = ("period", "value", "mo", "category", "freq", "unit")


def to_month(column: str | Column) -> Column:
    """Any date or timestamp to the first day of its month."""
    return F.trunc(column, "MM")


def require_columns(df: DataFrame, expected: Sequence[str], what: str = "input") -> None:
    missing = sorted(set(expected) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: expected columns are missing: {missing}")


def read_panel(raw: DataFrame, freq: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """Check the columns, keep one frequency, truncate to months, coerce numbers to NULL.

    ``first`` and ``last`` month bound the raw period itself, so the scan can skip files and
    row groups; a predicate on the truncated month could not be pushed down.
    """
    require_columns(raw, PANEL_COLUMNS, "panel")
    if first is not None:
        raw = raw.where(F.col("period") >= F.lit(first))
    if last is not None:
        after = date(last.year + last.month // 12, last.month % 12 + 1, 1)
        raw = raw.where(F.col("period") < F.lit(after))
    # a numeric column needs no detour through text
    text = dict(raw.dtypes)["value"] == "string"
    number = F.col("value").try_cast("double") if text else F.col("value").cast("double")
    return raw.where(F.col("freq") == freq).select(
        to_month("period").alias("month"),
        F.when(~F.isnan(number), number).alias("value"),
        *[c for c in raw.columns if c not in ("period", "value", "freq", "unit")],
    )


def read_aggregate(raw: DataFrame, where: Mapping[str, str], period: str = "period", value: str = "value") -> DataFrame:
    """Mean value per month of the rows equal to every entry of ``where``."""
    for column, wanted in where.items():
        raw = raw.where(F.col(column) == wanted)
    return raw.groupBy(to_month(period).alias("month")).agg(F.avg(value).alias("value"))


def read_industry(
    datasets: Mapping[str, DataFrame],
    dimension: str,
    total_name: str,
    min_months: int = 48,
) -> DataFrame:
    """Long series per dataset and industry: the total is dropped, short or non-positive series too."""
    union: DataFrame | None = None
    for slug, frame in datasets.items():
        part = frame.select(
            F.concat(F.lit(f"{slug}/"), F.col(dimension)).alias("series_key"),
            F.lower(F.trim(dimension)).alias("_name"),
            to_month("period").alias("month"),
            "value",
        ).where(F.col("_name") != total_name)
        union = part if union is None else union.unionByName(part)
    monthly = union.groupBy("series_key", "month").agg(F.avg("value").alias("value"))
    kept = (
        monthly.groupBy("series_key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"))
        .where((F.col("n") >= min_months) & (F.col("low") > 0))
    )
    return monthly.join(kept.select("series_key"), "series_key", "left_semi")


def normalise_name(name: str | Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def read_dictionary(raw: DataFrame, year_from: int, year_to: int) -> DataFrame:
    """Versions alive at any time of ``[year_from, year_to]``, with a normalised key."""
    alive = (F.col("year_from").try_cast("int") <= year_to) & (F.col("year_to").try_cast("int") >= year_from)
    return raw.where(alive).withColumn("key", normalise_name("municipal_district_name"))


HEADLINE_SCHEMA = "url string, title string, date string, region_name string, domain string"
BODY_SCHEMA = "url string, domain string, month string, title string, body string"


def scan_headlines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a stable position: file name, then byte block, then line order inside the split."""
    raw = spark.read.schema(HEADLINE_SCHEMA).json(path)
    return raw.withColumn("pos", F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    ))


def read_headlines(rows: DataFrame, order: str = "pos") -> DataFrame:
    """First row per url, bad dates dropped, month, repaired and transliterated title.

    ``min`` of a struct combines map-side, so a url copied a billion times is one row
    per task before the shuffle.
    """
    from panelwright.functions.text import repair_encoding, transliterate

    rest = [c for c in rows.columns if c not in (order, "url")]
    first = rows.groupBy("url").agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select("url", "r.*")
    dated = first.withColumn("date", F.col("date").cast("string").try_cast("date")).where(F.col("date").isNotNull())
    return (
        dated.withColumn("month", to_month("date"))
        .withColumn("title", repair_encoding(F.col("title")))
        .withColumn("norm", transliterate(F.col("title")))
    )


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines split on ``\\n`` only: other Unicode separators stay inside the text."""
    return spark.read.schema(BODY_SCHEMA).option("lineSep", "\n").json(path)


def read_external_features(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Several monthly aggregates in one long frame ``(name, month, value)``."""
    out: DataFrame | None = None
    for name, frame in sources.items():
        part = frame.select(F.lit(name).alias("name"), "month", "value")
        out = part if out is None else out.unionByName(part)
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_results(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    """The full table if it is there, else its snapshot, else an error naming both."""
    for candidate in (path, snapshot):
        if path_exists(spark, candidate):
            return spark.read.parquet(candidate)
    raise FileNotFoundError(f"neither the results table nor its snapshot exists: {path}, {snapshot}")


def read_protocol_tables(table: DataFrame, protocol: str, penalties: Sequence[float]) -> DataFrame:
    """Accept a stored table only if its protocol and penalty grid are the configured ones."""
    stored = {r[0] for r in table.select("protocol").distinct().limit(1000).collect()}
    if stored != {protocol}:
        raise ValueError(f"stored protocol {sorted(map(str, stored))} differs from {protocol!r}")
    grid = {r[0] for r in table.where(F.col("penalty").isNotNull()).select("penalty").distinct().limit(10_000).collect()}
    if grid != set(penalties):
        raise ValueError(f"stored penalty grid {sorted(grid)} differs from {sorted(penalties)}")
    return table
