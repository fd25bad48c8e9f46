"""Writers. Replaced rows are written beside the old ones; what is current changes at once, by one small file."""
from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from panelwright.operators.folds import check_same_panel


def write_features(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)


def with_protocol(df: DataFrame, protocol: str) -> DataFrame:
    """``protocol`` as the first column."""
    rest = [c for c in df.columns if c != "protocol"]
    return df.select(F.lit(protocol).alias("protocol"), *rest)


def write_versioned(df: DataFrame, path: str, protocol: str) -> None:
    with_protocol(df, protocol).write.parquet(path)


def replaced_keys(fresh: DataFrame, keys: Sequence[str], explicit: DataFrame | None = None) -> DataFrame:
    """Keys a batch replaces; the explicit ones count even when the batch is empty."""
    found = fresh.select(*keys).distinct()
    if explicit is not None:
        found = found.unionByName(explicit.select(*keys)).distinct()
    return found


def upsert(previous: DataFrame, fresh: DataFrame, keys: Sequence[str], explicit: DataFrame | None = None) -> DataFrame:
    """Rows of the batch's keys replaced, all other rows kept.

    The key list is one row per model (and horizon): the anti join shuffles nothing large.
    """
    gone = replaced_keys(fresh, keys, explicit)
    return previous.join(gone, list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def archive_replaced(previous: DataFrame, fresh: DataFrame, keys: Sequence[str], path: str,
                     stamp: str | None = None, explicit: DataFrame | None = None) -> str:
    """Rows about to be replaced, under a UTC stamp. An existing snapshot is never overwritten."""
    stamp = stamp or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S")
    target = f"{path}/stamp={stamp}"
    gone = replaced_keys(fresh, keys, explicit)
    previous.join(gone, list(keys), "left_semi").write.mode("errorifexists").partitionBy(*keys).parquet(target)
    return target


def write_and_verify(df: DataFrame, path: str, compression: str = "gzip") -> DataFrame:
    """Write a snapshot, read it back and count the rows on which the two differ."""
    df.write.option("compression", compression).parquet(path)
    return snapshot_difference(df, df.sparkSession.read.parquet(path))


def snapshot_difference(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Rows missing from the copy, extra rows in it, and both sizes. One hash aggregate."""
    columns = source.columns
    tagged = source.withColumn("_s", F.lit(1)).unionByName(copy.select(*columns).withColumn("_s", F.lit(-1)))
    sides = tagged.groupBy(*columns).agg(
        F.sum("_s").alias("_d"), F.count(F.when(F.col("_s") == 1, 1)).alias("_a"), F.count(F.when(F.col("_s") == -1, 1)).alias("_b")
    )
    zero = F.lit(0).cast("bigint")
    return sides.agg(
        F.coalesce(F.sum(F.greatest(F.col("_d"), zero)), zero).alias("n_missing"),
        F.coalesce(F.sum(F.greatest(-F.col("_d"), zero)), zero).alias("n_extra"),
        F.coalesce(F.sum("_a"), zero).alias("n_source"),
        F.coalesce(F.sum("_b"), zero).alias("n_copy"),
    )


def series_json(documents: DataFrame, shard: str, max_bytes: int = 50_000_000) -> DataFrame:
    """One JSON line per series with its shard size; a shard over the cap is an error, checked first."""
    fields = [c for c in documents.columns if c != shard]
    lines = documents.select(shard, "series_id", F.to_json(F.struct(*fields)).alias("doc"))
    sizes = lines.groupBy(shard).agg(F.sum(F.octet_length("doc")).alias("shard_bytes"))
    over = sizes.where(F.col("shard_bytes") > max_bytes).orderBy(shard).limit(20).collect()
    if over:
        raise ValueError(f"shards over {max_bytes} bytes: {[(r[0], r[1]) for r in over]}; nothing was written")
    return lines


def write_series_json(documents: DataFrame, shard: str, path: str, max_bytes: int = 50_000_000) -> None:
    series_json(documents, shard, max_bytes).select(shard, F.col("doc").alias("value")).write.partitionBy(shard).text(path)


# --- a stored result table whose current version changes at once --------------------------------

POINTER = "version long, id string, parent string, schema string, parts array<struct<key:string,folder:string,n:long>>"


class ResultTable:
    """Rows by key (model, or model and horizon) in a folder that the driver and all executors share.

    A key's rows lie in a folder that is never changed. What is current is said by one small file: it lists
    the folder of each key. A batch writes the folders of its own keys, checks them, and then adds the next
    file; readers see the table before it or after it, and an interrupted batch changes nothing.
    A batch costs its own size, not the table's.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("model",)):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), tuple(keys)

    def _pointers(self) -> list:
        """Entries of the newest version, the valid one first: normally one row."""
        try:
            found = self.spark.read.schema(POINTER).json(f"{self.path}/current/*")
            newest = found.agg(F.max("version")).first()[0]
            return found.where(F.col("version") == newest).orderBy("id").collect() if newest is not None else []
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return []

    def _key(self) -> Column:
        return F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in self.keys]), {"ignoreNullFields": "false"})

    def read(self) -> DataFrame | None:
        """The current rows; None before the first batch."""
        now = self._pointers()
        if not now:
            return None
        schema, folders = T.StructType.fromJson(json.loads(now[0]["schema"])), [p["folder"] for p in now[0]["parts"]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def merge(self, fresh: DataFrame, stamp: str | None = None, explicit: DataFrame | None = None) -> DataFrame:
        """Replace the rows of the batch's keys, and of the ``explicit`` ones even if the batch has none; keep all others.

        A batch with rows must hold the series and fold numbers of the table. Rows that go are archived under
        ``realizations/``. Raises, and leaves the table as it was, if the written folders don't hold the batch
        or another batch came first. The batch is computed once.
        """
        now = self._pointers()
        batch, named = uuid.uuid4().hex, self._named(explicit)
        written = Observation()
        marked = fresh.observe(written, F.count(F.lit(1)).alias("n"), self._digest(fresh).alias("digest"))
        marked.withColumn("__part", F.md5(self._key())).write.partitionBy("__part").parquet(f"{self.path}/data/{batch}")
        staged = self.spark.read.schema(T.StructType([*fresh.schema.fields, T.StructField("__part", T.StringType())])).parquet(f"{self.path}/data/{batch}")
        # one row for each key
        found = staged.groupBy(self._key().alias("key"), "__part").agg(F.count(F.lit(1)).alias("n"), self._digest(fresh).alias("digest")).collect()
        self._verify(written.get, found)
        if not found and not named:
            raise ValueError("the batch is empty and names no keys: nothing was written")
        old = self.read()
        if old is not None and found:
            check_same_panel(old, staged, by_horizon="horizon" in old.columns)
        gone = {r["key"] for r in found} | named
        schema = fresh.schema if old is None else _joint_schema(old.schema, fresh.schema) if found else old.schema
        if old is not None and any(p["key"] in gone for p in now[0]["parts"]):
            stamp = stamp or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S")
            old.where(self._key().isin(sorted(gone))).write.mode("errorifexists").parquet(f"{self.path}/realizations/stamp={stamp}")
        kept = [tuple(p) for p in now[0]["parts"] if p["key"] not in gone] if now else []
        parts = kept + sorted((r["key"], f"data/{batch}/__part={r['__part']}", r["n"]) for r in found)
        self._point((now[0]["version"] + 1 if now else 1, now[0]["id"] if now else None, schema.json(), parts))
        return self.read()

    def _named(self, explicit: DataFrame | None) -> set[str]:
        return set() if explicit is None else {r[0] for r in explicit.select(self._key()).distinct().collect()}  # one row for each key

    def _digest(self, df: DataFrame) -> Column:
        """Depends on every value of every row, not on their order."""
        return F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(20,0)"))

    def _verify(self, written: dict, found: list) -> None:
        n, digest = sum(r["n"] for r in found), sum((r["digest"] for r in found), 0)
        if n != written["n"] or digest != (written["digest"] or 0):
            raise ValueError(f"the batch had {written['n']} rows, its folders have {n} or other values; the table is as it was")

    def _point(self, entry: tuple) -> None:
        """Make an entry current: one file in a folder of its own. Of two batches on the same version the earlier one counts."""
        own = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(entry[0], own, *entry[1:])], POINTER).coalesce(1).write.json(f"{self.path}/current/{own}")
        if self._pointers()[0]["id"] != own:
            raise RuntimeError(f"another batch made version {entry[0]} at the same time; merge again")


def _joint_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    """Columns of both; a column that changed its type is an error."""
    kinds = {f.name: f.dataType for f in old.fields}
    changed = [f.name for f in new.fields if f.name in kinds and kinds[f.name] != f.dataType]
    if changed:
        raise ValueError(f"columns {changed} have another type than in the table; nothing was replaced")
    return T.StructType([*old.fields, *[f for f in new.fields if f.name not in kinds]])
