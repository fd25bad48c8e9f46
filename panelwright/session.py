"""Session helpers: the shared scratch folder and lineage cuts."""
from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``; without it this raises. Only on a local
    master (tests on one machine) a temporary folder is made and remembered for the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="panelwright-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "cut", rows_per_file: int = 0) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Survives the loss of any executor, unlike a local checkpoint. ``rows_per_file`` bounds the rows of a file
    (0: no bound), and with them those of a task that reads: a scan counts a file as no less than its opening cost.
    """
    path = work_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.parquet(path)


_tables: contextvars.ContextVar[dict[str, DataFrame] | None] = contextvars.ContextVar("tables", default=None)


@contextmanager
def shared_tables() -> Iterator[None]:
    """Scope in which :func:`written_once` keeps its tables: one query, never longer."""
    token = _tables.set({})
    try:
        yield
    finally:
        _tables.reset(token)


def written_once(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A frame that several branches of one query read: written at first use, read by the rest.

    The big scan behind it happens once, not once per branch.
    """
    known = _tables.get()
    if known is None:
        return cut_lineage(build(), name)
    if name not in known:
        known[name] = cut_lineage(build(), name)
    return known[name]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
