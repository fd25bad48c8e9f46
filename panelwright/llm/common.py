"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import ctypes
import gc
import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What splits words in the contracts: space and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


def grown(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the documents: sorted and merged, never broadcast, however small it seems.

    Spark takes a written table for as small as its compressed files, and one after an explode for as small as the
    table before it; what it then broadcasts passes through the driver.
    """
    return df.hint("merge")


def lower_ascii(text: str) -> str:
    """A-Z only, so that no text changes its number of code points."""
    return text.encode("utf-8", "replace").lower().decode("utf-8")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def lower_column(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``. A null id counts as 1: never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % of, F.lit(1))


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the worker process: models that many tasks load."""
    home = sys.modules.setdefault("_panelwright_process_cache", types.ModuleType("_panelwright_process_cache"))
    return home.__dict__.setdefault(name, {})


def give_back() -> None:
    """Return freed memory of this worker process to the system.

    Spark keeps a worker that has ended its task for the next one; without this it keeps the peak of its
    past tasks beside the workers of the next stage.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; others return pages by themselves
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a task, with :func:`give_back` when the task ends."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return bounded


def with_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    added: str,
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """``df`` with columns made batch by batch; ``make`` runs once in a task.

    ``keep`` names the columns of ``df`` that stay (all by default).
    """
    kept = list(df.columns if keep is None else keep)
    new = T.StructType.fromDDL(added)
    schema = T.StructType([df.schema[c] for c in kept] + list(new.fields))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            old = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(old + work(batch), names=names)

    return df.mapInArrow(giving_back(run), schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def pack_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted half-open ranges without overlap; touching ones are merged."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


NUMBER = re.compile("[0-9]")
