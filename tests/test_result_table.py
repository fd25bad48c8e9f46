"""The stored merge: a batch is seen whole or not at all."""
import pytest
from pyspark.sql import functions as F

from panelwright.session import work_path
from panelwright.sources.sinks import ResultTable

SERIES = [f"s/{k}" for k in range(5)]
DDL = "model string, horizon int, fold int, series_id string, mae double, error string"


def frame(spark, models, series=SERIES, mae=1.0, horizons=(3,)):
    rows = [(m, h, f, s, mae + k / 7, None) for m in models for h in horizons for f in range(3) for k, s in enumerate(series)]
    return spark.createDataFrame(rows, DDL)


def rows(df):
    return sorted(map(tuple, df.select("model", "horizon", "fold", "series_id", "mae").collect()))


@pytest.fixture
def table(spark):
    t = ResultTable(spark, work_path(spark, "table"))
    t.merge(frame(spark, ["naive_last", "drift"]))
    return t


def test_a_batch_replaces_its_models_and_keeps_the_rest(spark, table):
    old = rows(table.read())
    merged = table.merge(frame(spark, ["naive_last", "the=ta/{1}"], mae=2.0), stamp="T1")
    assert rows(merged) == rows(frame(spark, ["naive_last", "the=ta/{1}"], mae=2.0).unionByName(frame(spark, ["drift"])))
    archived = spark.read.parquet(f"{table.path}/realizations/stamp=T1")
    assert rows(archived) == [r for r in old if r[0] == "naive_last"]
    with pytest.raises(Exception):
        table.merge(frame(spark, ["drift"], mae=3.0), stamp="T1")  # an archive is never overwritten
    assert rows(table.read()) == rows(merged)


def test_a_new_model_archives_nothing(spark, table):
    table.merge(frame(spark, ["theta"]), stamp="T2")
    with pytest.raises(Exception):
        spark.read.parquet(f"{table.path}/realizations/stamp=T2")


def test_batches_on_other_series_or_of_nothing_are_refused(spark, table):
    before = rows(table.read())
    for bad in (frame(spark, ["naive_last"], SERIES[:3], 2.0), frame(spark, ["naive_last"]).where("fold < 2"), frame(spark, []).limit(0)):
        with pytest.raises(ValueError):
            table.merge(bad)
        assert rows(table.read()) == before
    with pytest.raises(ValueError, match="another type"):
        table.merge(frame(spark, ["drift"]).withColumn("mae", F.col("mae").cast("string")))


def test_an_interrupted_swap_changes_nothing(spark, table, monkeypatch):
    before = rows(table.read())

    def cut(self, entry):
        raise KeyboardInterrupt

    monkeypatch.setattr(ResultTable, "_point", cut)
    with pytest.raises(KeyboardInterrupt):
        table.merge(frame(spark, ["drift"], mae=9.0))
    monkeypatch.undo()
    assert rows(ResultTable(spark, table.path).read()) == before
    assert rows(table.merge(frame(spark, ["drift"], mae=9.0), stamp="T3")) != before  # and the batch can be merged again


def test_a_write_that_lost_rows_is_not_made_current(spark, table, monkeypatch):
    before = rows(table.read())
    real = ResultTable._verify
    monkeypatch.setattr(ResultTable, "_verify", lambda self, written, found: real(self, {**written, "n": written["n"] + 1}, found))
    with pytest.raises(ValueError, match="as it was"):
        table.merge(frame(spark, ["drift"], mae=9.0))
    assert rows(table.read()) == before


def test_explicit_keys_clear_rows_of_an_empty_batch(spark):
    t = ResultTable(spark, work_path(spark, "table"), ["model", "horizon"])
    assert t.read() is None
    t.merge(frame(spark, ["naive_last", "drift"], horizons=(1, 12)))
    cleared = spark.createDataFrame([("drift", 12), ("unknown", 1)], "model string, horizon int")
    left = t.merge(frame(spark, []).limit(0), explicit=cleared)
    assert {(r.model, r.horizon) for r in left.collect()} == {("naive_last", 1), ("naive_last", 12), ("drift", 1)}
    everything = spark.createDataFrame([("drift", 1), ("naive_last", 1), ("naive_last", 12)], "model string, horizon int")
    none = t.merge(frame(spark, []).limit(0), stamp="Z", explicit=everything)
    assert none.count() == 0 and none.columns == left.columns


def test_columns_that_come_later(spark, table):
    merged = table.merge(frame(spark, ["theta"]).withColumn("note", F.lit("new")))
    assert {(r.model, r.note) for r in merged.collect()} == {("theta", "new"), ("drift", None), ("naive_last", None)}


def test_two_batches_on_one_version(spark, table, monkeypatch):
    """The second one sees that its version is taken and raises."""
    late = ResultTable(spark, table.path)
    seen = late._pointers()
    table.merge(frame(spark, ["theta"], mae=5.0))
    won = rows(table.read())
    first = [True]
    real = ResultTable._pointers
    monkeypatch.setattr(ResultTable, "_pointers", lambda self: seen if first and first.pop() else real(self))
    monkeypatch.setattr(late, "read", lambda: None)
    with pytest.raises(RuntimeError, match="same time"):
        late.merge(frame(spark, ["drift"], mae=7.0))
    monkeypatch.undo()
    assert rows(table.read()) == won
