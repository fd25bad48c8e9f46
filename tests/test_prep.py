from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import prep, regions as geo
from panelwright.protocol import Calendar, dense_origins, rolling_origin
from panelwright.sources import readers

CAL = Calendar(date(2020, 1, 1), 12)


def panel(spark, patterns):
    """``X`` is a known month; values are 10 * (t + 1)."""
    rows = [(k, CAL.month(t), 10.0 * (t + 1)) for k, p in patterns.items() for t, c in enumerate(p) if c == "X"]
    return spark.createDataFrame(rows, "series_id string, month date, value double")


PATTERNS = {
    "full": "XXXXXXXXXXXX",
    "two": "XX..XXXXXXXX",
    "three": "XX...XXXXXXX",
    "late": ".XXXXXXXXXXX",
    "early": "XXXXXXXXXXX.",
    "middle": "..XX.XX.XX..",
}


def test_keep_rule_and_interpolation(spark):
    df = panel(spark, PATTERNS)
    arrays = {r["series_id"]: r for r in prep.clean_arrays(df, ["series_id"], CAL, keep_all=True).collect()}
    assert {k: r["kept"] for k, r in arrays.items()} == {
        "full": True, "two": True, "three": False, "late": False, "early": False, "middle": False}
    assert arrays["two"]["y"] == [10.0 * (t + 1) for t in range(12)]
    assert arrays["two"]["raw"][2] is None
    assert arrays["middle"]["y"][0] is None and arrays["middle"]["y"][4] == 50.0
    kept = prep.clean_panel(df, ["series_id"], CAL)
    assert {r["series_id"] for r in kept.select("series_id").distinct().collect()} == {"full", "two"}
    assert kept.where("filled").count() == 2


def test_long_and_array_forms_agree(spark):
    df = panel(spark, PATTERNS)
    dense = prep.densify(df, ["series_id"], CAL)
    long = {(r["series_id"], r["t"]): r["y"] for r in prep.interpolate_inside(dense, ["series_id"]).collect()}
    for r in prep.clean_arrays(df, ["series_id"], CAL, keep_all=True).collect():
        assert r["y"] == [long[r["series_id"], t] for t in range(12)]


def test_classify_dropped(spark):
    profile = prep.series_profile(prep.densify(panel(spark, PATTERNS), ["series_id"], CAL), ["series_id"], CAL)
    got = {r["series_id"]: (r["reason"], r["at_month"]) for r in prep.classify_dropped(profile, CAL).collect()}
    assert got == {
        "three": ("long gap", None), "late": ("starts late", date(2020, 2, 1)),
        "early": ("ends early", date(2020, 11, 1)), "middle": ("middle only", date(2020, 10, 1))}


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_rebuild_entities_does_not_depend_on_blocks_or_partitions(spark, block):
    blocks = [("a", 1, 5), ("a", 3, 4), ("b", 1, 3), ("a", 1, 2)]
    rows, pos = [], 0
    for name, first, last in blocks:
        for m in range(first, last + 1):
            rows.append((name, "all", date(2020, m, 1), pos))
            pos += 1
    df = spark.createDataFrame(rows, "mo string, category string, month date, pos long").repartition(4, "pos")
    got = prep.rebuild_entities(df, "pos", block_rows=block).orderBy("pos").collect()
    pdf = pd.DataFrame(rows, columns=["mo", "category", "month", "pos"])
    start = pdf.groupby(["mo", "category"])["month"].transform(lambda s: (s <= s.shift(1)) | s.shift(1).isna())
    number = start.groupby([pdf["mo"], pdf["category"]]).cumsum().astype(int)
    assert [r["entity_no"] for r in got] == number.tolist()
    assert {r["series_id"] for r in got} == {"a #1", "a #2", "a #3", "b"}


def test_stratified_sample_counts_and_determinism(spark):
    levels = spark.range(205).select(F.col("id").cast("string").alias("series_id"), F.col("id").cast("double").alias("level"))
    first = prep.stratified_sample(levels, "series_id", "level", 43, seed=5)
    again = prep.stratified_sample(levels.repartition(6), "series_id", "level", 43, seed=5)
    assert first.count() == 43
    assert {r["series_id"] for r in first.collect()} == {r["series_id"] for r in again.collect()}
    assert all(r["n"] >= 4 for r in first.groupBy("stratum").agg(F.count("*").alias("n")).collect())
    assert prep.stratified_sample(levels, "series_id", "level", None, seed=5).count() == 205


def test_bench_sample(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("series_id"))
    got = prep.bench_sample(df, "series_id", 7, 1).collect()
    assert sorted(r["ordinal"] for r in got) == list(range(7))
    with pytest.raises(ValueError):
        prep.bench_sample(df, "series_id", 0, 1)


def test_read_panel_checks_and_coerces(spark):
    raw = spark.createDataFrame(
        [("2020-01-15", "1.5", "m", "c", "M", "u"), ("2020-02-15", "oops", "m", "c", "M", "u"), ("2020-02-15", "3", "m", "c", "Y", "u")],
        "period string, value string, mo string, category string, freq string, unit string").withColumn("period", F.to_date("period"))
    got = readers.read_panel(raw, "M").orderBy("month").collect()
    assert [(r["month"], r["value"]) for r in got] == [(date(2020, 1, 1), 1.5), (date(2020, 2, 1), None)]
    with pytest.raises(ValueError, match="freq"):
        readers.read_panel(raw.drop("freq"), "M")


def test_rolling_origin():
    assert [(f.train_end, f.test_end) for f in rolling_origin(24, 3, 3)] == [(15, 18), (18, 21), (21, 24)]
    assert [f.train_end for f in dense_origins(24, 3)] == list(range(12, 22))
    for bad in ((24, 0, 1), (24, 3, 0), (24, 6, 3)):
        with pytest.raises(ValueError):
            rolling_origin(*bad)


def test_regions_homonyms_versions_and_retype(spark):
    rows = [
        ("A район", "2015", "2019", 1, "old"), ("A  район", "2020", "2030", 2, "new A"),
        ("B район", "2020", "2023", 3, "B1"), ("B район", "2024", "2030", 3, "B2"),
        ("C район", "2020", "2030", 4, "C4"), ("C район", "2020", "2030", 5, "C5"),
        ("D муниципальный район", "2020", "2030", 6, "D"),
    ]
    d = spark.createDataFrame(rows, "municipal_district_name string, year_from string, year_to string, territory_id long, region_name string")
    for c in ("region_code", "oktmo", "municipal_district_type"):
        d = d.withColumn(c, F.lit("x"))
    names = ["A район", " B   район", "C район", "D муниципальный округ", "E"]
    ent = spark.createDataFrame([(n,) for n in names], "mo string")
    joined = geo.attach_regions(ent, readers.read_dictionary(d, 2023, 2024))
    got = {r["mo"]: (r["region_name"], r["n_candidates"]) for r in joined.collect()}
    assert got == {"A район": ("new A", 1), " B   район": ("B2", 1), "C район": (None, 2), "D муниципальный округ": ("D", 0), "E": (None, 0)}
    assert tuple(geo.join_report(joined).first()) == (5, 3, 1, 1)
