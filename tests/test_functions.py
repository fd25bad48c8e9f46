import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import arrays as A, student_t
from panelwright.functions.quantiles import exact_quantiles
from panelwright.functions.ranking import global_rank
from panelwright.functions.stats import pearson


def test_exact_quantiles_small_and_bracketed(spark):
    rng = np.random.default_rng(1)
    small = rng.normal(size=37)
    # a third of the large group is one value
    large = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25)])
    rows = [("s", float(v)) for v in small] + [("l", float(v)) for v in large] + [("l", None), ("n", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    out = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, accuracy=500).collect()}
    assert set(out) == {"s", "l"}
    for name, values in (("s", small), ("l", large)):
        for column, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)):
            assert out[name][column] == pytest.approx(np.quantile(values, p), abs=1e-12)
        assert out[name]["n"] == len(values)


def test_exact_quantiles_without_keys(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert exact_quantiles(df, [], "v", {"q": 0.9}).first()["q"] == 90.0


def test_global_rank_orders_all_rows_with_ties(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") % 97).cast("double")).alias("v"))
    rows = global_rank(df.repartition(7), "v", "id", slices=16).orderBy("rank0").collect()
    assert [r["rank0"] for r in rows] == list(range(3000))
    assert all(a["v"] <= b["v"] for a, b in zip(rows, rows[1:]))
    again = global_rank(df.repartition(3), "v", "id", slices=16).orderBy("rank0").collect()
    assert [r["id"] for r in rows] == [r["id"] for r in again]


def test_array_helpers(spark):
    df = spark.createDataFrame([([1.0, 4.0, 2.0, 8.0],), ([3.0],), ([],)], "a array<double>")
    a = F.col("a")
    rows = df.select(A.median(a).alias("m"), A.mean(a).alias("u"), A.diffs(a).alias("d"), A.variance_pop(a).alias("v")).collect()
    assert rows[0]["m"] == 3.0 and rows[0]["u"] == 3.75 and rows[0]["d"] == [3.0, -2.0, 6.0]
    assert rows[0]["v"] == pytest.approx(np.var([1, 4, 2, 8]))
    assert rows[1]["m"] == 3.0 and rows[1]["d"] == []
    assert rows[2]["m"] is None and rows[2]["u"] is None


def test_pearson_without_variation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(pearson("x", "y").alias("r")).first()["r"] is None


@pytest.mark.parametrize("p,df,value", [(0.975, 1, 12.7062047), (0.975, 2, 4.30265273), (0.975, 8, 2.30600414), (0.95, 30, 1.69726089)])
def test_t_quantile_against_the_printed_table(p, df, value):
    assert student_t.quantile(p, df) == pytest.approx(value, abs=1e-7)
    assert student_t.two_sided_p(value, df) == pytest.approx(2 * (1 - p), abs=1e-8)
