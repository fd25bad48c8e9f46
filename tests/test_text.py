import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import text as T
from panelwright.operators import association as S, news as N

TRUTH = [
    ("ceny", "ceny", True), ("ceny", "centr", False), ("ceny", "procent", False), ("kredit", "gosbank", True), ("kredit", "banket", False),
    ("kredit", "dolgovaja", True), ("kredit", "dolgo", False), ("kredit", "dolgovremennyj", False), ("zanjatost", "rabota", True),
    ("zanjatost", "otrabotal", False), ("proizvodstvo", "neftezavod", True), ("torgovlja", "supermagazin", True), ("dkp", "czb", True),
    ("dkp", "czbank", False), ("dkp", "gazoreguljator", False), ("dkp", "megareguljator", True),
]


def test_topic_truth_table(spark):
    df = spark.createDataFrame([(t, w) for t, w, _ in TRUTH], "topic string, norm string")
    flagged = N.with_topics(df, T.NATIONAL_TOPICS).collect()
    for row, (topic, word, _) in zip(sorted(flagged, key=lambda r: (r["topic"], r["norm"])), sorted(TRUTH)):
        # Java and Python agree on the pattern
        assert row[f"t_{topic}"] == (re.search(T.topic_pattern(T.NATIONAL_TOPICS[topic]), word) is not None)
    got = {(r["topic"], r["norm"]): r[f"t_{r['topic']}"] for r in flagged}
    for topic, word, expected in TRUTH:
        assert got[topic, word] is expected, (topic, word)


def test_repair_and_transliterate(spark):
    good = "Ставка ЦБ: ключевая, щука"
    broken = good.encode("utf-8").decode("latin-1")
    texts = [good, broken, "plain text", "café größe", "смешан Ñ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = {r["i"]: r for r in df.select("i", T.repair_encoding(F.col("t")).alias("r"), T.transliterate(F.col("t")).alias("n")).collect()}
    assert [rows[i]["r"] for i in range(5)] == [good, good, "plain text", "café größe", "смешан Ñ"]
    assert rows[0]["n"] == "stavka czb: kljuchevaja, shhuka"


def test_page_text(spark):
    page = "<script>var t='<p>no</p>';</script><p>short</p><P class='x'>A <b>long</b> paragraph &amp; more &#39;quoted&#39;   words here, indeed</P>"
    got = spark.createDataFrame([(page,)], "h string").select(T.page_text(F.col("h")).alias("t"), T.page_text(F.col("h"), 10).alias("c")).first()
    assert got["t"] == "A long paragraph & more 'quoted' words here, indeed" and got["c"] == "A long par"


def test_archive_links(spark):
    html = ('<a href="https://n.ru/2024/08/05/first-story-12/"><h3>x</h3></a><a href="https://n.ru/2024/08/06/second">A proper title of it</a>'
            '<a href="https://n.ru/2024/09/06/later">A later title of it</a><a href="https://other.ru/2024/08/06/a">Another site title</a>'
            '<a href="https://n.ru/2024/08/06/second">A proper title of it</a>')
    df = spark.createDataFrame([(1, 2024, 8, html)], "page_id int, year int, month int, html string")
    got = {(r["title"], r["date"]) for r in N.archive_links(df, "n.ru").collect()}
    assert got == {("first story", "2024-08-05"), ("A proper title of it", "2024-08-06")}


def test_monthly_and_national_weights(spark):
    rows = [("u1", "a", "r", "2024-01-01", True), ("u2", "a", "r", "2024-01-01", False), ("u3", "b", "r", "2024-01-01", True), ("u4", "a", "r", "2024-02-01", False)]
    df = spark.createDataFrame(rows, "url string, domain string, region_name string, month string, t_x boolean").withColumn("month", F.to_date("month"))
    monthly = {str(r["month"])[:7]: r for r in N.monthly_features(df, {"x": []}).collect()}
    national = {str(r["month"])[:7]: r for r in N.national_features(df, {"x": []}).collect()}
    assert monthly["2024-01"]["t_x"] == pytest.approx(0.75)  # outlets weigh the same
    assert national["2024-01"]["t_x"] == pytest.approx(2 / 3)  # articles weigh the same
    z = (2 - 1.5) / np.std([2, 1], ddof=1)
    assert national["2024-01"]["intensity"] == pytest.approx(z / 2)


def test_exact_permutation_by_enumeration(spark):
    from itertools import combinations

    rng = np.random.default_rng(9)
    x = rng.normal(size=10)
    df = spark.createDataFrame([(t, float(v)) for t, v in enumerate(x)], "t int, f double")
    got = S.exact_permutation(df, ["f"], [2, 5, 7], lags=(0,)).first()
    gap = lambda idx: abs(x[list(idx)].mean() - np.delete(x, list(idx)).mean())
    want = np.mean([gap(c) >= gap((2, 5, 7)) - 1e-12 for c in combinations(range(10), 3)])
    assert got["p"] == pytest.approx(want) and got["n_subsets"] == 120


@pytest.mark.parametrize("n, events, lags", [(10, [2, 5, 7, 8, 9], (0, 1, 2)), (11, [4], (0, 3)), (7, [0, 6], (0,)), (4, [1, 2, 3], (0, 1))])
def test_exact_permutation_counts_subsets_without_writing_them(spark, n, events, lags):
    from itertools import combinations

    rng, k = np.random.default_rng(n), len(events)
    values = {"a": rng.normal(size=n), "tied": rng.integers(0, 3, n).astype(float), "flat": np.ones(n)}
    df = spark.createDataFrame([(t, *(float(v[t]) for v in values.values())) for t in range(n)], "t int, a double, tied double, flat double")
    got = {(r.feature, r.lag): r for r in S.exact_permutation(df, list(values), events, lags).collect()}
    assert set(got) == {(f, lag) for f in values for lag in lags if min(events) >= lag}
    for (f, lag), row in got.items():
        x = values[f]
        gap = lambda idx: abs(x[list(idx)].mean() - np.delete(x, list(idx)).mean())
        observed, sets = gap([e - lag for e in events]), list(combinations(range(n), k))
        assert row.n_subsets == len(sets) and row.p == pytest.approx(np.mean([gap(c) >= observed - 1e-12 for c in sets]))
        assert row.n_months == n and row.inside == pytest.approx(x[[e - lag for e in events]].mean())


def test_exact_permutation_of_few_months_and_missing_values(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, 2.0, None), (2, 4.0, 1.0)], "t int, a double, b double")
    rows = S.exact_permutation(df, ["a", "b"], [2], (0,)).collect()
    assert [(r.feature, r.n_months, r.n_subsets) for r in rows] == [("a", 3, 3)] and rows[0].p == pytest.approx(1 / 3)
    assert S.exact_permutation(df.limit(0), ["a"], [2], (0,)).count() == 0


def test_permutation_tests_see_a_signal(spark):
    rng = np.random.default_rng(11)
    rows = [(f"r{r}", f"2024-{m:02d}-01", float(v), float(2 * v + 0.1 * rng.normal()), float(rng.normal())) for m in range(1, 7) for r, v in enumerate(rng.normal(size=8))]
    df = spark.createDataFrame(rows, "region string, month string, x double, y double, z double").withColumn("month", F.to_date("month"))
    df = df.withColumn("feature", F.lit("f")).withColumn("lag", F.lit(0))
    strong = S.within_month_effect(df, "x", "y", n_permutations=200).first()
    weak = S.within_month_effect(df.drop("y").withColumnRenamed("z", "y"), "x", "y", n_permutations=200).first()
    assert strong["slope"] == pytest.approx(2, abs=0.1) and strong["p"] == pytest.approx(1 / 201)
    assert weak["p"] > 0.02


def test_titles_of_links_come_from_the_first_anchor(spark):
    from panelwright.operators import news as N

    long = "a title of more than fifteen letters"
    link = "https://news.example.com/2024/02/15/some-story-7"
    html = f'<a href="{link}">{long} one</a> <a href="{link}">{long} two</a><a href="https://news.example.com/2024/02/16/other_story">short</a><a href="https://x.org/2024/02/15/foreign">{long}</a>'
    pages = spark.createDataFrame([(1, html, 2024, 2), (2, html, 2024, 3), (3, None, 2024, 2), (4, "", 2024, 2)], "page_id long, html string, year int, month int")
    rows = sorted(tuple(r) for r in N.archive_links(pages, "example.com").collect())
    assert rows == [(1, link, f"{long} one", "2024-02-15"), (1, "https://news.example.com/2024/02/16/other_story", "other story", "2024-02-16")]


def test_sitemap_blocks(spark):
    from panelwright.operators import news as N

    block = lambda loc, tag="": f"<url>\n<loc> {loc} </loc>{tag}</url>"
    site = "https://example.com/"
    xml = "<urlset>" + block(site + "a-b_c-12", "<lastmod> 2024-02-03T00:00</lastmod>") + block(site + "2024/02/09/dated") + block(site + "undated") + block(site + "twice", "<lastmod>2024-01-01</lastmod>") + block(
        site + "twice", "<lastmod>2024-02-20</lastmod>") + block(site + "twice", "<lastmod>2024-02-21</lastmod>") + block("https://other.org/x", "<lastmod>2024-02-01</lastmod>") + "<url></url></urlset>"
    maps = spark.createDataFrame([(1, xml, 2024, 2), (2, "no map", 2024, 2), (3, None, 2024, 2)], "page_id long, xml string, year int, month int")
    rows = sorted(tuple(r) for r in N.sitemap_links(maps, "example.com").collect())
    assert rows == [(1, site + "2024/02/09/dated", "dated", "2024-02-09"), (1, site + "a-b_c-12", "a b c", "2024-02-03"), (1, site + "twice", "twice", "2024-02-20")]


def test_a_table_that_is_not_aligned_is_refused(spark):
    from panelwright.operators import news as N

    a = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.25, 0.2)], "month int, intensity double, t_x double")
    N.check_aligned(a, a.withColumn("t_x", F.col("t_x") + 1))
    for other in (a.where("month = 1"), a.withColumn("intensity", F.col("intensity") + 1), a.drop("t_x"), a.withColumn("month", F.col("month").cast("long"))):
        with pytest.raises(ValueError):
            N.check_aligned(a, other)
