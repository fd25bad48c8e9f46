"""Topic features of a headline corpus."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions import text as T
from panelwright.functions.frames import union_all
from panelwright.functions.stats import pearson

Topics = Mapping[str, Sequence[str]]


def with_topics(headlines: DataFrame, topics: Topics, compound: Sequence[str] | set[str] = T.COMPOUND_ROOTS) -> DataFrame:
    return headlines.withColumns(T.topic_flags(F.col("norm"), topics, compound))


def _z_scores(counts: DataFrame) -> DataFrame:
    """z-score of ``n`` inside each outlet: sample deviation, no variation gives 0."""
    stats = counts.groupBy("domain").agg(F.avg("n").alias("_m"), F.stddev_samp("n").alias("_s"))
    z = (F.col("n") - F.col("_m")) / F.when(F.col("_s") != 0, F.col("_s"))
    return counts.join(stats, "domain").withColumn("z", F.coalesce(z, F.lit(0.0))).drop("_m", "_s")


def monthly_features(flagged: DataFrame, topics: Topics) -> DataFrame:
    """Region x month features: outlets weigh the same, whatever they publish."""
    columns = [f"t_{t}" for t in topics]
    by_outlet = flagged.groupBy("domain", "region_name", "month").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in columns]
    )
    scored = _z_scores(by_outlet)
    return scored.groupBy("region_name", "month").agg(
        F.avg("z").alias("intensity"), F.sum("n").alias("n_articles"), F.count_distinct("domain").alias("n_outlets"),
        *[F.avg(c).alias(c) for c in columns],
    )


def national_features(flagged: DataFrame, topics: Topics) -> DataFrame:
    """Month features over all articles, with the mean outlet z-score. One pass over the corpus."""
    columns = [f"t_{t}" for t in topics]
    by_outlet = flagged.groupBy("domain", "month").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("bigint")).alias(c) for c in columns]
    )
    scored = _z_scores(by_outlet)
    return scored.groupBy("month").agg(
        F.sum("n").alias("n_articles"), F.count_distinct("domain").alias("n_outlets"),
        *[(F.sum(c) / F.sum("n")).alias(c) for c in columns], F.avg("z").alias("intensity"),
    )


def _plain(roots: Sequence[str]) -> str:
    return "|".join(roots)


def dictionary_diff(headlines: DataFrame, old: Topics, new: Topics, compound: Sequence[str] | set[str] = T.COMPOUND_ROOTS) -> DataFrame:
    """Per topic: hits before and after, removed, added, and the correlation of monthly shares."""
    pairs = F.array(*[
        F.struct(
            F.lit(t).alias("topic"), F.coalesce(F.col("norm").rlike(_plain(old[t])), F.lit(False)).alias("old"),
            F.coalesce(F.col("norm").rlike(T.topic_pattern(roots, compound)), F.lit(False)).alias("new"),
        )
        for t, roots in new.items()
    ])
    count = lambda c: F.count(F.when(c, 1))
    monthly = headlines.select("month", F.inline(pairs)).groupBy("topic", "month").agg(
        count(F.col("old")).alias("before"), count(F.col("new")).alias("after"), count(F.col("old") & ~F.col("new")).alias("removed"),
        count(~F.col("old") & F.col("new")).alias("added"), F.count(F.lit(1)).alias("n"),
    )
    out = monthly.groupBy("topic").agg(
        *[F.sum(c).alias(c) for c in ("before", "after", "removed", "added")],
        pearson(F.col("before") / F.col("n"), F.col("after") / F.col("n")).alias("share_corr"),
    )
    return out.withColumn("removed_pct", F.col("removed") / F.when(F.col("before") > 0, F.col("before")) * 100)


def removed_words(headlines: DataFrame, old: Topics, new: Topics, compound: Sequence[str] | set[str] = T.COMPOUND_ROOTS, top: int = 5) -> DataFrame:
    """Most frequent words an old pattern matched and the new one does not.

    Words are counted by document first, so each pattern is tried once per distinct word.
    """
    words = F.array_distinct(F.regexp_extract_all("norm", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    counts = headlines.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    verdicts = F.filter(
        F.array(*[
            F.struct(F.lit(t).alias("topic"), (F.col("word").rlike(_plain(old[t])) & ~F.col("word").rlike(T.topic_pattern(r, compound))).alias("gone"))
            for t, r in new.items()
        ]),
        lambda v: v["gone"],
    )
    gone = counts.select("word", "n", F.explode(F.transform(verdicts, lambda v: v["topic"])).alias("topic"))
    # the top of each hash slice first, then of the topic: no task sees a whole vocabulary
    near = Window.partitionBy("topic", "_b").orderBy(F.desc("n"), "word")
    local = gone.withColumn("_b", F.pmod(F.xxhash64("word"), F.lit(64))).withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= top)
    far = Window.partitionBy("topic").orderBy(F.desc("n"), "word")
    return local.withColumn("place", F.row_number().over(far)).where(F.col("place") <= top).select("topic", "word", "n", "place")


def reproduction_gap(fresh: DataFrame, stored: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Largest absolute difference per column, and rows on one side only."""
    a = fresh.select(*keys, F.lit(1).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = stored.select(*keys, F.lit(1).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = a.join(b, list(keys), "full")
    return both.agg(
        *[F.max(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}"))).alias(f"gap_{c}") for c in columns],
        F.count(F.when(F.col("_a").isNull(), 1)).alias("n_only_stored"), F.count(F.when(F.col("_b").isNull(), 1)).alias("n_only_fresh"),
    )


def misaligned(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """``problem, n``: columns of another name or type, and rows that differ outside the topic dictionary; no rows: aligned."""
    columns = sorted(set(fresh.dtypes) ^ set(stored.dtypes))
    spark = fresh.sparkSession
    if columns or fresh.columns != stored.columns:
        return spark.createDataFrame([("columns", len({c for c, _ in columns}))], "problem string, n long")
    keys = [c for c in stored.columns if not c.startswith("t_")]
    tagged = fresh.select(*keys, F.lit(1).alias("_s")).unionByName(stored.select(*keys, F.lit(-1).alias("_s")))
    off = tagged.groupBy(*keys).agg(F.sum("_s").alias("_d")).where("_d <> 0")
    side = F.when(F.col("_d") > 0, F.lit("rows only fresh")).otherwise(F.lit("rows only stored"))
    return off.groupBy(side.alias("problem")).agg(F.sum(F.abs("_d")).alias("n"))


def check_aligned(fresh: DataFrame, stored: DataFrame) -> None:
    """Column names and types must match, and so must every column that is not a topic."""
    problems = misaligned(fresh, stored).collect()  # at most two rows
    if problems:
        text = "; ".join(f"{p['problem']}: {p['n']}" for p in sorted(problems))
        raise ValueError(f"the table is not aligned with the stored one: {text}; nothing was written")


def sample_per_month(rows: DataFrame, key: str, per_month: int, seed: int) -> DataFrame:
    """The same number of rows from every month by hash order, cut first inside hash slices."""
    hashed = rows.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_b", F.pmod(F.col("_h"), F.lit(64)))
    near = Window.partitionBy("month", "_b").orderBy("_h", key)
    far = Window.partitionBy("month").orderBy("_h", key)
    local = hashed.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= per_month)
    return local.withColumn("_r", F.row_number().over(far)).where(F.col("_r") <= per_month).drop("_h", "_b", "_r")


DATED = r"^https?://[^\"]*?/(\d{4})/(\d{2})/(\d{2})/"


def _host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]*)", 1)


def archive_links(pages: DataFrame, domain: str) -> DataFrame:
    """Dated article links of the wanted month of each page (``page_id, html, year, month``).

    The title comes from the first anchor of the link with plain text, else from the slug. A link counts once
    per page, and only on the given domain. Links and anchors meet as rows, so a page with many of both stays linear.
    """
    links = F.regexp_extract_all("html", F.lit(r'href="(https?://[^"]*?/\d{4}/\d{2}/\d{2}/[^"]+?)"'), F.lit(1))
    anchor = r'<a[^>]+href="([^"]+)"[^>]*>([^<]{15,300})</a>'
    urls = F.regexp_extract_all("html", F.lit(anchor), F.lit(1))
    titles = F.regexp_extract_all("html", F.lit(anchor), F.lit(2))
    entry = lambda url, title, link: F.struct(url.alias("url"), title.alias("t"), F.lit(link).alias("link"))
    found = F.concat(
        F.transform(F.array_distinct(links), lambda u: entry(u, F.lit(None).cast("string"), True)),
        F.transform(F.arrays_zip(urls.alias("u"), titles.alias("t")), lambda a: entry(a["u"], a["t"], False)))
    page = ["page_id", "year", "month", "page"]
    rows = pages.select("page_id", "year", "month", F.xxhash64("html").alias("page"), F.posexplode(found).alias("i", "e"))
    each = rows.groupBy(*page, "e.url").agg(F.max("e.link").alias("link"), F.min_by("e.t", F.when(~F.col("e.link"), F.col("i"))).alias("t")).where("link")
    stamp = [F.regexp_extract("url", DATED, i) for i in (1, 2, 3)]
    out = each.withColumn("_t", F.trim("t")).where(
        _host(F.col("url")).contains(domain) & (stamp[0].cast("int") == F.col("year")) & (stamp[1].cast("int") == F.col("month")))
    title = F.when(F.length("_t") > 0, F.col("_t")).otherwise(T.title_from_slug(F.col("url")))
    return out.select("page_id", "url", title.alias("title"), F.concat_ws("-", *stamp).alias("date"))


def sitemap_links(maps: DataFrame, domain: str) -> DataFrame:
    """Article links of the wanted month of each sitemap (``page_id, xml, year, month``).

    Each ``<url>`` block gives its ``<loc>``, dated by ``<lastmod>`` or else by the address; a block without
    either is left out. An address counts once per map, by its first block of the month; the title comes from the slug.
    """
    blocks = F.regexp_extract_all("xml", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    rows = maps.select("page_id", "year", "month", F.xxhash64("xml").alias("page"), F.posexplode(blocks).alias("i", "b"))
    rows = rows.withColumn("url", F.regexp_extract("b", r"<loc>\s*(https?://[^<\s]+)\s*</loc>", 1)).where("url <> ''")
    tag = r"<lastmod>\s*(\d{4})-(\d{2})-(\d{2})"
    dated = F.regexp_extract("b", tag, 1) != ""
    part = [F.when(dated, F.regexp_extract("b", tag, i)).otherwise(F.regexp_extract("url", DATED, i)) for i in (1, 2, 3)]
    rows = rows.where(_host(F.col("url")).contains(domain)).select(
        "page_id", "page", "year", "month", "url", "i", *[p.alias(n) for p, n in zip(part, ("_y", "_m", "_d"))])
    here = rows.where((F.col("_y") != "") & (F.col("_y").cast("int") == F.col("year")) & (F.col("_m").cast("int") == F.col("month")))
    first = here.groupBy("page_id", "page", "year", "month", "url").agg(F.min_by(F.concat_ws("-", "_y", "_m", "_d"), "i").alias("date"))
    return first.select("page_id", "url", T.title_from_slug(F.col("url")).alias("title"), "date")


def headline_vs_body(bodies: DataFrame, topics: Topics, budget: int, excluded_domain: str, compound: Sequence[str] | set[str] = T.COMPOUND_ROOTS) -> DataFrame:
    """Topic shares by headline and by headline with an equal budget of body text.

    Bodies shorter than the budget and one outlet are left out; the comparison is of equal
    text lengths, which is the operator's rule and not a sample.
    """
    rows = bodies.where((F.col("domain") != excluded_domain) & (F.length("body") >= budget))
    title = T.transliterate(T.repair_encoding(F.col("title")))
    both = T.transliterate(T.repair_encoding(F.concat_ws(" ", "title", F.substring("body", 1, budget))))
    rows = rows.select(title.alias("_t"), both.alias("_b"))
    hits = F.array(*[
        F.struct(
            F.lit(t).alias("topic"), F.coalesce(F.col("_t").rlike(T.topic_pattern(r, compound)), F.lit(False)).alias("a"),
            F.coalesce(F.col("_b").rlike(T.topic_pattern(r, compound)), F.lit(False)).alias("b"),
        )
        for t, r in topics.items()
    ])
    a, b = F.col("a"), F.col("b")
    out = rows.select(F.inline(hits)).groupBy("topic").agg(
        F.avg(a.cast("double")).alias("share_title"), F.avg(b.cast("double")).alias("share_body"),
        F.count(F.when(~a & b, 1)).alias("n_added"), F.count(F.when(~a, 1)).alias("n_missed"), F.count(F.lit(1)).alias("n_articles"),
    )
    return out.withColumn("growth", F.col("share_body") / F.when(F.col("share_title") > 0, F.col("share_title"))).withColumn(
        "share_added", F.col("n_added") / F.when(F.col("n_missed") > 0, F.col("n_missed"))
    )


def share_residual_corr(sources: Mapping[str, DataFrame], residuals: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Correlation of monthly topic shares with aggregate residuals: topic x source x step.

    ``sources`` map a label to ``month, t_*``; a control series goes in as its own topic.
    """
    parts = []
    for label, frame in sources.items():
        present = [c for c in topics if c in frame.columns]
        cells = F.inline(F.array(*[F.struct(F.lit(c).alias("topic"), F.col(c).cast("double").alias("x")) for c in present]))
        parts.append(frame.select("month", F.lit(label).alias("source"), cells))
    rows = union_all(parts).join(residuals.select("month", "step", "residual"), "month")
    return rows.groupBy("source", "topic", "step").agg(
        pearson("x", "residual").alias("corr"), F.count(F.when(F.col("x").isNotNull(), 1)).alias("n_months")
    )
