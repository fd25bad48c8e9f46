"""Registered queries: headline corpus, topic features, association tests."""
from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from panelwright.functions import text as T
from panelwright.operators import association as S, features as X, longseries as L, news as N, realtime as R, two_stage as TS
from panelwright.plans import inputs as I, oracle as O
from panelwright.plans.break_queries import CUSUM, OFF, cusum_breaks, with_sql
from panelwright.plans.factor_queries import HZ, LONG, PLAN3, PLANH, chosen
from panelwright.plans.oracle import r
from panelwright.plans.registry import query
from panelwright.plans.rounding import rounded
from panelwright.session import cut_lineage, work_path, written_once
from panelwright.sources import readers

# The invented text has none of the real roots, so the queries use roots it does have. They
# exercise the same pattern rules: word starts, compound roots, own boundaries, lookaheads.
TOPICS = {
    "motion": ["tion(?!s)", "ment"],
    "place": ["whou", "und", "thor"],
    "speech": ["que(?!d)", "\\bles\\b"],
    "heit": ["heit", "schen"],
}
COMPOUND = {"tion(?!s)", "heit"}
OLD = {"motion": ["tion", "ment"], "place": ["whou", "und", "thor"], "speech": ["que", "les"], "heit": ["heit", "schen"]}
# the same rules without lookarounds, for the SQL engine
START = "(^|[^a-z])"
NEW_SQL = {
    "motion": f"tion([^s]|$)|{START}ment",
    "place": f"{START}whou|{START}und|{START}thor",
    "speech": f"{START}que([^d]|$)|(^|[^0-9A-Za-z_])les([^0-9A-Za-z_]|$)",
    "heit": f"heit|{START}schen",
}
OLD_SQL = {t: "|".join(v) for t, v in OLD.items()}
COLUMNS = [f"t_{t}" for t in TOPICS]
FIRST = date(1999, 8, 1)

# documents as headlines: every fifth url is a repeat of the one before, one date in fifty is broken
RAW = """
raw AS (
  SELECT doc_id AS pos, 'http://' || source || '.example.org/' || CAST(floor(doc_id * 4 / 5) AS BIGINT) AS url, text AS title,
         CASE WHEN doc_id % 50 = 7 THEN 'unknown' ELSE CAST(CAST(DATE '1999-08-01' + to_months(CAST(doc_id % 24 AS INTEGER)) AS DATE) AS VARCHAR) END AS date,
         'NATION_' || (doc_id * 7) % 20 AS region_name, source AS domain FROM documents),
heads AS (
  SELECT url, title, CAST(date AS DATE) AS month, region_name, domain, lower(title) AS norm FROM (
    SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1) WHERE date <> 'unknown')"""
FLAGGED = RAW + ",\nflagged AS (SELECT *, " + ", ".join(f"regexp_matches(norm, '{p}') AS t_{t}" for t, p in NEW_SQL.items()) + " FROM heads)"


def raw_headlines(spark, sf):
    doc = F.col("doc_id")
    month = F.add_months(F.lit(FIRST), (doc % 24).cast("int"))
    return I.table(spark, sf, "documents").select(
        doc.alias("pos"),
        F.concat(F.lit("http://"), "source", F.lit(".example.org/"), F.floor(doc * 4 / 5).cast("string")).alias("url"),
        F.col("text").alias("title"),
        F.when(doc % 50 == 7, "unknown").otherwise(month.cast("string")).alias("date"),
        F.concat(F.lit("NATION_"), ((doc * 7) % 20).cast("string")).alias("region_name"),
        F.col("source").alias("domain"),
    )


def headlines(spark, sf):
    return readers.read_headlines(raw_headlines(spark, sf))


def flagged(spark, sf):
    return N.with_topics(headlines(spark, sf), TOPICS, COMPOUND)


def monthly(spark, sf):
    return N.monthly_features(flagged(spark, sf), TOPICS)


def national(spark, sf):
    return written_once("national", lambda: N.national_features(flagged(spark, sf), TOPICS))


# --- sources ----------------------------------------------------------------------------

@query("src_5_read_headlines", f"WITH {RAW} SELECT url, month, region_name, domain, md5(title) AS title_hash, md5(norm) AS norm_hash FROM heads")
def read_headlines(spark, sf):
    return headlines(spark, sf).select("url", "month", "region_name", "domain", F.md5("title").alias("title_hash"), F.md5("norm").alias("norm_hash"))


@query("src_5_scan_headlines", "SELECT source AS domain, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1")
def scan_headlines(spark, sf):
    path = work_path(spark, "headlines")
    raw_headlines(spark, sf).select("url", "title", "date", "region_name", "domain").write.json(path)
    return readers.scan_headlines(spark, path).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("title")).cast("bigint").alias("n_chars"))


SEPARATED = "'line' || chr(8232) || text || chr(133) || 'end'"


@query("src_6_read_bodies", f"SELECT doc_id, md5({SEPARATED}) AS body_hash FROM documents")
def read_bodies(spark, sf):
    """Bodies that hold Unicode line separators come back whole."""
    path = work_path(spark, "bodies")
    body = F.concat(F.lit("line "), "text", F.lit("\u0085end"))
    doc = I.table(spark, sf, "documents")
    doc.select(F.col("doc_id").cast("string").alias("url"), F.col("source").alias("domain"), F.lit("2024-01").alias("month"),
               F.lit("").alias("title"), body.alias("body")).write.json(path)
    return readers.read_bodies(spark, path).select(F.col("url").cast("bigint").alias("doc_id"), F.md5("body").alias("body_hash"))


# --- text -------------------------------------------------------------------------------

LATIN, CYR = "abvgdezijklmnoprstuf", "абвгдезийклмнопрстуф"


@query("txt_1_repair_encoding", f"""
SELECT doc_id, md5(CASE WHEN doc_id % 3 = 2 THEN text ELSE translate(text, '{LATIN}', '{CYR}') END) AS repaired,
       doc_id % 3 = 0 AS was_broken FROM documents WHERE doc_id % 3 = 2 OR translate(text, '{LATIN}', '{CYR}') <> text""")
def repair(spark, sf):
    """A third of the texts is broken Cyrillic, a third sound Cyrillic, a third left in Latin."""
    doc = I.table(spark, sf, "documents")
    cyrillic = F.translate("text", LATIN, CYR)
    kind = F.col("doc_id") % 3
    # Latin-1 reading of UTF-8 bytes, byte for byte
    broken = F.decode(F.encode(cyrillic, "UTF-8"), "ISO-8859-1")
    seen = F.when(kind == 0, broken).when(kind == 1, cyrillic).otherwise(F.col("text"))
    rows = doc.where((kind == 2) | (cyrillic != F.col("text"))).select("doc_id", seen.alias("seen"))
    return rows.select("doc_id", F.md5(T.repair_encoding(F.col("seen"))).alias("repaired"), (F.col("doc_id") % 3 == 0).alias("was_broken"))


_MANY = [(k, v) for k, v in T.TRANSLIT.items() if len(v) > 1]
_ONE = "".join(k for k, v in T.TRANSLIT.items() if len(v) == 1)
_TO = "".join(v for v in T.TRANSLIT.values() if len(v) == 1)
_SQL = f"translate(lower(x), '{_ONE}', '{_TO}')"
for _k, _v in (("ъ", ""), ("ь", ""), *_MANY):
    _SQL = f"replace({_SQL}, '{_k}', '{_v}')"
ALPHABET = "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
PLAINS = "abcdefghijklmnopqrstuvwxyzTSAEIOU"


@query("txt_2_transliterate", f"SELECT doc_id, md5({_SQL}) AS norm FROM (SELECT doc_id, translate(text, '{PLAINS}', '{ALPHABET}') AS x FROM documents)")
def transliterate(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", F.md5(T.transliterate(F.translate("text", PLAINS, ALPHABET))).alias("norm"))


@query("txt_3_topic_pattern", f"WITH {FLAGGED} SELECT url, {', '.join(COLUMNS)} FROM flagged")
def topic_pattern(spark, sf):
    return flagged(spark, sf).select("url", *COLUMNS)


@query("txt_3_default_topics", f"""SELECT doc_id, {', '.join(f"regexp_matches(lower(text), '{p}') AS t_{t}" for t, p in {
    'dohody': '|'.join(START + x for x in T.TOPICS['dohody']), 'torgovlja': 'magazin|rynok|rynk|' + '|'.join(START + x for x in ('torgov', 'otkry', 'zakry')),
    'zanjatost': '|'.join(START + x for x in T.TOPICS['zanjatost'])}.items())} FROM documents""")
def default_topics(spark, sf):
    doc = I.table(spark, sf, "documents").select("doc_id", T.transliterate(F.col("text")).alias("norm"))
    return N.with_topics(doc, T.TOPICS).select("doc_id", "t_dohody", "t_torgovlja", "t_zanjatost")


MONTHLY = FLAGGED + f""",
byo AS (SELECT domain, region_name, month, count(*) AS n, {', '.join(f"avg(CASE WHEN {c} THEN 1.0 ELSE 0 END) AS {c}" for c in COLUMNS)} FROM flagged GROUP BY 1, 2, 3),
zs AS (SELECT *, coalesce((n - avg(n) OVER (PARTITION BY domain)) / nullif(stddev_samp(n) OVER (PARTITION BY domain), 0), 0) AS z FROM byo),
mon AS (SELECT region_name, month, avg(z) AS intensity, CAST(sum(n) AS BIGINT) AS n_articles, count(DISTINCT domain) AS n_outlets, {', '.join(f"avg({c}) AS {c}" for c in COLUMNS)} FROM zs GROUP BY 1, 2)"""
NATIONAL = FLAGGED + f""",
nby AS (SELECT domain, month, count(*) AS n FROM flagged GROUP BY 1, 2),
nz AS (SELECT month, avg(z) AS intensity FROM (SELECT *, coalesce((n - avg(n) OVER (PARTITION BY domain)) / nullif(stddev_samp(n) OVER (PARTITION BY domain), 0), 0) AS z FROM nby) GROUP BY 1),
nat AS (SELECT month, count(*) AS n_articles, count(DISTINCT domain) AS n_outlets, {', '.join(f"avg(CASE WHEN {c} THEN 1.0 ELSE 0 END) AS {c}" for c in COLUMNS)}, any_value(intensity) AS intensity
  FROM flagged JOIN nz USING (month) GROUP BY 1)"""
FEATURES = f"{r('intensity')} AS intensity, n_articles, n_outlets, " + ", ".join(f"{r(c)} AS {c}" for c in COLUMNS)


@query("txt_4_monthly_features", f"WITH {MONTHLY} SELECT region_name, month, {FEATURES} FROM mon")
def monthly_features(spark, sf):
    return rounded(monthly(spark, sf))


@query("txt_5_national_features", f"WITH {NATIONAL} SELECT month, {FEATURES} FROM nat")
def national_features(spark, sf):
    return rounded(national(spark, sf))


HITS = RAW + ",\nhits AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS topic, month, regexp_matches(norm, '{OLD_SQL[t]}') AS o, regexp_matches(norm, '{NEW_SQL[t]}') AS n FROM heads" for t in TOPICS) + """),
hm AS (SELECT topic, month, count(*) FILTER (WHERE o) AS b, count(*) FILTER (WHERE n) AS a, count(*) FILTER (WHERE o AND NOT n) AS rem, count(*) FILTER (WHERE n AND NOT o) AS add_, count(*) AS k FROM hits GROUP BY 1, 2)"""


@query("txt_6_dictionary_diff", f"""WITH {HITS}
SELECT topic, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after, CAST(sum(rem) AS BIGINT) AS removed, CAST(sum(add_) AS BIGINT) AS added,
       {r('CASE WHEN NOT isnan(corr(b / k, a / k)) THEN corr(b / k, a / k) END')} AS share_corr, CASE WHEN sum(b) > 0 THEN {r('sum(rem) * 100.0 / sum(b)')} END AS removed_pct FROM hm GROUP BY 1""")
def dictionary_diff(spark, sf):
    return rounded(N.dictionary_diff(headlines(spark, sf), OLD, TOPICS, COMPOUND))


@query("txt_7_removed_words", f"""WITH {RAW},
w AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(norm, '[\\p{{L}}\\p{{N}}_]+'))) AS word FROM heads) GROUP BY 1),
g AS ({' UNION ALL '.join(f"SELECT '{t}' AS topic, word, n FROM w WHERE regexp_matches(word, '{OLD_SQL[t]}') AND NOT regexp_matches(word, '{NEW_SQL[t]}')" for t in TOPICS)})
SELECT topic, word, n, CAST(row_number() OVER (PARTITION BY topic ORDER BY n DESC, word) AS INTEGER) AS place FROM g
QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, word) <= 5""")
def removed_words(spark, sf):
    return N.removed_words(headlines(spark, sf), OLD, TOPICS, COMPOUND)


@query("txt_8_reproduction_gap", f"""WITH {NATIONAL}, st AS (SELECT month, t_motion + CASE WHEN month = DATE '2000-03-01' THEN 0.25 ELSE 0 END AS t_motion, t_place FROM nat WHERE month <> DATE '1999-08-01')
SELECT {r('max(abs(a.t_motion - b.t_motion))')} AS gap_t_motion, {r('max(abs(a.t_place - b.t_place))')} AS gap_t_place,
       count(*) FILTER (WHERE a.month IS NULL) AS n_only_stored, count(*) FILTER (WHERE b.month IS NULL) AS n_only_fresh FROM nat a FULL JOIN st b USING (month)""")
def reproduction_gap(spark, sf):
    fresh = national(spark, sf)
    bump = F.when(F.col("month") == F.lit(date(2000, 3, 1)), 0.25).otherwise(0.0)
    stored = fresh.where(F.col("month") != F.lit(FIRST)).withColumn("t_motion", F.col("t_motion") + bump)
    return rounded(N.reproduction_gap(fresh, stored, ["month"], ["t_motion", "t_place"]))


# a stored table with other topics is aligned; another intensity in one month and a missing month are not
@query("txt_8_misaligned", f"""WITH {NATIONAL}, d AS (SELECT count(*) FILTER (WHERE month = DATE '2000-03-01') AS moved, count(*) FILTER (WHERE month = DATE '1999-08-01') AS gone FROM nat)
SELECT * FROM (SELECT 'rows only fresh' AS problem, CAST(moved + gone AS BIGINT) AS n FROM d UNION ALL SELECT 'rows only stored', CAST(moved AS BIGINT) FROM d) WHERE n > 0""")
def misaligned(spark, sf):
    fresh = national(spark, sf)
    topics = fresh.withColumn("t_motion", F.col("t_motion") + 1)
    moved = F.when(F.col("month") == F.lit(date(2000, 3, 1)), F.col("intensity") + 1).otherwise(F.col("intensity"))
    N.check_aligned(fresh, topics)
    return N.misaligned(fresh, topics.where(F.col("month") != F.lit(FIRST)).withColumn("intensity", moved))


@query("txt_9_sample_per_month", f"WITH {RAW} SELECT month, least(20, count(*)) AS n FROM heads GROUP BY 1")
def sample_per_month(spark, sf):
    return N.sample_per_month(headlines(spark, sf), "url", 20, 20260920).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


PARAS = r"""
pp AS (SELECT page_id, generate_subscripts(b, 1) AS i, unnest(b) AS b FROM (
  SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
         '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?is)<p[^>]*>(.*?)</p>', 1) AS b FROM pages)),
pc AS (SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS x FROM pp)"""


@query("txt_10_extract_text", f"WITH {PARAS} SELECT p.page_id, length(coalesce(t, '')) AS n_chars, md5(coalesce(t, '')) AS text_hash FROM pages p LEFT JOIN (SELECT page_id, string_agg(x, ' ' ORDER BY i) AS t FROM pc WHERE length(x) >= 40 GROUP BY 1) USING (page_id)")
def extract_text(spark, sf):
    pages = I.table(spark, sf, "pages").select("page_id", T.page_text(F.col("html")).alias("t"))
    return pages.select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("text_hash"))


def dated_pages(spark, sf):
    """Page links rewritten to dated article addresses, three months by page number."""
    prefix = F.concat(F.lit('href="https://news.example.com/2024/0'), (F.col("page_id") % 3 + 1).cast("string"), F.lit("/15/story-on-"))
    return I.table(spark, sf, "pages").select(
        "page_id", F.lit(2024).alias("year"), F.lit(2).alias("month"), F.replace("html", F.lit('href="/'), prefix).alias("html"))


@query("txt_11_archive_links", """WITH l AS (
  SELECT page_id, unnest(list_distinct(regexp_extract_all(replace(html, 'href="/', 'href="https://news.example.com/2024/0' || (page_id % 3 + 1) || '/15/story-on-'), 'href="(https?://[^"]*?/\\d{4}/\\d{2}/\\d{2}/[^"]+?)"', 1))) AS url FROM pages),
k AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM l WHERE page_id % 3 = 1)
SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1), '\\d+$', ''), '[-_]+', ' ', 'g')) AS title, '2024-02-15' AS date FROM k""".replace("\\\\", "\\"))
def archive_links(spark, sf):
    out = N.archive_links(dated_pages(spark, sf), "example.com")
    # anchors of these pages are shorter than a title, so every title comes from the slug
    return out


# planted sitemaps: white space around an address, a date in the address only, a foreign domain, a second block of one
# address with another date, a block without an address, and the page's own address
SITEMAP = [
    "'<urlset><url><loc> https://news.example.com/story-'", "page_id", "'-of_day </loc><lastmod>2024-0'", "page_id % 3 + 1", "'-1'", "page_id % 10",
    "'T10:00</lastmod></url><url><loc>https://news.example.com/2024/01/0'", "page_id % 9 + 1", "'/dated-'", "page_id",
    "'</loc></url><url><loc>https://other.example.org/x-'", "page_id", "'</loc><lastmod>2024-01-05</lastmod></url><url><loc>https://news.example.com/story-'", "page_id",
    "'-of_day</loc><lastmod>2024-01-28</lastmod></url><url><lastmod>2024-01-01</lastmod></url><url><loc>'", "url", "'</loc><lastmod>2024-01-15</lastmod></url></urlset>'"]


@query("txt_11_sitemap_links", f"""WITH x AS (SELECT page_id, concat({', '.join(SITEMAP)}) AS xml FROM pages),
b AS (SELECT page_id, unnest(regexp_extract_all(xml, '(?s)<url>(.*?)</url>', 1)) AS b, generate_subscripts(regexp_extract_all(xml, '(?s)<url>(.*?)</url>', 1), 1) AS i FROM x),
u AS (SELECT page_id, i, regexp_extract(b, '<loc>\\s*(https?://[^<\\s]+)\\s*</loc>', 1) AS url, regexp_extract(b, '<lastmod>\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS tag FROM b),
d AS (SELECT page_id, i, url, CASE WHEN tag <> '' THEN tag ELSE replace(regexp_extract(url, '/(\\d{{4}}/\\d{{2}}/\\d{{2}})/', 1), '/', '-') END AS date FROM u
  WHERE contains(regexp_extract(url, '^https?://([^/?#]*)', 1), 'example.com')),
f AS (SELECT page_id, url, arg_min(date, i) AS date FROM d WHERE date LIKE '2024-01-%' GROUP BY 1, 2),
k AS (SELECT *, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM f)
SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1), '\\d+$', ''), '[-_]+', ' ', 'g')) AS title, date FROM k""")
def sitemap_links(spark, sf):
    maps = I.table(spark, sf, "pages").select("page_id", F.expr(f"concat({', '.join(SITEMAP)})").alias("xml"), F.lit(2024).alias("year"), F.lit(1).alias("month"))
    return N.sitemap_links(maps, "example.com")


BODIES = """bodies AS (SELECT source AS domain, CAST(DATE '1999-08-01' + to_months(CAST(doc_id % 24 AS INTEGER)) AS DATE) AS month,
  regexp_extract(text, '^[^.]*', 0) AS title, text AS body FROM documents),
cut AS (SELECT month, lower(title) AS ti, lower(title || ' ' || substring(body, 1, 1500)) AS bo FROM bodies WHERE domain <> 'src3' AND length(body) >= 1500)"""


def bodies(spark, sf):
    return I.table(spark, sf, "documents").select(
        F.col("source").alias("domain"), F.add_months(F.lit(FIRST), (F.col("doc_id") % 24).cast("int")).alias("month"),
        F.regexp_extract("text", r"^[^.]*", 0).alias("title"), F.col("text").alias("body"))


@query("txt_12_headline_vs_body", f"""WITH {BODIES}, h AS ({' UNION ALL '.join(f"SELECT '{t}' AS topic, regexp_matches(ti, '{p}') AS a, regexp_matches(bo, '{p}') AS b FROM cut" for t, p in NEW_SQL.items())})
SELECT topic, {r('avg(CASE WHEN a THEN 1.0 ELSE 0 END)')} AS share_title, {r('avg(CASE WHEN b THEN 1.0 ELSE 0 END)')} AS share_body, count(*) FILTER (WHERE b AND NOT a) AS n_added,
       count(*) FILTER (WHERE NOT a) AS n_missed, count(*) AS n_articles, {r('count(*) FILTER (WHERE b) * 1.0 / nullif(count(*) FILTER (WHERE a), 0)')} AS growth,
       {r('count(*) FILTER (WHERE b AND NOT a) * 1.0 / nullif(count(*) FILTER (WHERE NOT a), 0)')} AS share_added FROM h GROUP BY 1""")
def headline_vs_body(spark, sf):
    return rounded(N.headline_vs_body(bodies(spark, sf), TOPICS, 1500, "src3", COMPOUND))


# --- residuals of the aggregate -----------------------------------------------------------

RESID = LONG.replace("FROM agg UNION ALL", f"FROM agg WHERE month <= {O.LAST} UNION ALL") + "," + chosen("(3)") + """,
mdl AS (SELECT model FROM choice WHERE series_key = 'aggregate' AND n = 79),
resid AS (
  SELECT lp0.month, CAST(p.k + 1 AS INTEGER) AS step, a.h - p.p AS residual FROM paths p JOIN mdl USING (model)
  JOIN lp lp0 ON lp0.series_key = 'aggregate' AND lp0.pos = p.n - 1 JOIN lp a ON a.series_key = 'aggregate' AND a.pos = p.n + p.k
  WHERE p.series_key = 'aggregate' AND p.k < 3 AND p.n >= 26)"""


def residuals(spark, sf, horizon=3):
    cut = L.cut_at(I.stored_aggregate(spark, sf), F.lit(I.CALENDAR.last)).select(F.lit("aggregate").alias("series_key"), "month", "value")
    best = L.choose_model(L.log_history(cut), ["series_key"], horizon)
    return L.walk_forward(cut, horizon, best)


MT = FLAGGED.replace("flagged AS", "flg AS") + f""",
wh AS (SELECT month, {', '.join(f"avg(CASE WHEN {c} THEN 1.0 ELSE 0 END) AS {c}" for c in COLUMNS)} FROM flg GROUP BY 1), {BODIES},
mt AS (SELECT month, {', '.join(f"avg(CASE WHEN regexp_matches(ti, '{p}') THEN 1.0 ELSE 0 END) AS t_{t}" for t, p in NEW_SQL.items())} FROM cut GROUP BY 1),
mb AS (SELECT month, {', '.join(f"avg(CASE WHEN regexp_matches(bo, '{p}') THEN 1.0 ELSE 0 END) AS t_{t}" for t, p in NEW_SQL.items())} FROM cut GROUP BY 1),
ml AS (SELECT month, avg(length(body)) AS body_length FROM bodies GROUP BY 1)"""


@query("txt_13_share_residual_corr", f"WITH {RESID}, {MT}, u AS (" + " UNION ALL ".join(
    f"SELECT '{label}' AS source, '{c}' AS topic, month, {c} AS x FROM {tab}" for label, tab in (("corpus", "wh"), ("titles", "mt"), ("bodies", "mb")) for c in COLUMNS) +
    f" UNION ALL SELECT 'control', 'body_length', month, body_length FROM ml) SELECT source, topic, step, {r('CASE WHEN NOT isnan(corr(x, residual)) THEN corr(x, residual) END')} AS corr, count(x) AS n_months FROM u JOIN resid USING (month) GROUP BY 1, 2, 3")
def share_residual_corr(spark, sf):
    rows = bodies(spark, sf)
    kept = rows.where((F.col("domain") != "src3") & (F.length("body") >= 1500))

    def shares(text):
        hit = N.with_topics(kept.withColumn("norm", T.transliterate(text)), TOPICS, COMPOUND)
        return hit.groupBy("month").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in COLUMNS])

    sources = {
        "corpus": national(spark, sf).select("month", *COLUMNS),
        "titles": shares(F.col("title")),
        "bodies": shares(F.concat_ws(" ", "title", F.substring("body", 1, 1500))),
        "control": rows.groupBy("month").agg(F.avg(F.length("body")).alias("body_length")),
    }
    return rounded(N.share_residual_corr(sources, residuals(spark, sf), [*COLUMNS, "body_length"]))


# --- two-stage with news ------------------------------------------------------------------

TSR = RESID.replace("mdl AS (SELECT model FROM choice WHERE series_key = 'aggregate' AND n = 79)",
                    f"mdl AS (SELECT f.fold, f.train_end, ch.model FROM folds f JOIN choice ch ON ch.series_key = 'aggregate' AND ch.n = f.train_end)").replace(
    "SELECT lp0.month,", "SELECT fold, train_end, lp0.month,").replace("p.n >= 26)", "p.n >= 26 AND p.n + p.k < train_end AND lp0.month IN (SELECT month FROM nat))").replace(
    f"FROM agg WHERE month <= {O.LAST} UNION ALL", "FROM agg UNION ALL")
TSN = O.FOLDS3 + "," + NATIONAL + "," + TSR


# one more monthly feature that does carry a signal: the change of the line count a month ahead
LEAD = """
cnt AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS k FROM lineitem GROUP BY 1),
lead AS (SELECT a.month, ln(b.k * 1.0 / a.k) AS t_lead FROM cnt a JOIN cnt b ON b.month = CAST(a.month + to_months(1) AS DATE)),
nat2 AS (SELECT nat.*, t_lead FROM nat JOIN lead USING (month))"""
LEADS = [*COLUMNS, "t_lead"]


def leading(spark, sf):
    counts = I.table(spark, sf, "lineitem").groupBy(readers.to_month("l_shipdate").alias("month")).agg(F.count(F.lit(1)).alias("k"))
    ahead = counts.select(F.add_months("month", -1).alias("month"), F.col("k").alias("k1"))
    lead = counts.join(ahead, "month").select("month", F.log(F.col("k1") / F.col("k")).alias("t_lead"))
    return national(spark, sf).join(lead, "month")


def _paths3(spark, sf):
    return TS.aggregate_paths(I.stored_aggregate(spark, sf), I.CALENDAR, PLAN3)


@query("ts_6_aggregate_residuals", f"WITH {TSN} SELECT fold, month, step, {r('residual')} AS residual FROM resid")
def aggregate_residuals(spark, sf):
    return rounded(TS.aggregate_residuals(I.stored_aggregate(spark, sf), national(spark, sf), _paths3(spark, sf), 3).drop("origin"))


LOO = TSN + "," + LEAD + ",\nlx AS (" + " UNION ALL ".join(f"SELECT fold, train_end, step, month, '{c}' AS topic, {i} AS ord, {c} AS x, residual AS y FROM resid JOIN nat2 USING (month)" for i, c in enumerate(LEADS)) + """),
leave AS (
  SELECT a.fold, a.train_end, a.step, a.topic, a.ord, a.month, a.y, a.y - (regr_intercept(b.y, b.x) + regr_slope(b.y, b.x) * a.x) AS e
  FROM lx a JOIN lx b ON a.fold = b.fold AND a.step = b.step AND a.topic = b.topic AND a.month <> b.month GROUP BY a.fold, a.train_end, a.step, a.topic, a.ord, a.month, a.y, a.x),
gain AS (SELECT fold, train_end, step, topic, ord, count(*) AS n_months, avg(y * y) - avg(e * e) AS gain FROM leave GROUP BY 1, 2, 3, 4, 5)"""


def _gains(spark, sf):
    agg, news = I.stored_aggregate(spark, sf), leading(spark, sf)
    res = TS.aggregate_residuals(agg, news, _paths3(spark, sf), 3)
    long = S.unpivot(news, ["month"], LEADS, "topic", "x")
    return TS.loo_gains(res.join(long, "month"), ["fold", "step", "topic"], "x", "residual")


@query("ts_7_loo_gain", f"WITH {LOO} SELECT fold, step, topic, n_months, {r('gain * 1000')} AS gain FROM gain")
def loo_gain(spark, sf):
    return rounded(_gains(spark, sf).select("fold", "step", "topic", "n_months", (F.col("gain") * 1000).alias("gain")))


@query("ts_8_news_correction", f"""WITH {LOO},
best AS (SELECT * FROM gain WHERE n_months >= 8 AND gain > 0 QUALIFY row_number() OVER (PARTITION BY fold, step ORDER BY gain DESC, ord) = 1),
fit AS (SELECT fold, step, topic, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM lx GROUP BY 1, 2, 3),
here AS ({' UNION ALL '.join(f"SELECT month, '{c}' AS topic, {c} AS x0 FROM nat2" for c in LEADS)})
SELECT best.fold, best.step, best.topic, {r('gain * 1000')} AS gain, {r('a + b * x0')} AS correction FROM best JOIN fit USING (fold, step, topic)
JOIN here ON here.topic = best.topic AND here.month = CAST(DATE '1995-01-01' + to_months(CAST(train_end - 1 AS INTEGER)) AS DATE)""")
def news_correction(spark, sf):
    news = leading(spark, sf)
    res = TS.aggregate_residuals(I.stored_aggregate(spark, sf), news, _paths3(spark, sf), 3)
    out = TS.news_correction(res, news, LEADS)
    return rounded(out.select("fold", "step", "topic", (F.col("gain") * 1000).alias("gain"), "correction"))


@query("ts_8_two_stage_news")
def two_stage_news(spark, sf):
    agg, news = I.stored_aggregate(spark, sf), leading(spark, sf)
    paths = cut_lineage(_paths3(spark, sf), "paths")  # a few rows per fold, read three times below
    fix = TS.news_correction(TS.aggregate_residuals(agg, news, paths, 3), news, LEADS)
    moved = cut_lineage(TS.corrected_paths(paths, fix, 3), "corrected")
    series = I.stored_arrays(spark, sf)
    done = TS.two_stage(series, PLAN3, moved, TS.aggregate_array(agg, I.CALENDAR), name="two_stage_news")
    return done.select("series_id", "fold", "rule", F.posexplode("forecast").alias("k", "forecast"))


@query("gb_6_news_features", f"""WITH {O.TOTAL_CLEAN}, {O.REGIONS}, {MONTHLY}
SELECT c.series_id, c.t, {', '.join(f"{r('m.' + c)} AS news_{c}" for c in COLUMNS)} FROM clean c LEFT JOIN regions g USING (series_id) LEFT JOIN mon m ON m.region_name = g.region AND m.month = c.month""")
def news_features(spark, sf):
    rows = I.total_clean(spark, sf).select("series_id", "t")
    news = monthly(spark, sf).withColumnRenamed("region_name", "region")
    return rounded(X.news_features(rows, I.regions(spark, sf), news, COLUMNS, I.CALENDAR))


# --- association tests ----------------------------------------------------------------------

EVENTS = (60, 66, 73)
ALLF = ["intensity", *COLUMNS]


def _long_national(alias: str = "x") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, month, {O.t_of('month')} AS t, {c} AS {alias} FROM nat" for c in ALLF)


@query("sta_1_exact_permutation", f"""WITH {NATIONAL}, fx AS ({_long_national()}),
tot AS (SELECT feature, sum(x) AS s, count(*) AS n FROM fx GROUP BY 1),
ev AS (SELECT lag, e - lag AS t FROM (VALUES (0), (1), (2)) l(lag) CROSS JOIN (VALUES {', '.join(f'({e})' for e in EVENTS)}) v(e)),
obs AS (SELECT feature, lag, sum(x) AS i FROM fx JOIN ev USING (t) GROUP BY 1, 2),
sub AS (SELECT a.feature, a.x + b.x + c.x AS s FROM fx a JOIN fx b ON b.feature = a.feature AND b.t > a.t JOIN fx c ON c.feature = a.feature AND c.t > b.t)
SELECT o.feature, o.lag, CAST(any_value(n) AS INTEGER) AS n_months, count(*) AS n_subsets, {r('any_value(i) / 3')} AS inside, {r('(any_value(t.s) - any_value(i)) / (any_value(n) - 3)')} AS outside,
       {r('avg(CASE WHEN abs(sub.s / 3 - (t.s - sub.s) / (n - 3)) >= abs(i / 3 - (t.s - i) / (n - 3)) - 1e-12 THEN 1.0 ELSE 0 END)')} AS p
FROM obs o JOIN tot t USING (feature) JOIN sub USING (feature) GROUP BY 1, 2""")
def exact_permutation(spark, sf):
    table = national(spark, sf).withColumn("t", I.CALENDAR.position(F.col("month")))
    return rounded(S.exact_permutation(table, ALLF, EVENTS))


LAGGED = OFF + "," + O.REGIONS + "," + MONTHLY.replace("mon AS", "news AS") + f""",
bs AS (
  SELECT region, CAST(DATE '1995-01-01' + to_months(CAST(g.t AS INTEGER)) AS DATE) AS month, count(br.series_id) * 1.0 / any_value(n_series) AS break_share
  FROM (SELECT region, count(*) AS n_series FROM regions GROUP BY 1) m CROSS JOIN range(0, 79) AS g(t)
  LEFT JOIN (SELECT br.series_id, br.t, region FROM br JOIN regions USING (series_id)) br USING (region, t) GROUP BY 1, 2),
nl AS ({' UNION ALL '.join(f"SELECT region_name AS region, month, '{c}' AS feature, {c} AS x FROM news" for c in COLUMNS)}),
lg AS (SELECT region, bs.month, feature, lag, x, break_share AS y FROM nl CROSS JOIN (VALUES (0), (1)) l(lag) JOIN bs USING (region)
  WHERE bs.month = CAST(nl.month + to_months(CAST(lag AS INTEGER)) AS DATE)),
lgd AS (SELECT *, x - avg(x) OVER w AS xd, y - avg(y) OVER w AS yd FROM lg WINDOW w AS (PARTITION BY feature, lag, month))"""


def lagged(spark, sf):
    breaks = R.region_break_shares(cusum_breaks(spark, sf), I.regions(spark, sf).select("series_id", "region"), I.CALENDAR)
    news = monthly(spark, sf).withColumnRenamed("region_name", "region")
    return S.lagged(news, breaks, COLUMNS, (0, 1))


@query("sta_5_lagged_join", with_sql(LAGGED, f"SELECT region, month, feature, lag, {r('x')} AS x, {r('y')} AS y FROM lg"))
def lagged_join(spark, sf):
    return rounded(lagged(spark, sf))


def live_breaks(spark, sf):
    """Breaks of the exact partition are frequent enough for the region tables."""
    return R.offline_breaks(I.total_arrays(spark, sf).select("series_id", "y"), "pelt", "ratio", [1.0], I.CALENDAR)


@query("sta_2_within_month_effect")
def within_month_effect(spark, sf):
    breaks = R.region_break_shares(live_breaks(spark, sf), I.regions(spark, sf).select("series_id", "region"), I.CALENDAR)
    news = monthly(spark, sf).withColumnRenamed("region_name", "region")
    return S.within_month_effect(S.lagged(news, breaks, COLUMNS, (0, 1, 2)), "x", "y")


@query("sta_2_within_month_slope", with_sql(LAGGED, f"SELECT feature, lag, count(*) AS n, {r('sum(xd * yd) / nullif(sum(xd * xd), 0)')} AS slope FROM lgd GROUP BY 1, 2"))
def within_month_slope(spark, sf):
    rows = S.within_month(lagged(spark, sf), "x", "y")
    slope = F.sum(F.col("xd") * F.col("yd")) / F.nullif(F.sum(F.col("xd") * F.col("xd")), F.lit(0.0))
    return rounded(rows.groupBy("feature", "lag").agg(F.count(F.lit(1)).alias("n"), slope.alias("slope")))


def residual_pairs(spark, sf):
    news = S.unpivot(national(spark, sf), ["month"], ALLF)
    return residuals(spark, sf).select("month", "step", "residual").join(news, "month")


@query("sta_3_permutation_slope")
def permutation_slope(spark, sf):
    return S.permutation_slope(residual_pairs(spark, sf), "x", "residual")


@query("sta_4_residual_regression", f"""WITH {RESID}, {NATIONAL}, fx AS ({_long_national()}),
g AS (SELECT feature, step, count(*) AS n, regr_slope(residual, x) AS slope, regr_sxx(residual, x) AS sxx, regr_syy(residual, x) AS syy, regr_sxy(residual, x) AS sxy FROM fx JOIN resid USING (month) GROUP BY 1, 2)
SELECT feature, step, n, {r('slope')} AS slope, {r('abs(slope / sqrt((syy - sxy * sxy / sxx) / greatest(n - 2, 1) / sxx))')} AS abs_t FROM g""")
def residual_regression(spark, sf):
    return rounded(S.regressions(residual_pairs(spark, sf), "x", "residual"))


STATS = LAGGED + """,
d0 AS (
  SELECT 'within_month' AS design, feature, lag, count(*) AS n, count(*) - count(DISTINCT month) - 1 AS df, CASE WHEN NOT isnan(corr(xd, yd)) THEN corr(xd, yd) END AS r FROM lgd GROUP BY 2, 3
  UNION ALL SELECT 'pooled', feature, lag, count(*), count(*) - 2, CASE WHEN NOT isnan(corr(x, y)) THEN corr(x, y) END FROM lg GROUP BY 2, 3)"""


@query("sta_6_design_stats", with_sql(STATS, f"SELECT design, feature, lag, n, df, {r('r')} AS r, {r('r * sqrt(df) / sqrt(1 - r * r)')} AS t FROM d0"))
def design_stats(spark, sf):
    return rounded(S.design_stats(lagged(spark, sf), 0.05).select("design", "feature", "lag", "n", "df", "r", "t"))


@query("sta_7_corr_rows")
def corr_rows(spark, sf):
    return S.corr_rows(lagged(spark, sf), n_tests=len(COLUMNS) * 2)


@query("sta_8_bonferroni", f"""WITH {NATIONAL}, fx AS ({_long_national()}),
tot AS (SELECT feature, sum(x) AS s, count(*) AS n FROM fx GROUP BY 1),
ev AS (SELECT lag, e - lag AS t FROM (VALUES (0), (1), (2)) l(lag) CROSS JOIN (VALUES {', '.join(f'({e})' for e in EVENTS)}) v(e)),
obs AS (SELECT feature, lag, sum(x) AS i FROM fx JOIN ev USING (t) GROUP BY 1, 2),
sub AS (SELECT a.feature, a.x + b.x + c.x AS s FROM fx a JOIN fx b ON b.feature = a.feature AND b.t > a.t JOIN fx c ON c.feature = a.feature AND c.t > b.t),
ps AS (SELECT o.feature, o.lag, avg(CASE WHEN abs(sub.s / 3 - (t.s - sub.s) / (n - 3)) >= abs(i / 3 - (t.s - i) / (n - 3)) - 1e-12 THEN 1.0 ELSE 0 END) AS p
  FROM obs o JOIN tot t USING (feature) JOIN sub USING (feature) GROUP BY 1, 2)
SELECT count(*) AS n_tests, {r('0.05 / 15')} AS threshold, count(*) FILTER (WHERE p < 0.05 / 15) AS n_passed, count(*) FILTER (WHERE p < 0.05) AS n_nominal, {r('min(p)')} AS best_p,
       arg_min(feature, struct_pack(p := round(p, 12), f := feature, l := lag)) AS best_feature, arg_min(lag, struct_pack(p := round(p, 12), f := feature, l := lag)) AS best_lag FROM ps""")
def bonferroni(spark, sf):
    table = national(spark, sf).withColumn("t", I.CALENDAR.position(F.col("month")))
    return rounded(S.bonferroni(S.exact_permutation(table, ALLF, EVENTS), n_tests=len(ALLF) * 3))


# df = 23 for 24 months; the quantile is from a printed table
@query("sta_9_t_interval", f"""WITH {NATIONAL}, fx AS ({_long_national()})
SELECT feature, count(*) AS n, {r('avg(x)')} AS mean, {r('avg(x) - 2.0686576104190406 * stddev_samp(x) / sqrt(count(*))')} AS ci_low, {r('avg(x) + 2.0686576104190406 * stddev_samp(x) / sqrt(count(*))')} AS ci_high FROM fx GROUP BY 1""")
def t_interval(spark, sf):
    return rounded(S.mean_intervals(S.unpivot(national(spark, sf), ["month"], ALLF), "x", ["feature"]))
