import html
import re

import pytest

from panelwright.llm import extraction, queries

TREE = extraction.grow()


def text_of(page):
    return extraction.main_text(page, TREE)


def test_tree_fits_its_table():
    import numpy as np

    rows = np.array(extraction.LABELLED, dtype=float)
    assert (TREE.keeps(rows[:, :-1]) == (rows[:, -1] > 0)).all()


def test_whole_table(spark, small):
    """The pages hold one article each: its paragraphs, cut out by their tags, are the expected text."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = queries.QUERIES["op7_extract_main_text"](spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", inner))
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><p>Slogan of the site</p></header>
<nav><ul><li><a href="/">Home</a></li><li><a href='/a>b'>About</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site work and to count visits of our readers.</p></div>
<main><article class="post"><h1>Title &amp; more</h1><p>First <b>bold</b>
 paragraph with <a href="x">a link</a> and an &eacute;&#233;&#x41; entity.</p><!-- <p>no</p> --><script>var t="</p><p>no</p>";</script>
<div class="ad">Buy this now, it is cheap and good for you and everybody else.</div><p>Short.</p><ul><li>one point of the list</li><li>another one</li></ul>
<form><label>Mail</label><input name=q><button>Send</button></form>
<section id="comments"><p>Great article, I liked it very much and will come back soon.</p></section></article></main>
<aside class=sidebar><h2>Related</h2><p>Another long text in the sidebar which is not part of the article at all.</p></aside>
<footer><p>Copyright by nobody. All rights reserved by the same.</p></footer></body></html>"""


def test_furniture_is_left_out():
    assert text_of(PAGE).split("\n\n") == ["Title & more", "First bold paragraph with a link and an ééA entity.", "Short.", "one point of the list", "another one"]


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<p></p>", ""), ("<script>x", ""), ("<!-- x", ""), ("<article><p>cut &amp", "cut &"), ("<article><p>a<p>b<br>c</article>", "a\n\nb c"),
    ("<article><p>x < y and y > z</p></article>", "x < y and y > z"), ("<article><p>" + "word " * 50_000 + "</p></article>", ("word " * 50_000).strip()),
    ("<article><p title=\"a>b\">q</p><p class='x>y'>r</p></article>", "q\n\nr"), ("<article>" + "<div>" * 3000 + "<p>deep text</p>", "deep text"),
])
def test_edges(page, want):
    assert text_of(page) == want


LONG = "A long paragraph with more than enough words to be the text of an article about something."


@pytest.mark.parametrize("page, want", [
    # names on any element, not only on containers
    (f'<article><p>{LONG}</p><p class="advert">{LONG} Buy.</p><ul><li class="comment">{LONG} Me too.<li>one point</ul><h3 class="related">More</h3><p>{LONG} End.</p></article>',
     [LONG, "one point", f"{LONG} End."]),
    (f'<article><ul><li class="comment"><p>{LONG}</p><p>{LONG}</p></li><li>kept point</li></ul><p>{LONG}</p></article>', ["kept point", LONG]),
    (f'<article><h2 class="section-header">Part</h2><p>{LONG}</p></article>', ["Part", LONG]),
    # hidden elements
    (f'<article><p>{LONG}</p><div style="margin:0; display: none"><p>secret</p></div><p hidden>no</p><p>a <span style="display:none">b</span>c</p></article>', [LONG, "a c"]),
    (f'<article><p title="not hidden at all">{LONG}</p><p class="is-hidden-not">{LONG}</p><br hidden><p>{LONG}</p></article>', [LONG] * 3),
    (f'<article><p aria-hidden="true">x<p>{LONG}</article>', [LONG]),
    # drawings and buttons, closed in themselves, closed and left open
    (f'<article><p><svg class="i"/>{LONG}</p><p>one <svg><text>no</text></svg>two <button>Share</button>three</p></article>', [LONG, "one two three"]),
    (f'<article><p><svg class="i">{LONG}</p><p><button>{LONG}</p></article>', [LONG, LONG]),
    # names of content around the article
    (f'<div class="post-header-content"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>', ["Title", LONG, LONG]),
    (f'<div class="story share"><p>{LONG}</p></div>', [LONG]),
    (f'<div class="story share"><article><p>Short.</p></article></div>', ["Short."]),
    (f'<div class="comment-content"><p>{LONG}</p></div><div role="banner" class="content"><p>{LONG}</p></div><div class="article"><p>{LONG}</p></div>', [LONG]),
    (f'<div class="header-content"><h1>Site</h1><p>Our small slogan</p></div><nav><a href="/">Home</a></nav><div id=main><p>{LONG}</p></div>', [LONG]),
])
def test_names_and_hidden_elements(page, want):
    assert text_of(page).split("\n\n") == want


def test_open_elements_cost_linear_time():
    assert text_of("<article>" + "<p><svg>word " * 100_000 + "</article>").count("word") == 100_000


def test_frames(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x", 5), (1, "u", PAGE, "x", 5), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    rows = extraction.extract(pages, ["page_id", "url"]).collect()
    assert [r.n_chars == len(r.text) for r in rows] == [True] * 3 and rows[0].text == rows[1].text and rows[2].text == ""
    assert extraction.extract(pages.limit(0), ["page_id"]).count() == 0
