"""Page text and exact search against plain definitions."""

import os
import random
import re
import time
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlens.llm import html, topk

from .conftest import prose

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div id="cookie-notice"><p>We use cookies on this site, please agree to all of them now.</p></div>
<div class="content"><h1>A  title</h1><p>First &eacute;tage &amp; more text, %s.<p>Short.<div class="ad">Buy this thing now</div><p>Last <b>bold</b>
 words, %s.</p><form><label>Mail</label><input name=m><button>Send</button></form></div>
<aside><p>Aside text that is quite long, %s.</p></aside><section id="comments"><h2>Comments</h2><p>A reader writes, %s.</p></section><footer>All rights</footer></body></html>""" % tuple(" ".join(["word"] * n) for n in (40, 30, 30, 40))
WANT = "A title\nFirst étage & more text, %s.\nShort.\nLast bold words, %s." % (" ".join(["word"] * 40), " ".join(["word"] * 30))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (PAGE, WANT),
        (None, ""),
        ("", ""),
        ("just text\n\n here", "just text here"),
        ("<nav><a>x</a></nav><footer>y</footer>", ""),
        ("<form><article><h1>In</h1><p>a form</p></article></form>", "In\na form"),
        ("<body><article><p>one<p>two<ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article><div>tail</div>", "one\ntwo\na\nb\nc\nd"),
        ("<article><p>a&nbsp;&#8212;&#x41;</p><!-- no --><script>x</script></article>", "a —A"),
        ("<article>un<b>closed <i>tags", "unclosed tags"),
        ("<p>&lt;p&gt; & < 3", "<p> & < 3"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="has-sidebar"><article><p>The text of the page.</p></article></div>', "The text of the page."),
        ('<article class="post social"><p>The text of the page.</p><div class="share">Share it</div></article>', "The text of the page."),
        ('<div id="no-sidebar"><p>The text of the page, which is long.</p></div><p>Other</p>', "The text of the page, which is long."),
        ('<div class="ad"><p>One</p></div><div class="promo"><p>Two</p></div>', "One\nTwo"),
        ('<article><p>Short.</p></article><div class="comments"><article><p>A comment that is much longer.</p></article></div>', "Short."),
    ],
)
def test_labels_on_wrappers(page, want):
    assert want in html.main_text(page)
    assert "Share" not in html.main_text(page) and "comment" not in html.main_text(page)


def plain_page(rng, layout):
    """(page, main text) without article, main, classes or ids: only the ratios tell them apart."""
    blocks = ["A title of " + prose(rng, 4)] + [prose(rng, rng.choice((40, 60, 90))) + "." for _ in range(rng.randint(4, 8))]
    blocks[rng.randint(2, len(blocks) - 2)] = "A short one."
    links = lambda n: [f'<a href="/{i}">{prose(rng, 1)}</a>' for i in range(n)]
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}" + rng.choice(("", "</p>")) for b in blocks[1:])
    body = body.replace("<p>A short one.", "<ul><li>" + "<li>".join(links(4)) + "</ul><p>A short one.") if layout == "menu between" else body
    menu = rng.choice(("<div>" + " | ".join(links(6)) + "</div>", "<ul><li>" + "<li>".join(links(8)) + "</ul>", "<table><tr><td>" + "<td>".join(links(5)) + "</table>"))
    foot = rng.choice(("<div>" + " | ".join(links(4)) + "</div><div>\u00a9 2020 " + prose(rng, 2) + "</div>", "<p>Copyright " + prose(rng, 3) + ".</p>", "<div>" + prose(rng, 3) + "</div><ul><li>" + "<li>".join(links(6)) + "</ul>"))
    head = f"<div>{prose(rng, 2)}</div>"
    side = "<div>" + "".join(f"<div>{x}</div>" for x in links(7)) + f"<div>{prose(rng, 5)}</div></div>"
    page = {"flat": head + menu + body + foot, "columns": f"{head}{menu}<div>{side}<div>{body}</div></div>{foot}", "table": f"<table><tr><td>{menu}<td>{body}<tr><td>{foot}</table>", "menu between": head + menu + body + foot}[layout]
    return f"<html><body>{page}</body></html>", "\n".join(blocks)


@pytest.mark.parametrize("layout", ["flat", "columns", "table", "menu between"])
def test_ratios_decide_where_nothing_is_marked(layout, monkeypatch):
    pages = [plain_page(random.Random(i), layout) for i in range(60)]
    assert [html.main_text(p) for p, _ in pages] == [t for _, t in pages]
    for constant in (True, False) if layout != "columns" else ():
        monkeypatch.setattr(html, "content_lines", lambda lengths, tags, marked=None, constant=constant: np.full(len(lengths), constant))
        assert sum(html.main_text(p) == t for p, t in pages) < 10


def test_titles_over_marked_articles_are_kept():
    page = "<main><div><h1>The title</h1><p>By someone, today.</p><article><p>%s.</p></article></div><div><a href=x>Related</a></div></main>" % ("word " * 60).strip()
    assert html.main_text(page).split("\n") == ["The title", "By someone, today.", ("word " * 60).strip() + "."]


ODD = {
    "unclosed": ("<b>", "</i>"), "deep": ("<div>word ", ""), "inline before blocks": ("<b>", "<div></div>"), "items": ("<p><li>", ""), "articles": ("<article>text</article>", ""),
    "comments": ("<!--", ""), "tags": ("<a ", ""), "quotes": ('<a href="', ""), "sections": ("<![CDATA[", ""), "ends": ("</", ""), "instructions": ("<?", ""), "signs": ("<", ""), "labels": ('<div class="ad">x', ""),
}


@pytest.mark.parametrize("name", ODD)
def test_odd_markup_takes_linear_time(name):
    one, two = ODD[name]
    began = time.process_time()
    html.main_text(one * 100_000 + two * 100_000)
    assert time.process_time() - began < 2


def slow_article(page):
    """The blocks of a page's only article by plain replacement: a second way to the same text."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    inner = re.sub(r"<(script|style|aside|form|nav|footer)\b.*?</\1>|<!--.*?-->|<div class=\"ad\">.*?</div>", "", inner, flags=re.S)
    lines = re.split(r"</?(?:p|h\d|div|ul|ol|li|table|tr|td|th|blockquote|pre|section|figure|figcaption)\b[^>]*>", re.sub(r"<br\b[^>]*>", " ", inner))
    lines = [" ".join(unescape(re.sub(r"<[a-zA-Z/][^>]*>", "", x)).split()) for x in lines]
    return "\n".join(x for x in lines if x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_a_second_implementation(spark, sf):
    data = f"/root/testdata/{sf}"
    if not os.path.isdir(data):
        pytest.skip("no tables")
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    from strandlens.llm.queries import op9_text_to_tag_pages

    for r in op9_text_to_tag_pages(spark, data).collect():
        assert r.text == slow_article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_smoothing_and_clusters():
    x = np.array([0, 0, 10, 0, 0], float)
    s = html.smoothed(x)
    assert s.argmax() == 2 and s[1] == s[3] > 0 and abs(html.smoothed(np.ones(4)) - 1).max() < 1e-12
    assert html.content_lines(np.array([5, 4, 200, 300, 250, 6.0]), np.array([3, 3, 1, 1, 1, 4.0])).tolist()[2:5] == [True] * 3
    assert not html.content_lines(np.array([5, 4, 4, 200, 300, 250.0]), np.array([5, 5, 5, 1, 1, 1.0]))[0]


def test_pages(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2), (3, "v", "<article>" + "<p>long text</p>" * 20_000 + "</article>", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = html.extract_pages(df).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in out) == sorted([("1", len(WANT))] * 2 + [("None", 0), ("3", 20_000 * 10 - 1)])
    assert html.extract_pages(df.where("false")).count() == 0


def brute(rows, k, scale=64.0):
    vectors = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in vectors:
        if i % 3 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in vectors if i != q))[:k]
        out += [(q, rank, i, min(-s, 2**63 - 1)) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize(("blocks", "k"), [((4096, 512), 5), ((7, 3), 5), ((7, 3), 500)])
def test_top_k(spark, monkeypatch, blocks, k):
    monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", (blocks[1], blocks[1]))
    monkeypatch.setattr(topk, "SCORED", 3)
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.choice([-0.5, 0.0, 0.0, 0.02, 1.3], 6)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 0.0]), (63, [float("nan")] * 6), (66, [float("inf")] * 6), (None, [1.0] * 6), (69, []), (72, [1.0, 2.0]), (5, [0.5] * 6), (12, [0.25] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 3 == 0, k=k).collect())
    assert got == brute(rows, k)


def test_top_k_large_numbers_and_empty(spark):
    df = spark.createDataFrame([(0, [1e7, 1e7]), (1, [1e7, -1e6]), (2, [3.0, 1e7])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, k=2).collect()) == [(0, 1, 2, 4096 * (10**14 + 3 * 10**7)), (0, 2, 1, 4096 * (10**14 - 10**13))]
    huge = [(0, [1e12, 3.0]), (1, [1e12, 1.0]), (2, [-1e12, 0.0]), (3, [2e7, 5.0]), (4, [1e300, 0.0]), (5, [0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=9).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2**63 - 1), (3, 2**63 - 1), (4, 2**63 - 1), (5, 4096 * 3), (2, -(2**63))]
    assert topk.top_k(df.where("false"), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(df, F.col("vec_id") == 9).count() == 0
