"""Wrapper inference, and main texts against a plain reading of the given pages."""

import html
import random
import re

import pytest

from loomset.llm import catalog, wrappers

SF = "/root/testdata/sf0.01"


def plain(page):
    """The article of a page of the given tables, read by patterns."""
    page = re.sub(r"<!--.*?-->|<script.*?</script>|<style.*?</style>", "", page, flags=re.S)
    article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", article[1]) if article else []
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", p.replace("<br>", " "))).split()) for p in parts)
    return "\n\n".join(t for t in texts if t)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = catalog.QUERIES["op2_wrappers"](spark, SF).collect()
    assert sorted((r["page_id"], r["url"], r["text"]) for r in got) == sorted((r["page_id"], r["url"], plain(r["html"])) for r in pages)
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in got)


def test_wrapper_of_one_page():
    tree = wrappers.of_page(wrappers.parse("<ul><li>a<li>b</ul><p>x</p><p>y <b>z</b></p>"))
    ul, p = tree["c"]
    assert (ul["t"], ul["q"], ul["c"][0]["t"], ul["c"][0]["q"]) == ("ul", "1", "li", "+")
    assert p["q"] == "+" and [c["q"] for c in p["c"]] == ["1", "?"] and p["c"][0]["x"] is None


def test_alignment_finds_optionals_groups_and_slots():
    one = wrappers.of_page(wrappers.parse("<div><h2>News</h2><p>a</p></div><p class=x>same</p>"))
    two = wrappers.of_page(wrappers.parse("<div><h2>News</h2><img src=1><p>b</p><p>c</p></div><p class=x>same</p>"))
    both = wrappers.merge(one, two)
    div, same = both["c"]
    assert [(c["t"], c["q"]) for c in div["c"]] == [("h2", "1"), ("img", "?"), ("p", "+")]
    assert div["c"][0]["c"][0]["x"] == "News" and div["c"][2]["c"][0]["x"] is None and same["c"][0]["x"] == "same"
    again = wrappers.merge(both, one)
    assert [(c["t"], c["q"]) for c in again["c"][0]["c"]] == [("h2", "1"), ("img", "?"), ("p", "+")]


SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><div class="top-bar menu"><a href="/">Home</a></div>
<header><h2>Site</h2></header><div id="cookie-consent">We use cookies</div>
<div class="wrap"><div class="content"><header><h1>Title {i}</h1></header><p>Text {i} of &lt;page&gt; &amp; more&nbsp;words,
 long enough to weigh {i}</p><div class="share">Share me</div><p>Second<br>line {i}<p>Third <i>it</i>em {i}
<ul><li>one {i}<li>two</ul><p>Read on elsewhere</p><form><input value=x><p>Write us</p></form><script>var a = "<p>no</p>";</script></div>
<div class="sidebar"><p>Side {i} text that varies as well</p></div><div class="comments"><p>First! {i}</p></div></div>
<footer>&copy; us</footer></body></html>"""


def test_pages_without_article(spark):
    rows = [(i, f"http://a.example/{i}", SITE.format(i=i)) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"].split("\n\n") for r in wrappers.extract(pages).collect()}
    for i, text in got.items():
        assert f"Text {i} of <page> & more words, long enough to weigh {i}" in text
        assert {f"Second line {i}", f"Third item {i}", f"one {i}"} <= set(text)
        joined = " ".join(text)
        for gone in ("Home", "cookies", "Share", "Side", "First!", "us", "Write", "var a", "Site", "Read on elsewhere"):
            assert gone not in joined.split(), gone
            assert gone not in text


def test_articles_and_comments(spark):
    page = "<body><article class='post'><h1>A</h1><p>b</p><footer>tags</footer><article class='comment'><p>c</p></article></article><article class=post><p>d"
    rows = [(1, "http://B.example:80/x", page), (2, "no address", "<p>plain"), (3, None, None), (4, None, ""), (5, "http://c.example", "x < y <3 &am"), (5, "http://c.example", "<p")]
    rows.append((None, "http://d.example", "<div>" * 300 + "deep" + "<p>w</p>" * 3000))
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, host int")
    got = sorted((str(r["page_id"]), r["text"]) for r in wrappers.extract(pages).collect())
    want = [("1", "A\n\nb\n\nd"), ("2", "plain"), ("3", ""), ("4", ""), ("5", ""), ("5", "x < y <3 &am"), ("None", "\n\n".join(["deep"] + ["w"] * 3000))]
    assert got == want
    assert wrappers.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0, 10**9])
def test_both_ways_to_join(spark, monkeypatch, limit):
    monkeypatch.setattr(wrappers, "_BROADCAST_CHARS", limit)
    got = catalog.QUERIES["op2_wrappers"](spark, "/root/testdata/sf0.001").collect()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted((r["page_id"], plain(r["html"])) for r in pages)


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_text_of_one_page_is_not_the_hosts_own(spark, tag):
    """Nor are headings that all pages have, or texts that differ behind their 200th character."""
    long = "the same words " * 20
    more = "<h2>Only here</h2><blockquote>A quote of one page</blockquote><ul><li>x<li>y</ul><p>A paragraph of one page</p><pre>code of one page</pre>"
    page = "<body><{t} class=c><h1>Title {i}</h1><h2>Ingredients</h2><p>{l}{i}</p><p>Text {i}</p><h3>Method</h3>{more}</{t}><div>Own</div></body>"
    rows = [(i, f"http://a.example/{i}", page.format(t=tag, i=i, l=long, more=more if i == 7 else "")) for i in range(25)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"].split("\n\n") for r in wrappers.extract(pages).collect()}
    for i, text in got.items():
        want = [f"Title {i}", "Ingredients", f"{long}{i}", f"Text {i}", "Method"]
        extra = ["Only here", "A quote of one page", "x", "y", "A paragraph of one page", "code of one page"]
        assert text == (want + extra if i == 7 else want)


@pytest.mark.parametrize("n", [25, 3])
@pytest.mark.parametrize(
    "page",
    [
        "<div class=top><p>Own</p></div><div class=wrap><div class=title><h1>T {i}</h1></div><div class=body><p>lead {i}</p><p>{l} {i}</p></div></div>",
        "<div class=wrap><div class=title><h1>T {i}</h1><p>lead {i}</p></div><div class=one><div><p>{l} {i}</p></div></div></div>",
        "<div class=wrap><h1>T {i}</h1><div class=a><p>lead {i}</p></div><div class=b><div class=x><p>{l} {i}</p></div></div></div>",
    ],
)
def test_region_holds_all_varying_text(spark, page, n):
    long = "many words " * 50
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", page.format(i=i, l=long)) for i in range(n)], "page_id bigint, url string, html string")
    for r in wrappers.extract(pages).collect():
        i, own = r["page_id"], ["Own"] if n < wrappers.SAME_ON and "Own" in page else []
        assert r["text"].split("\n\n") == [*own, f"T {i}", f"lead {i}", f"{long}{i}"]


@pytest.mark.parametrize("tag", ["article", "main"])
def test_marks_inside_an_article(spark, tag):
    page = f"""<div class=sidebar>side</div><{tag}><div class="article-header"><h1 id=search-ads>Title</h1></div><section id='related-work'>
<h2 id='social-impact'>Impact</h2><p class="ad-lib">Text</p></section><section id=comments><p>On comments</p></section><div class="box share">Share</div>
<div class=social-share>me</div><div id=comments>First!</div><nav>go</nav><p hidden>no</p><header><p>By me</p></header></{tag}>"""
    pages = spark.createDataFrame([(1, "http://a.example/", page)], "page_id bigint, url string, html string")
    assert wrappers.extract(pages).first()["text"].split("\n\n") == ["Title", "Impact", "Text", "On comments", "By me"]


def test_ids_of_sections_without_an_article():
    never = lambda page: wrappers.parse(page).items[0].never
    assert not never("<section id=related-work>") and not never("<h2 id=related>")
    assert never("<section id=comments>") and never("<div id=cookie-consent>") and never("<div class=site-header>")


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 5000 + "<p>inmost {i}</p>" + "</div>" * 5000
    wide = "".join(f"<h2>h{k} {{i}}</h2><p>t{k} {{i}}</p>" for k in range(10000))
    odd = wide.replace("<h2>h5000 {i}</h2>", "<h2>h5000 {i}</h2><ul><li>x {i}</ul>")
    rows = [(i, "http://deep.example/", deep.replace("{i}", str(i))) for i in range(3)]
    rows += [(10 + i, "http://wide.example/", t.replace("{i}", str(i))) for i, t in enumerate((wide, odd))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    got = {r["page_id"]: r["text"].split("\n\n") for r in wrappers.extract(df).collect()}
    assert all(got[i] == [f"inmost {i}"] for i in range(3))
    assert len(got[10]) == 20000 and len(got[11]) == 20001 and got[11][10001] == "x 1"


def test_alignment_equals_a_full_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        n, m = len(a), len(b)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        got = list(wrappers._pairs(a, b))
        assert [i for i, _ in got if i is not None] == list(range(n)) and [j for _, j in got if j is not None] == list(range(m))
        both = [(i, j) for i, j in got if i is not None and j is not None]
        assert all(a[i] == b[j] for i, j in both) and len(both) == best[0][0]


def test_a_wrapper_is_read_as_it_was_written():
    tree = wrappers.of_page(wrappers.parse("<div>" * 3000 + "<p>a<p>b <i>c</i>" + "<br>" * 3), 7)
    again = wrappers.Wrapper.load(wrappers.Wrapper(tree, [7]).dump())
    assert again.dump() == wrappers.Wrapper(tree, [7]).dump() and again.seen == {7}
    assert wrappers.Wrapper.load(wrappers.Wrapper().dump()).tree is None
