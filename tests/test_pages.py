import pytest
from pyspark.sql import functions as F

from beatwire.functions.links import decode_entities, first_element, resolve_link
from beatwire.sources import pages as pg

LONG = "A headline that is long enough to keep"


def page(spark, *htmls, url="https://site.example.org/section/index.html?x=1"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)],
                                 "page_id long, url string, html string")


def test_article(spark):
    p30, p31 = "x" * 30, "y" * 31
    df = page(
        spark,
        f"<h1 class='t'> Ti<i>t</i>le &amp; more</h1><h1>2</h1><p>{p30}</p><P a='1'> {p31}\n</P>",
        f"<body><p>{p31}<p>{p31}z<div>no paragraph here, however long it may be</div></body>",
        "<p>short</p>",
        f"<script>var s = '<p>{p31}</p>';</script><!-- <p>{p31}</p> --><p>{p31}&#33;</p>")
    got = {r.page_id: (r.title, r.text) for r in pg.html_article(df).collect()}
    assert got == {0: ("Title & more", p31), 1: ("Unknown Title", f"{p31} {p31}z"),
                   3: ("Unknown Title", p31 + "!")}


def heads(df, **kw):
    return [(r.page_id, r.headline, r.link) for r in
            pg.html_headlines(df, **kw).orderBy("page_id", "kind", "ord", "sub").collect()]


def test_headlines(spark):
    root = "https://site.example.org"
    a = f"<h2>{LONG} 1 <a href='/a?p=1&amp;q=2'>go</a></h2>"
    b = f"<a href='b'><div><h3> {LONG} </h3><h4>{LONG} 3</h4></div></a>"
    c = f"<a href='c'>{LONG} and longer</a>"
    assert heads(page(spark, a + b + c)) == [
        (0, f"{LONG} 1go", f"{root}/a?p=1&q=2"), (0, LONG, f"{root}/section/b"),
        (0, f"{LONG} 3", f"{root}/section/b")]


def test_headlines_fall_back_to_links(spark):
    one = f"<h2><a href='/one'>{LONG}</a></h2>"
    links = ("<a href='/l25'>" + "k" * 25 + "</a><a href='/l24'>" + "k" * 24 + "</a>"
             "<a href='JavaScript:x()'>" + "j" * 30 + "</a><a name='n'>" + "n" * 30 + "</a>"
             "<a href='/m'>" + "ಮತ್ತಷ್ಟು " * 5 + "</a>")
    got = heads(page(spark, one + links), deny=["ಮತ್ತಷ್ಟು"])
    assert [g[1] for g in got] == [LONG, LONG, "k" * 25]       # the heading, then every long link
    tel = f"<h2><a href='tel:1'>{LONG}</a></h2><h2><a href='javascript:1'>{LONG}</a></h2>"
    assert [g[2] for g in heads(page(spark, tel))] == ["tel:1"]
    twenty = "<h2><a href='/x'>" + "t" * 20 + "</a></h2>"
    assert heads(page(spark, twenty)) == []


def test_anchors(spark):
    html = (f"<a href='/h'>menu <span>{LONG}</span> tail</a>"
            f"<a href='t' title=' {LONG} 2'>x</a>"
            f"<a href='https://o.example.net/z'>{LONG} <b>3</b></a>"
            "<a href='/s'>short</a>"
            f"<a href='/two'><h2>{LONG} <span>4</span> end</h2></a>")
    df = page(spark, html)
    got = [(r.title, r.link) for r in pg.html_anchors(df).orderBy("ord").collect()]
    assert got == [(LONG, "https://site.example.org/h"), (f"{LONG} 2", "https://site.example.org/t"),
                   (f"{LONG} 3", "https://o.example.net/z"),
                   (f"{LONG} 4 end", "https://site.example.org/two")]
    plain = pg.html_anchors(df, ["heading", "text"], "h[1-4]", 21).orderBy("ord").collect()
    assert [r.title for r in plain] == [f"menu {LONG} tail", f"{LONG} 3", f"{LONG} 4 end"]


def test_census(spark):
    many = "".join(f"<h2><a href='/{i}'>t{i}</a></h2>" for i in range(7))
    df = page(spark, many + f"<h2>no link</h2><a href='/x'>{LONG}</a>").unionByName(
        page(spark, "<p>nothing</p>", url="http://empty.example.org"))
    got = {r.site: r for r in pg.link_census(df).collect()}
    one = got["site.example.org"]
    assert (one.n_headings, one.n_links) == (7, 1)
    assert one.heading_samples == "t0 | t1 | t2 | t3 | t4" and one.link_samples == LONG
    none = got["empty.example.org"]
    assert (none.n_headings, none.n_links, none.heading_samples) == (0, 0, "")


def test_links_and_entities(spark, value):
    df = spark.createDataFrame(
        [("https://a.example.org/x/y?z", h) for h in ("/p", "p", "../p", "http://b/q", "//c/d")],
        "base string, href string")
    prefix = [r[0] for r in df.select(resolve_link(F.col("base"), F.col("href"))).collect()]
    assert prefix == ["https://a.example.org/p", "https://a.example.org/p",
                      "https://a.example.org/../p", "http://b/q", "https://a.example.org//c/d"]
    rfc = [r[0] for r in df.select(resolve_link(F.col("base"), F.col("href"), "rfc")).collect()]
    assert rfc == ["https://a.example.org/p", "https://a.example.org/x/p",
                   "https://a.example.org/p", "http://b/q", "https://c/d"]
    with pytest.raises(ValueError):
        resolve_link(F.lit(""), F.lit(""), "other")
    assert value(decode_entities, "a &amp;lt; &lt;b&gt; &#8377;5 &#x20B9; &nosuch; & x", None) == [
        "a &lt; <b> ₹5 ₹ &nosuch; & x", None]


def test_rfc_examples(spark):
    """The examples of RFC 3986, section 5.4."""
    base = "http://a/b/c/d;p?q"
    cases = {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/",
             "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y",
             "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
             "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "": base, ".": "http://a/b/c/",
             "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
             "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g",
             "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.",
             "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
             "http://[bad": None, "//x]y": None, "//[::1]/p": "http://[::1]/p"}
    df = spark.createDataFrame([(base, h) for h in cases], "b string, h string")
    got = [r[0] for r in df.select(resolve_link(F.col("b"), F.col("h"), "rfc")).collect()]
    assert dict(zip(cases, got)) == cases


def test_all_references(value):
    cases = {"&eacute;&Eacute;&NotEqualTilde;": "éÉ≂̸", "&#X41;&#x00041;&#0000039;": "AA'",
             "&amp;lt; &#38;gt;": "&lt; &gt;", "&#xD83D;&#0;&#x110000;&#99999999999;": "\ufffd" * 4,
             "&nosuch; a & b &": "&nosuch; a & b &", "plain": "plain"}
    assert value(decode_entities, *cases) == list(cases.values())


def test_brackets_in_attributes(spark):
    text = "A paragraph that is long enough to be kept in the article"
    got = pg.html_article(page(spark, f"<h1 title='a>b'>T</h1><p title='a>b' data-x=\"<p>\">{text}</p>"))
    assert [(r.title, r.text) for r in got.collect()] == [("T", text)]


def test_nested_elements_in_a_link(spark):
    df = page(spark, f"<a href='/x'><span><span>LIVE</span> {LONG}</span></a>")
    got = pg.html_anchors(df).collect()
    assert [(r.title, r.link) for r in got] == [(f"LIVE {LONG}", "https://site.example.org/x")]


@pytest.mark.parametrize("inner, want", [
    ("<span>one <span>two</span> three</span><span>four</span>", "one <span>two</span> three"),
    ("x<SPAN a='>'>one</Span> y", "one"),
    ("<span><span><span>a</span></span>b</span>c</span>", "<span><span>a</span></span>b"),
    ("<h2>a <span>b</span> c</h2><span>d</span>", "a <span>b</span> c"),
    ("<span>never <b>closed</b>", "never <b>closed</b>"),
    ("<span></span>rest", ""), ("<spans>no</spans>", None), ("", None), (None, None),
    ("<span>" * 300 + "deep" + "</span>" * 300 + "<span>x</span>", "<span>" * 299 + "deep" + "</span>" * 299)])
def test_first_element_ends_at_its_own_close(value, inner, want):
    assert value(lambda c: first_element(c, "h[1-4]|span"), inner) == [want]


def test_a_sibling_is_no_part_of_the_title(spark):
    html = f"<a href='/x'><span>{LONG} <span>two</span></span> <span>not this</span></a>"
    assert [r.title for r in pg.html_anchors(page(spark, html)).collect()] == [f"{LONG} two"]


def test_references_without_a_semicolon(spark, value):
    cases = {"a &amp b &ltc&gt &#65 &#x42,": "a & b <c> A B,", "&copy2024 &notin; &eacutee": "©2024 ∉ ée",
             "&am x &nosuch y &": "&am x &nosuch y &", "&ampamp;": "&amp;"}
    assert value(decode_entities, *cases) == list(cases.values())
    html = f"<a href='/x?a=1&copy=2&lt=3&amp;b=4&#38;c'>{LONG}</a>"
    assert [r.link for r in pg.html_anchors(page(spark, html)).collect()] == [
        "https://site.example.org/x?a=1&copy=2&lt=3&b=4&c"]


@pytest.mark.parametrize("hidden", ["<script>var a = '", "<!-- ", "<style>p {", "<script src=x>"])
def test_unclosed_hidden_parts_run_to_the_end(spark, hidden):
    first, second = "x" * 40, "y" * 40
    got = pg.html_article(page(spark, f"<p>{first}</p>{hidden}<p>{second}</p>")).collect()
    assert [r.text for r in got] == [first]
    closed = {"<!-- ": "-->", "<style>p {": "</style >"}.get(hidden, "</SCRIPT\n>")
    got = pg.html_article(page(spark, f"<p>{first}</p>{hidden}{closed}<p>{second}</p>")).collect()
    assert [r.text for r in got] == [f"{first} {second}"]
