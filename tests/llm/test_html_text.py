import re
from html import unescape
from pathlib import Path

import pytest

from beatwire.llm.catalog import QUERIES
from beatwire.llm.html_text import best_run, extract_text, learn, main_text

WORDS = "The quick brown fox jumps over the lazy dog and then some more words follow here."
PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>"
        "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
        "%s<footer>&copy; x</footer></body></html>")
WEIGHTS = learn([PAGE % f"<article><h1>Head</h1><p>{WORDS}</p><p>{WORDS}</p></article>"] * 5)


def text(body):
    return main_text(PAGE % body, WEIGHTS)


def test_best_run_by_trying_all():
    scores = [-1, 2, 3, -4, 5, -1, 5, -9, 4]
    start, end = best_run(scores)
    assert sum(scores[start:end]) == max(sum(scores[i:j]) for i in range(9) for j in range(i, 10))
    assert best_run([-1, -2]) == (0, 0)


@pytest.mark.parametrize("body,want", [
    (f"<article><h1>Head</h1><p>{WORDS}</p></article>", f"Head {WORDS}"),
    (f"<article><p>a &amp;&eacute;&#X41;&nbsp;&lt;b&gt; &am</p><p>{WORDS}</article>",
     f"a &éA <b> &am {WORDS}"),
    (f"<article><p title='a>b'>one<b>two</b> three<br>four<p>{WORDS}</article>",
     f"onetwo three four {WORDS}"),
    (f"<article><p>{WORDS}</p><aside>no</aside><div class='ad'>no</div><form>no<input></form>"
     f"<script>var t='</p>';</script><!-- <p>no</p> --><p>{WORDS}</p>"
     f"<section id='comments'><p>{WORDS}</p></section></article>", f"{WORDS} {WORDS}"),
    (f"<header><p>Site name</p></header><div class='cookie-notice'><p>{WORDS}</p></div>"
     f"<main><article><header><h1>Head</h1></header><p>{WORDS}</p></article></main>"
     f"<div class='sidebar'><p>{WORDS}</p></div>", f"Head {WORDS}"),
    (f"<div><div><p>{WORDS}</p><p>{WORDS}</p></div></div><section class='comments'><p>{WORDS}</p>"
     "</section>", f"{WORDS} {WORDS}"),
    (f"<article><p>{WORDS}\n\n  {WORDS}</p>\t<ul><li>one</li><li>two</li></ul><p>{WORDS}</p></article>",
     f"{WORDS} {WORDS} one two {WORDS}"),
])
def test_pages(body, want):
    assert text(body) == want


@pytest.mark.parametrize("icon", [
    "<svg/>", '<svg class="i" />', "<SVG class=i/>", "<math/>", "<svg><path d='M0'/><text>no</text></svg>"])
def test_text_after_an_icon(icon):
    assert text(f"<article><p>A{icon}B</p><p>{WORDS}</p></article>") == f"A B {WORDS}"
    assert text(f"<article><p>A{icon}B</p><p>{WORDS}</p><svg><text>no</text></svg><p>C</p></article>"
                ) == f"A B {WORDS} C"


BOX = "<a href='/x'>More of this</a> " * 40
PARTS = {
    "list": ("<h1>Recipe</h1><ul><li>two eggs</li><li>a cup of flour</li></ul>", "Recipe two eggs a cup of flour"),
    "table": ("<table><tr><th>Year</th><th>Sum</th></tr><tr><td>1999</td><td>12 tons</td></tr></table>",
              "Year Sum 1999 12 tons"),
    "definitions": ("<dl><dt>Flour</dt><dd>ground corn</dd></dl>", "Flour ground corn"),
    "caption": ("<figure><img src=x><figcaption>The old mill</figcaption></figure>", "The old mill"),
    "links": ("<p><a href=a>One report</a>, <a href=b>another report</a></p>", "One report, another report"),
    "aside": (f"<aside>{BOX}</aside>", ""),
    "related": (f"<div class='related'><h3>Related</h3><ul><li>{BOX}</li></ul></div>", ""),
    "advert": (f"<div class=ad>{f'<p>{WORDS}</p>' * 4}</div>", ""),
    "newsletter": (f"<section class='newsletter-box'><p>{WORDS}</p><form><input>{WORDS}</form></section>", ""),
    "share": ("<ul class='share'><li><a href=x>Post</a></li><li><a href=y>Mail</a></li></ul>", ""),
    "apostrophe": ("<script src=a'>var x = 1;</script><p title=it's>Quoted</p>", "Quoted"),
    "quote": ("<p data-x=5\">Inches</p>", "Inches"),
    "arrow": ('<p title="a>b">Arrow</p>', "Arrow"),
}


def around(part):
    """The part between, in front of and behind paragraphs, with the text it should give."""
    html, plain = PARTS[part]
    yield f"<p>{WORDS}</p>{html}<p>{WORDS}</p>", f"{WORDS} {plain} {WORDS}"
    yield f"{html}<p>{WORDS}</p>", f"{plain} {WORDS}"
    yield f"<p>{WORDS}</p>{html}", f"{WORDS} {plain}"
    yield f"<p>Short.</p>{html}<p>Mix it all well together.</p>", f"Short. {plain} Mix it all well together."


@pytest.mark.parametrize("mark", ["article", "main"])
@pytest.mark.parametrize("part", PARTS)
def test_a_marked_article_is_kept_whole(part, mark):
    for html, want in around(part):
        assert text(f"<{mark}>{html}</{mark}><p>Beside it.</p>") == " ".join(want.split())


@pytest.mark.parametrize("part", PARTS)
def test_parts_between_paragraphs_of_an_unmarked_article(part):
    html, want = next(around(part))
    assert text(f"<div>{html}</div>") == " ".join(want.split())


@pytest.mark.parametrize("part", ["list", "table", "definitions", "caption"])
def test_parts_at_the_end_of_an_unmarked_article(part):
    for html, want in list(around(part))[:3]:
        assert text(f"<div>{html}</div>") == want


def test_a_mark_without_the_article_is_no_mark():
    assert text(f"<main><p>Welcome</p></main><div><p>{WORDS}</p><p>{WORDS}</p></div>").endswith(
        f"{WORDS} {WORDS}")


def test_pages_of_links_outside_of_an_article():
    menu = "".join(f"<li><a href='/{i}'>Page {i}</a></li>" for i in range(30))
    assert text(f"<div><ul>{menu}</ul></div><div><p>{WORDS}</p><p>{WORDS}</p></div><div><ul>{menu}</ul></div>"
                ) == f"{WORDS} {WORDS}"


def test_the_sample_does_not_depend_on_the_split(spark):
    from beatwire.llm import html_text
    pages = spark.range(900).selectExpr(
        "id AS page_id", "'u' AS url", f"concat('<article><p>', id, ' word</p>', repeat('<hr>', id % 9), '</article>"
        "<p>', repeat('out ', id % 7), '</p>') AS html")
    one, two = (html_text.learn_weights(pages.repartition(n)) for n in (1, 7))
    assert one == two


def test_broken_pages():
    assert main_text(f"<article><p>{WORDS}", WEIGHTS) == WORDS
    assert main_text(f"<article><p>{WORDS}</p><p class=\"x", WEIGHTS) == WORDS
    assert main_text(f"<nav><a>x</a><article><p>{WORDS}</article>", WEIGHTS) == WORDS
    assert main_text("plain words only", WEIGHTS) == "plain words only"
    assert main_text("<" * 50_000, WEIGHTS).count("<") <= 50_000
    assert main_text("<a \"" * 20_000, WEIGHTS) == ""


@pytest.mark.parametrize("page", [
    PAGE % f"<form action='/x.aspx'><input><div><h1>Head</h1><p>{WORDS}</p><p>{WORDS}</p></div></form>",
    PAGE % f"<div class='content widget'><h1>Head</h1><p>{WORDS}</p><p>{WORDS}</p></div>",
    PAGE % (f"<p>Skip to it</p><div class='content has-sidebar no-comments ad-free'><h1>Head</h1>"
            f"<p>{WORDS}</p><p>{WORDS}</p></div>"),
    PAGE % f"<header><p>Name</p><h1>Head</h1><p>{WORDS}</p><p>{WORDS}</p>",
    f"<head><meta charset=x><title>T</title><body><h1>Head</h1><p>{WORDS}</p><p>{WORDS}</p></body>",
    f"<head><title>T</title><link href=x><h1>Head</h1><p>{WORDS}</p><p>{WORDS}</p>",
])
def test_elements_around_the_article(page):
    """A form, a class or an omitted end tag around all words drops none of them."""
    assert f"Head {WORDS} {WORDS}" in main_text(page, WEIGHTS)


def test_elements_beside_the_article():
    side = f"<div class='sidebar'><p>{WORDS}</p></div><section id='comments'><p>{WORDS}</p></section>"
    assert text(f"<form><div><p>{WORDS}</p><p>{WORDS}</p></div>{side}</form>") == f"{WORDS} {WORDS}"
    replies = f"<section id='comments'>{f'<p>{WORDS}</p>' * 5}</section>"
    assert text(f"<div><p>{WORDS}</p></div>{replies}") == WORDS
    assert text(f"<article><p>{WORDS}</p>{replies}</article>") == WORDS
    assert text(f"<article><p>{WORDS}</p></article><form>{f'<p>{WORDS}</p>' * 5}</form>") == WORDS
    assert text(f"<article><div class='post widget'><p>{WORDS}</p></div></article>") == WORDS
    assert text("") == ""


def test_operator_cases(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, "u", PAGE % f"<article><p>{WORDS}</p></article>"), (2, None, None), (3, "u", ""),
            (None, "u", "<p>é 🙂</p>"), (1, "u", PAGE % f"<article><p>{WORDS}</p></article>"),
            (5, "u", f"<article><p>{long}</p></article>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows],
                                  "page_id long, url string, html string, text string")
    got = extract_text(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted(
        [(1, WORDS, len(WORDS))] * 2 + [(2, "", 0), (3, "", 0), (0, "é 🙂", 3), (5, long, len(long))])
    assert {r.page_id: r.url for r in got}[2] is None
    assert extract_text(pages.limit(0)).collect() == []


def marked_text(html):
    """What the page itself marks as its article."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", html, re.S)[1]
    return " ".join(unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inner).replace("<b>", "")
                             .replace("</b>", "")).split())


def test_query_against_marked_articles(spark):
    tables = Path("/root/testdata/sf0.01")
    if not tables.exists():
        pytest.skip("no test tables")
    html = {r.page_id: r.html for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
    rows = QUERIES["op1_html_text"](spark, str(tables)).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r.text == marked_text(html[r.page_id]) and r.n_chars == len(r.text)


def test_article_found_without_its_mark(spark):
    """The scan finds the article where nothing marks it."""
    tables = Path("/root/testdata/sf0.01")
    if not tables.exists():
        pytest.skip("no test tables")
    pages = [r.html for r in spark.read.parquet(f"{tables}/pages.parquet").collect()]
    weights = learn(pages[:100])
    plain = [re.sub(r"</?article>", "", h) for h in pages[100:]]
    right = sum(main_text(p, weights) == marked_text(h) for p, h in zip(plain, pages[100:]))
    assert right >= 0.98 * len(plain)
