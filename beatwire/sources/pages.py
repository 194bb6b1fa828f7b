"""Landed web pages to articles, headlines and links, without leaving the JVM.

Elements are cut out by regular expressions over the visible page. Headings,
links and paragraphs do not nest in themselves, as the HTML standard demands;
an unclosed paragraph ends where the standard says it does. Titles inside links
may nest and are followed to their own end by counting depth.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatwire.functions.links import (
    REST, attribute, first_element, joined, plain, resolve_link, site_host, visible,
)
from beatwire.functions.text import strip_space
from beatwire.session import written

H1 = rf"(?is)<h1\b{REST}>(.*?)</h1>"
PARAGRAPH_START = rf"(?i)<p\b{REST}>"

# Fixed values of the HTML standard: tags whose start or end closes an open
# paragraph.
PARAGRAPH_END = (
    r"(?i)</(?:p|article|aside|blockquote|body|div|footer|header|html|li|main|nav|section|td)\b"
    r"|<(?:address|article|aside|blockquote|details|dialog|div|dl|fieldset|figcaption|figure"
    r"|footer|form|h[1-6]|header|hgroup|hr|main|menu|nav|ol|pre|search|section|table|ul)\b")

LINK = rf"(?is)<a\b{REST}>.*?</a>"
LINK_TAG = rf"(?is)^(<a\b{REST}>)"
LINK_INNER = rf"(?is)^<a\b{REST}>(.*)</a>$"
LINK_TAG_INSIDE = r"(?is)(<a\b[^>]*\bhref\b[^>]*>)"
HEADING = rf"(?is)<h[2-4]\b{REST}>.*?</h[2-4]>"
CENSUS_HEADING = rf"(?is)<h[1-4]\b{REST}>.*?</h[1-4]>"
HEADING_OR_LINK = rf"(?is)<a\b{REST}>.*?</a>|<h[2-4]\b{REST}>.*?</h[2-4]>"

NO_TITLE = "Unknown Title"


def html_article(pages: DataFrame, min_paragraph: int = 31) -> DataFrame:
    """One article per page: first ``h1``, and the paragraphs that are long enough.

    Pages without such a paragraph give no row.
    """
    body = visible(F.col("html"))
    heading = F.regexp_extract(body, H1, 1)
    title = F.when(F.rlike(body, F.lit(H1)), plain(heading)).otherwise(F.lit(NO_TITLE))
    parts = F.split(body, PARAGRAPH_START)
    opened = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    texts = F.transform(opened, lambda p: plain(F.element_at(F.split(p, PARAGRAPH_END, 2), 1)))
    text = F.array_join(F.filter(texts, lambda t: F.length(t) >= min_paragraph), " ")
    return (pages.select("page_id", "url", title.alias("title"), text.alias("text"))
            .where(F.col("text") != ""))


def _matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _lacks(c: Column, words: Sequence[str]) -> Column:
    cond = F.lit(True)
    for w in words:
        cond = cond & ~F.contains(c, F.lit(w))
    return cond


def _links(body: Column) -> Column:
    """Links with an address, in page order: ord, tag, inner, href."""
    found = F.transform(_matches(body, LINK), lambda link, i: F.struct(
        i.alias("ord"),
        F.regexp_extract(link, LINK_TAG, 1).alias("tag"),
        F.regexp_extract(link, LINK_INNER, 1).alias("inner")))
    with_href = F.transform(found, lambda s: F.struct(
        s["ord"].alias("ord"), s["tag"].alias("tag"), s["inner"].alias("inner"),
        attribute(s["tag"], "href").alias("href")))
    return F.filter(with_href, lambda s: s["href"].isNotNull())


def _linked_headings(body: Column) -> Column:
    """Headings of level 2-4 that hold a link or stand inside one.

    The page is cut into links and headings, whichever opens first. A cut that
    opens with a link may hold several headings, all with its address.
    """
    def headings(part: Column, i: Column) -> Column:
        around = attribute(F.regexp_extract(part, LINK_TAG, 1), "href")
        return F.transform(_matches(part, HEADING), lambda h, j: F.struct(
            i.alias("ord"), j.alias("sub"), joined(h).alias("headline"),
            F.coalesce(attribute(F.regexp_extract(h, LINK_TAG_INSIDE, 1), "href"),
                       around).alias("href")))

    return F.filter(F.flatten(F.transform(_matches(body, HEADING_OR_LINK), headings)),
                    lambda s: s["href"].isNotNull())


def html_headlines(pages: DataFrame, min_head: int = 21, min_link: int = 25,
                   min_found: int = 2, deny: Sequence[str] = ()) -> DataFrame:
    """Headlines of a page: linked headings, and all long links if those are few.

    Everything is decided within the row of the page, so nothing is shuffled.
    Rows: page_id, url, kind (0 heading, 1 link), ord, sub, headline, link.
    """
    heads = F.filter(_linked_headings(F.col("body")), lambda s: (
        (F.length(s["headline"]) >= min_head)
        & _lacks(F.lower(s["href"]), ["javascript", "tel:"])))
    links = F.transform(_links(F.col("body")), lambda s: F.struct(
        s["ord"].alias("ord"), F.lit(0).alias("sub"),
        joined(s["inner"]).alias("headline"), s["href"].alias("href")))
    links = F.filter(links, lambda s: (
        (F.length(s["headline"]) >= min_link)
        & _lacks(F.lower(s["href"]), ["javascript"]) & _lacks(s["headline"], deny)))

    def marked(items: Column, kind: int) -> Column:
        return F.transform(items, lambda s: F.struct(
            F.lit(kind).alias("kind"), s["ord"].alias("ord"), s["sub"].alias("sub"),
            s["headline"].alias("headline"), s["href"].alias("href")))

    found = F.when(F.size("heads") < min_found,
                   F.concat(marked(F.col("heads"), 0), marked(links, 1))).otherwise(
                       marked(F.col("heads"), 0))
    return (pages.select("page_id", "url", visible(F.col("html")).alias("body"))
            .select("page_id", "url", "body", heads.alias("heads"))
            .select("page_id", "url", F.explode(found).alias("s"))
            .select("page_id", "url", "s.kind", "s.ord", "s.sub", "s.headline",
                    resolve_link(F.col("url"), F.col("s.href"), "rfc").alias("link")))


def html_anchors(pages: DataFrame, title_from: Sequence[str] = ("heading", "attr", "text"),
                 heading_tags: str = "h[1-4]|span", min_len: int = 26) -> DataFrame:
    """Links with a title: first nested heading, else ``title`` attribute, else text.

    ``title_from`` names the places to look, ``heading_tags`` the elements
    that count as a heading. Addresses are made absolute by the prefix rule.
    """
    heading = first_element(F.col("s.inner"), heading_tags)
    attr = F.coalesce(attribute(F.col("s.tag"), "title"), F.lit(""))
    places = {
        "heading": (heading.isNotNull(), plain(heading)),
        "attr": (attr != "", strip_space(attr)),
        "text": (F.lit(True), plain(F.col("s.inner"))),
    }
    title = F.coalesce(*[F.when(*places[p]) for p in title_from])
    return (pages.select("page_id", "url", F.explode(_links(visible(F.col("html")))).alias("s"))
            .select("page_id", "url", "s.ord", title.alias("title"),
                    resolve_link(F.col("url"), F.col("s.href"), "prefix").alias("link"))
            .where(F.length("title") >= min_len))


def link_census(pages: DataFrame, min_link: int = 26, samples: int = 5) -> DataFrame:
    """Per site: linked headings, long links, and the first few of each.

    Pages are cut up once; what is found is kept as a table. The samples are
    picked by rank before they are collected, so no list grows with the site.
    """
    body = visible(F.col("html"))
    heads = F.filter(
        F.transform(_matches(body, CENSUS_HEADING), lambda h, i: F.struct(
            F.lit("heading").alias("kind"), i.alias("ord"),
            joined(F.regexp_extract(h, LINK, 0)).alias("text"))),
        lambda s: s["text"] != "")
    links = F.filter(
        F.transform(_matches(body, LINK), lambda a, i: F.struct(
            F.lit("link").alias("kind"), i.alias("ord"), joined(a).alias("text"))),
        lambda s: F.length(s["text"]) >= min_link)
    found = (pages.select(site_host(F.col("url")).alias("site"), "page_id",
                          F.explode_outer(F.concat(heads, links)).alias("s"))
             .select("site", "page_id", "s.*"))
    found = written(found, "census")
    counts = found.groupBy("site").agg(
        F.count_if(F.col("kind") == "heading").alias("n_headings"),
        F.count_if(F.col("kind") == "link").alias("n_links"))
    first = W.partitionBy("site", "kind").orderBy("page_id", "ord")
    picked = (found.withColumn("rn", F.row_number().over(first))
              .where(F.col("rn") <= samples)
              .groupBy("site").agg(*[
                  F.array_join(F.transform(
                      F.array_sort(F.collect_list(F.when(
                          F.col("kind") == kind, F.struct("rn", "text")))),
                      lambda s: s["text"]), " | ").alias(f"{kind}_samples")
                  for kind in ("heading", "link")]))
    return (counts.join(picked, "site", "left")
            .select("site", "n_headings", "n_links",
                    F.coalesce("heading_samples", F.lit("")).alias("heading_samples"),
                    F.coalesce("link_samples", F.lit("")).alias("link_samples")))
