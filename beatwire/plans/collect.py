"""Landed feeds and pages of the outlets to one article table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwire.dims import MORE_LINK_WORDS
from beatwire.functions.links import site_host
from beatwire.operators.merge import cap_dedupe, union_sources
from beatwire.sources.feeds import entries_to_articles
from beatwire.sources.pages import html_anchors, html_headlines

# How titles are taken from links: Hindi sites mark them up in more ways.
HINDI = {"title_from": ("heading", "attr", "text"), "heading_tags": "h[1-4]|span", "min_len": 26}
REGIONAL = {"title_from": ("heading", "text"), "heading_tags": "h[1-4]", "min_len": 21}


def from_feeds(items: DataFrame, registry: DataFrame, cap: int = 20,
               ingested: Column | None = None) -> DataFrame:
    """Feed items (FEED_ITEM, source, ord): ``cap`` per feed, then one per address."""
    rows = entries_to_articles(items, F.col("source"), ingested)
    ranked = rows.join(registry.select("source", "rank"), "source")
    return cap_dedupe(ranked, "source", "url", cap, "rank", "ord", "cap_first").select(
        "title", "text", "date", "url", "source")


def from_pages(pages: DataFrame, registry: DataFrame, day: Column,
               cap: int = 20) -> list[DataFrame]:
    """Headline pages, Hindi link pages and regional link pages of known outlets.

    One title (headline pages) or address (link pages) per outlet, then the cap.
    """
    homes = registry.where(F.col("kind") != "rss").select(
        site_host(F.col("home")).alias("host"), "source", "kind", "language", "rank")

    def landed(which: Column) -> DataFrame:
        hosts = homes.where(which).select("host")
        return pages.join(hosts, site_host(F.col("url")) == F.col("host"), "left_semi")

    def rows(found: DataFrame, title: str, place: list[str], key: str) -> DataFrame:
        named = (found.withColumn("place", F.struct(*place)).drop("kind")
                 .withColumn("host", site_host(F.col("url"))).join(homes, "host"))
        kept = cap_dedupe(named, "source", key, cap, "rank", "place", "dedupe_first")
        return kept.select(F.col(title).alias("title"), F.col(title).alias("text"),
                           day.alias("date"), F.col("link").alias("url"), "source", "language")

    hindi = F.col("language") == "hi"
    headlines = html_headlines(landed(F.col("kind") == "headlines"), deny=MORE_LINK_WORDS)
    return [
        rows(headlines, "headline", ["page_id", "kind", "ord", "sub"], "headline")
        .drop("language"),
        rows(html_anchors(landed((F.col("kind") == "anchors") & hindi), **HINDI),
             "title", ["page_id", "ord"], "link"),
        rows(html_anchors(landed((F.col("kind") == "anchors") & ~hindi), **REGIONAL),
             "title", ["page_id", "ord"], "link"),
    ]


def collect_articles(items: DataFrame, pages: DataFrame, registry: DataFrame, day: Column,
                     cap: int = 20) -> DataFrame:
    """All collections, feeds first; ``source_rank`` numbers the collection."""
    return union_sources(from_feeds(items, registry, cap, day.cast("timestamp")),
                         *from_pages(pages, registry, day, cap))
