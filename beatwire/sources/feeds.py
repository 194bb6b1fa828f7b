"""Feed entries to article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatwire.functions.dates import feed_date
from beatwire.functions.text import strip_space
from beatwire.schemas import ATOM_ENTRY, FEED_ITEM, RSS_ITEM
from beatwire.session import written


def entry_text(title: Column, summary: Column) -> Column:
    """Body of a feed article: ``title. summary``. Never empty."""
    return strip_space(F.concat(title, F.lit(". "), summary))


def entries_to_articles(entries: DataFrame, source: Column | str,
                        ingested: Column | None = None) -> DataFrame:
    """Feed items (schema FEED_ITEM) to articles; other columns pass through."""
    source = F.lit(source) if isinstance(source, str) else source
    ingested = F.current_timestamp() if ingested is None else ingested
    title = strip_space(F.coalesce("title", F.lit("")))
    summary = strip_space(F.coalesce("description", F.lit("")))
    rest = [c for c in entries.columns if c not in FEED_ITEM.names and c != "source"]
    return entries.select(
        *rest,
        title.alias("title"),
        entry_text(title, summary).alias("text"),
        feed_date(F.col("pubDate"), F.col("updated"), ingested).alias("date"),
        strip_space(F.coalesce("link", F.lit(""))).alias("url"),
        source.alias("source"))


def _rss_items(parsed: DataFrame, rest: list[str]) -> DataFrame:
    return parsed.select(*rest, "title", F.coalesce("description", "encoded").alias("description"),
                         "link", F.coalesce("pubDate", "date").alias("pubDate"), "updated")


def _atom_items(parsed: DataFrame, rest: list[str]) -> DataFrame:
    """The address of an entry is its alternate link, else its first one."""
    plain = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    address = F.coalesce(F.get(plain, F.lit(0))["_href"], F.get("link", F.lit(0))["_href"])
    return parsed.select(*rest, "title", F.coalesce("summary", "content").alias("description"),
                         address.alias("link"), F.col("published").alias("pubDate"), "updated")


# Layout of a feed: element of an entry, its schema, and how it becomes a FEED_ITEM.
FORMATS = {"rss": ("item", RSS_ITEM, _rss_items), "atom": ("entry", ATOM_ENTRY, _atom_items)}
BROKEN = "_broken"


def read_feeds(spark: SparkSession, path: str, kind: str = "rss") -> tuple[DataFrame, DataFrame]:
    """Landed feed files: their entries as FEED_ITEM, and beside them what is no XML.

    ``ord`` grows in file order. Folders named ``source=...`` name the feeds;
    other partition columns pass through as well. With ``kind`` "any" every file
    is read for the entries of either layout; a feed has those of one.
    """
    if kind == "any":
        read = [read_feeds(spark, path, k) for k in FORMATS]
        return (read[0][0].unionByName(read[1][0]), read[0][1].unionByName(read[1][1]).distinct())
    tag, schema, items = FORMATS[kind]
    wide = T.StructType(schema.fields + [T.StructField(BROKEN, T.StringType())])
    raw = (spark.read.schema(wide).format("xml").option("rowTag", tag).option("mode", "PERMISSIVE")
           .option("ignoreNamespace", True).option("columnNameOfCorruptRecord", BROKEN).load(path))
    raw = written(raw.withColumn("ord", F.monotonically_increasing_id()), "feed")
    rest = [c for c in raw.columns if c not in wide.names]
    return (items(raw.where(F.col(BROKEN).isNull()), rest),
            raw.where(F.col(BROKEN).isNotNull()).select(*rest, BROKEN))


def parse_items(df: DataFrame, xml_col: str, kind: str = "rss") -> tuple[DataFrame, DataFrame]:
    """A column of entry elements: entries as FEED_ITEM, and the rows that are no XML."""
    _, schema, items = FORMATS[kind]
    wide = T.StructType(schema.fields + [T.StructField(BROKEN, T.StringType())])
    parsed = F.from_xml(F.col(xml_col), wide, {
        "mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": BROKEN})
    rest = [c for c in df.columns if c != xml_col]
    rows = df.select(*rest, parsed.alias("item")).select(*rest, "item.*")
    return (items(rows.where(F.col(BROKEN).isNull()), rest),
            rows.where(F.col(BROKEN).isNotNull()).select(*rest, BROKEN))
