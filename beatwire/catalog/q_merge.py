"""Unions, de-duplication, caps and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatwire.catalog.registry import query, table
from beatwire.catalog.views import ARTICLES_SQL, articles
from beatwire.operators import merge as mg

CAP = 15


def _group_cols(spark, sf_dir):
    """articles with the position of their feed, ``src7`` being feed 7."""
    return articles(spark, sf_dir).select("doc_id", "ord", "title", "url", "source").withColumn(
        "feed_rank", F.substring("source", 4, 9).cast("int"))


_FEEDS = f"{ARTICLES_SQL}, feeds AS (SELECT *, CAST(substr(source, 4) AS INT) AS feed_rank FROM articles)"


@query("rss_cap_then_dedupe", f"""WITH {_FEEDS},
capped AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn FROM feeds),
kept AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY feed_rank, ord) AS un
  FROM capped WHERE rn <= {CAP})
SELECT doc_id, url, source FROM kept WHERE un = 1""")
def cap_then_dedupe(spark, sf_dir):
    return mg.cap_dedupe(_group_cols(spark, sf_dir), "source", "url", CAP, "feed_rank", "ord",
                         "cap_first").select("doc_id", "url", "source")


@query("site_dedupe_then_cap", f"""WITH {_FEEDS},
single AS (SELECT *, row_number() OVER (PARTITION BY source, title ORDER BY ord) AS hn
  FROM feeds),
kept AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn
  FROM single WHERE hn = 1)
SELECT doc_id, title, source FROM kept WHERE rn <= {CAP}""")
def dedupe_then_cap(spark, sf_dir):
    """One article per title of a source, then the cap."""
    return mg.cap_dedupe(_group_cols(spark, sf_dir), "source", "title", CAP, "feed_rank", "ord",
                         "dedupe_first").select("doc_id", "title", "source")


@query("source_dedupe_then_cap", f"""WITH {_FEEDS},
single AS (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY ord) AS hn FROM feeds),
kept AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn
  FROM single WHERE hn = 1)
SELECT doc_id, url, source FROM kept WHERE rn <= {CAP}""")
def source_dedupe_then_cap(spark, sf_dir):
    return mg.cap_dedupe(_group_cols(spark, sf_dir), "source", "url", CAP, "feed_rank", "ord",
                         "dedupe_first").select("doc_id", "url", "source")


@query("cap_large", """SELECT event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 1200""")
def cap_large(spark, sf_dir):
    """The first 1,200 events of each kind: more than Spark cuts down before a shuffle."""
    return mg.first_per(table(spark, sf_dir, "events"), ["event_type"],
                        [F.asc("ts"), F.asc("event_id")], 1_200).select("event_id", "event_type")


def batches(spark, sf_dir):
    """A new batch, the articles with an odd id, and an old one, the rest.

    A repeated address belongs to two neighbouring ids, so to both batches.
    ``ord`` is the place in the feed: it repeats over feeds and some rows have none.
    """
    df = articles(spark, sf_dir).select("doc_id", "title", "date", "url", "source").withColumn(
        "ord", F.when(F.col("doc_id") % 23 != 0, F.floor(F.col("doc_id") / 20)))
    late = F.col("doc_id") % 2 == 1
    return df.where(late), df.where(~late)


PLACE_SQL = "batch_rank, ord NULLS LAST, date, doc_id"
BATCHES_SQL = f"""{ARTICLES_SQL}, rowsx AS (SELECT * REPLACE (
  CASE WHEN doc_id % 23 <> 0 THEN doc_id // 20 END AS ord),
  CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 1 END AS batch_rank FROM articles),
ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {PLACE_SQL}) AS rn
  FROM rowsx),
merged AS (SELECT doc_id, title, date, url, source, batch_rank, ord FROM ranked WHERE rn = 1)"""


@query("dedupe_keep_newest", f"WITH {BATCHES_SQL} SELECT doc_id, url, batch_rank FROM merged")
def dedupe_keep_newest(spark, sf_dir):
    new, old = batches(spark, sf_dir)
    both = new.withColumn("batch_rank", F.lit(0)).unionByName(
        old.withColumn("batch_rank", F.lit(1)))
    return mg.dedupe_keep_newest(both).select("doc_id", "url", "batch_rank")


@query("merge_batch", f"WITH {BATCHES_SQL} SELECT doc_id, title, date, url, source, batch_rank "
       "FROM merged")
def merge_batch(spark, sf_dir):
    """The whole merged table, without a cap."""
    new, old = batches(spark, sf_dir)
    return mg.merge_batch(new, old, cap=None).select(
        "doc_id", "title", "date", "url", "source", "batch_rank")


@query("merge_cap", f"WITH {BATCHES_SQL} SELECT doc_id, title, date, url, source, batch_rank "
       f"FROM merged ORDER BY {PLACE_SQL} LIMIT 500")
def merge_cap(spark, sf_dir):
    """The merged table as it is kept: the first 500 rows."""
    new, old = batches(spark, sf_dir)
    return mg.merge_batch(new, old).select(
        "doc_id", "title", "date", "url", "source", "batch_rank")


@query("union_sources", f"""WITH {ARTICLES_SQL}
SELECT doc_id, title, date, url, source, NULL AS language, 0 AS source_rank FROM articles
WHERE lang = 'en'
UNION ALL SELECT doc_id, title, NULL, url, NULL, NULL, 1 FROM articles WHERE lang = 'fr'
UNION ALL SELECT doc_id, title, date, url, source, 'de', 2 FROM articles WHERE lang = 'de'
UNION ALL SELECT doc_id, title, date, url, source, 'es', 3 FROM articles WHERE lang = 'es'""")
def union_sources(spark, sf_dir):
    """Four collections with different columns."""
    df = articles(spark, sf_dir)
    full = ["doc_id", "title", "date", "url", "source"]
    return mg.union_sources(
        df.where("lang = 'en'").select(*full),
        df.where("lang = 'fr'").select("doc_id", "title", "url"),
        df.where("lang = 'de'").select(*full, F.lit("de").alias("language")),
        df.where("lang = 'es'").select(*full, F.lit("es").alias("language")))
