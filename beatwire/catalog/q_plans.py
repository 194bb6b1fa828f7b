"""Checks of tables, the run log, fallbacks, and the plans end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatwire.catalog.q_analysis import _QUADRATURE, _gap_filled_sql, orders_baseline
from beatwire.catalog.q_claims import VERDICT_SQL, _corpus
from beatwire.catalog.q_geo import GAZ_SQL, location_sql
from beatwire.catalog.q_ingest import (
    _DAY, BODY_SQL, HREF_SQL, INGESTED, MIN_LINK, ROOT_SQL, _strip, feed_times, joined_sql, plain_sql,
)
from beatwire.catalog.registry import query, table
from beatwire.catalog.views import (
    ARTICLES_SQL, LABELLED_SQL, LISTING_SQL, PHRASES, articles, claims, listing_pages,
)
from beatwire.dims import TAX11
from beatwire.functions.links import site_host
from beatwire.operators.classify import lexicon_scorer
from beatwire.operators.merge import with_fallback
from beatwire.plans.batch import clean_articles, label_articles, trend_and_correlation
from beatwire.plans.collect import REGIONAL, collect_articles
from beatwire.plans.refresh import start_refresh
from beatwire.plans.verify import verify_claims
from beatwire.schemas import ARTICLE_WITH_LANGUAGE, ensure_columns, require_columns
from beatwire.session import work_dir
from beatwire.sources import pages as pg
from beatwire.sources.tables import last_run, record_run
from beatwire.streaming.streams import current_version, stream_table


@query("required_columns", f"WITH {ARTICLES_SQL} SELECT doc_id, title, text IS NOT NULL AS has_text "
       "FROM articles")
def required_columns(spark, sf_dir):
    """Articles, after the check that the columns a scan needs are there."""
    return require_columns(articles(spark, sf_dir), ["title", "text"]).select(
        "doc_id", "title", F.col("text").isNotNull().alias("has_text"))


@query("ensured_columns", f"WITH {ARTICLES_SQL} SELECT doc_id, title, url, NULL AS source, "
       "'unknown' AS language FROM articles")
def ensured_columns(spark, sf_dir):
    """A table without source and language gets both, one empty, one with a default."""
    some = articles(spark, sf_dir).select("doc_id", "title", "text", "date", "url")
    return ensure_columns(some, ARTICLE_WITH_LANGUAGE, {"language": "unknown"}).select(
        "doc_id", "title", "url", "source", "language")


@query("run_log", "SELECT strftime(greatest(max(ts), min(ts)), '%Y-%m-%d %H:%M:%S') AS last_updated "
       "FROM events")
def run_log(spark, sf_dir):
    """A run is logged at the first and at the last event; the log tells the later one."""
    path = work_dir(spark, "run-log")
    bounds = table(spark, sf_dir, "events").agg(
        *[F.date_format(f("ts"), "yyyy-MM-dd HH:mm:ss") for f in (F.max, F.min)]).first()
    for run_ts in bounds:
        record_run(spark, path, run_ts)
    return last_run(spark, path)


@query("corpus_fallback", f"WITH {ARTICLES_SQL} SELECT doc_id, title FROM articles "
       "WHERE lang IN ('de', 'es')")
def corpus_fallback(spark, sf_dir):
    """A stored corpus without rows gives way to the other collections."""
    df = articles(spark, sf_dir).select("doc_id", "title", "lang")
    return with_fallback(df.where("lang = 'none'"), [df.where(f"lang = '{x}'") for x in (
        "none", "de", "es")]).select("doc_id", "title")


@query("html_anchors_regional", f"""WITH {LISTING_SQL},
bodies AS (SELECT page_id, url, regexp_extract_all({BODY_SQL}, '(?s)<a .*?</a>') AS l FROM listing),
each AS (SELECT page_id, url, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS ord FROM bodies),
cut AS (SELECT page_id, CAST(ord AS INT) AS ord, {plain_sql('e')} AS title,
  {ROOT_SQL} || {HREF_SQL.format('e')} AS link FROM each)
SELECT * FROM cut WHERE length(title) >= {MIN_LINK}""")
def html_anchors_regional(spark, sf_dir):
    """Links as regional sites are read, shorter titles allowed."""
    return pg.html_anchors(listing_pages(spark, sf_dir), **{**REGIONAL, "min_len": MIN_LINK}).drop("url")


DENY = ["the", "er"]


@query("html_headlines_deny", f"""WITH bodies AS (SELECT page_id, url,
  regexp_extract_all({BODY_SQL}, '(?s)<a .*?</a>') AS l FROM pages),
each AS (SELECT page_id, url, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS ord FROM bodies),
cut AS (SELECT page_id, CAST(ord AS INT) AS ord, {joined_sql('e')} AS headline FROM each)
SELECT * FROM cut WHERE length(headline) >= {MIN_LINK}
  AND NOT contains(headline, '{DENY[0]}') AND NOT contains(headline, '{DENY[1]}')""")
def html_headlines_deny(spark, sf_dir):
    """Long links of pages without linked headings, but for those with a word of a list."""
    return pg.html_headlines(table(spark, sf_dir, "pages"), min_link=MIN_LINK, deny=DENY).select(
        "page_id", "ord", "headline")


_PLACED = (f"{LABELLED_SQL}, {GAZ_SQL}, {location_sql('title', 'by_title')}, "
           f"{location_sql('text', 'by_text')}, placed AS (SELECT l.*, "
           "coalesce(t.location, x.location) AS location FROM labelled l "
           "LEFT JOIN by_title t USING (doc_id) LEFT JOIN by_text x USING (doc_id))")
_SCORER = lexicon_scorer(PHRASES, hits_for_one=2)


@query("plan_batch", f"WITH {_PLACED} SELECT doc_id, {', '.join(TAX11)}, location FROM placed "
       "WHERE length(clean_text) > 0")
def plan_batch(spark, sf_dir):
    """Articles cleaned, labelled and placed."""
    return label_articles(clean_articles(articles(spark, sf_dir)), TAX11, _SCORER).select(
        "doc_id", *TAX11, "location")


@query("plan_refresh", f"""WITH {_PLACED}, ranked AS (SELECT *, row_number() OVER (
  PARTITION BY url ORDER BY CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 1 END, doc_id) AS rn FROM placed)
SELECT doc_id, url, murder, theft, location FROM ranked WHERE rn = 1""")
def plan_refresh(spark, sf_dir):
    """Two landings, labelled and merged as they come; the table as it then stands."""
    root = work_dir(spark, "refresh")
    df = articles(spark, sf_dir).select("doc_id", "ord", "title", "text", "date", "url", "source")
    late = F.col("doc_id") % 2 == 1
    for batch in (df.where(~late), df.where(late)):
        batch.write.mode("append").parquet(f"{root}/landing")
        start_refresh(stream_table(spark, f"{root}/landing", batch.schema), f"{root}/table",
                      f"{root}/checkpoint", TAX11, _SCORER, cap=None, once=True).awaitTermination()
    return current_version(spark, f"{root}/table").select(
        "doc_id", "url", "murder", "theft", "location")


MIN_CLAIM = 300


@query("plan_verify", f"""WITH {VERDICT_SQL}, told AS (SELECT claim_id, status FROM st)
SELECT c.claim_id, length(c.text) >= {MIN_CLAIM} AS accepted,
  CASE WHEN length(c.text) >= {MIN_CLAIM} THEN t.status END AS status
FROM claims c JOIN told t USING (claim_id)""")
def plan_verify(spark, sf_dir):
    """Verdicts of the claims that are long enough, and the ones turned away."""
    verdicts, rejected = verify_claims(claims(spark, sf_dir), _corpus(spark, sf_dir), MIN_CLAIM)
    return (verdicts.select("claim_id", F.lit(True).alias("accepted"), "status")
            .unionByName(rejected.select("claim_id", F.lit(False).alias("accepted"),
                                         F.lit(None).cast("string").alias("status"))))


CATS3 = ["theft", "accident", "non_crime"]
_SHIFT = 30  # years between the orders and the articles


@query("plan_correlation", f"""WITH {LABELLED_SQL},
dated AS (SELECT *, CAST(date AS DATE) AS d FROM labelled WHERE length(clean_text) > 0),
{_gap_filled_sql("dated", "d", CATS3, "month", "m")},
daily AS (SELECT CAST(CAST(o_orderdate AS DATE) + INTERVAL {_SHIFT} YEAR AS DATE) AS d,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS theft, count(*) FILTER (o_orderpriority = '2-HIGH') AS accident,
  count(*) FILTER (o_orderpriority = '5-LOW') AS non_crime FROM orders GROUP BY 1),
{_gap_filled_sql("daily", "d", CATS3, "month", "base")},
pairs AS ({" UNION ALL ".join(f"SELECT '{c}' AS category, CAST(m.{c} AS DOUBLE) AS predicted, CAST(b.{c} AS DOUBLE) AS official FROM m JOIN base b USING (month_end)" for c in CATS3)}),
rs AS (SELECT category, count(*) AS n, CASE WHEN stddev_pop(predicted) > 0 AND stddev_pop(official) > 0
  THEN covar_pop(predicted, official) / (stddev_pop(predicted) * stddev_pop(official)) END AS r
  FROM pairs GROUP BY 1), {_QUADRATURE}
SELECT category, n, round(r, 6) AS r, round(1 - part / whole, 6) AS p_value,
  coalesce(1 - part / whole < 0.05, false) AS significant FROM area""")
def plan_correlation(spark, sf_dir):
    """The batch plan to its end: articles labelled, summed by month, held against statistics."""
    labelled = label_articles(clean_articles(articles(spark, sf_dir)), TAX11, _SCORER)
    official = orders_baseline(spark, sf_dir).select(
        F.add_months("date", 12 * _SHIFT).alias("date"),
        *[F.col(a).alias(b) for a, b in zip(("c1", "c2", "c3"), CATS3)])
    return trend_and_correlation(labelled, CATS3, official)[1].select(
        "category", "n", F.round("r", 6).alias("r"), F.round("p_value", 6).alias("p_value"), "significant")


# Outlets made from the tables: every source is a feed, every host a site of one of three kinds.
FEED_CAP, DAY = 15, INGESTED[:10]
_STORY = ", the whole story in one place"
_LONG_SQL = rf"""regexp_replace(html, '<li>(<a [^>]*>)([^<]*)</a></li>', '<li>\1\2{_STORY}</a></li>', 'g')"""


def _outlets(spark, sf_dir):
    feeds = table(spark, sf_dir, "documents").select("source").distinct().select(
        "source", F.lit(None).cast("string").alias("home"), F.lit("rss").alias("kind"),
        F.lit(None).cast("string").alias("language"), F.substring("source", 4, 9).cast("int").alias("rank"))
    host = site_host(F.col("url"))
    kind = F.length("source") % 3
    sites = table(spark, sf_dir, "pages").select(host.alias("source")).distinct().select(
        "source", F.concat(F.lit("http://"), "source").alias("home"),
        F.when(kind == 0, "headlines").otherwise("anchors").alias("kind"),
        F.when(kind == 1, "hi").when(kind == 2, "kn").alias("language"), F.lit(1_000).alias("rank"))
    return feeds.unionByName(sites)


@query("plan_collect", f"""WITH {ARTICLES_SQL},
items AS (SELECT *, coalesce(url, '') AS link, CAST(substr(source, 4) AS INT) AS feed_rank,
  row_number() OVER (PARTITION BY source ORDER BY ord) AS rn FROM articles),
firsts AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY feed_rank, ord) AS un FROM items WHERE rn <= {FEED_CAP}),
told AS (SELECT 0 AS source_rank, {_strip('title')} AS title,
  md5({_strip(f"{_strip('title')} || '. ' || {_strip('text')}")}) AS text_md5, {_DAY} AS date, link AS url, source,
  NULL AS language FROM firsts WHERE un = 1),
bodies AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]+)', 1) AS host, {BODY_SQL} AS body
  FROM (SELECT page_id, url, {_LONG_SQL} AS html FROM pages)),
links AS (SELECT page_id, url, host, length(host) % 3 AS kind, unnest(l) AS e, generate_subscripts(l, 1) AS ord
  FROM (SELECT *, regexp_extract_all(body, '(?s)<a .*?</a>') AS l FROM bodies)),
cut AS (SELECT page_id, host, kind, ord, CASE WHEN kind = 0 THEN {joined_sql('e')} ELSE {plain_sql('e')} END AS title,
  {HREF_SQL.format('e')} AS href, {ROOT_SQL} || {HREF_SQL.format('e')} AS link FROM links),
good AS (SELECT *, CASE WHEN kind = 0 THEN title ELSE link END AS same FROM cut
  WHERE length(title) >= CASE kind WHEN 0 THEN 25 WHEN 1 THEN 26 ELSE 21 END
    AND (kind > 0 OR NOT contains(lower(href), 'javascript'))),
single AS (SELECT *, row_number() OVER (PARTITION BY host, same ORDER BY page_id, ord) AS sn FROM good),
capped AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id, ord) AS rn FROM single WHERE sn = 1)
SELECT * FROM told UNION ALL SELECT kind + 1, title, md5(title), '{DAY}', link, host,
  CASE kind WHEN 1 THEN 'hi' WHEN 2 THEN 'kn' END FROM capped WHERE rn <= {FEED_CAP}""")
def plan_collect(spark, sf_dir):
    """Feeds and three kinds of sites to one article table."""
    items = feed_times(articles(spark, sf_dir)).select(
        "ord", "source", "title", F.col("text").alias("description"), F.col("url").alias("link"),
        "pubDate", "updated")
    longer = F.regexp_replace("html", "<li>(<a [^>]*>)([^<]*)</a></li>", f"<li>$1$2{_STORY}</a></li>")
    pages = table(spark, sf_dir, "pages").withColumn("html", longer)
    rows = collect_articles(items, pages, _outlets(spark, sf_dir), F.lit(DAY), FEED_CAP)
    return rows.select("source_rank", "title", F.md5("text").alias("text_md5"), "date", "url", "source",
                       "language")
