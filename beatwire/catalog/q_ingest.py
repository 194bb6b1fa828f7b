"""Feeds and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatwire.catalog.registry import query
from beatwire.catalog.views import ARTICLES_SQL, LISTING_SQL, articles, listing_pages, pages
from beatwire.functions.dates import feed_date
from beatwire.functions.links import ANY_TAG, HIDDEN_PATTERN, attribute, resolve_link, visible
from beatwire.functions.text import WS
from beatwire.sources import pages as pg
from beatwire.session import work_dir
from beatwire.sources.feeds import entries_to_articles, entry_text, parse_items, read_feeds

# --- feeds -----------------------------------------------------------------------

INGESTED = "2024-12-31 12:00:00"
_PUB = "doc_id % 9 <> 0"
_UPD = "doc_id % 2 = 0"
_CUT = "doc_id % 31 = 0"


def feed_times(df):
    """Publication times in India, update times in UTC, some of both missing."""
    hour = F.lpad((F.col("doc_id") % 24).cast("string"), 2, "0")
    day = F.to_date("date")
    pub = F.concat(F.date_format(day, "EEE, dd MMM yyyy "), hour, F.lit(":15:00 +0530"))
    upd = F.concat(F.col("date"), F.lit("T"), hour, F.lit(":15:00+00:00"))
    return df.withColumns({"pubDate": F.when(F.expr(_PUB), pub),
                           "updated": F.when(F.expr(_UPD), upd)})


_DAY = (f"CASE WHEN {_PUB} THEN strftime(CAST(date AS TIMESTAMP) + "
        "to_minutes(CAST(60 * (doc_id % 24) + 15 - 330 AS BIGINT)), '%Y-%m-%d') "
        f"WHEN {_UPD} THEN date ELSE '{INGESTED[:10]}' END")


@query("feed_date", f"WITH {ARTICLES_SQL} SELECT doc_id, {_DAY} AS day FROM articles")
def feed_dates(spark, sf_dir):
    df = feed_times(articles(spark, sf_dir))
    return df.select("doc_id", feed_date(
        F.col("pubDate"), F.col("updated"), F.lit(INGESTED).cast("timestamp")).alias("day"))


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _element(name, c):
    return F.when(c.isNotNull(), F.concat(F.lit(f"<{name}>"), _escaped(c), F.lit(f"</{name}>")))


def feed_items(spark, sf_dir):
    """Every article as the ``item`` element of a feed; some without a link, some cut off."""
    df = feed_times(articles(spark, sf_dir))
    parts = [_element("title", F.col("title")), _element("description", F.col("text")),
             _element("link", F.col("url")), _element("pubDate", F.col("pubDate")),
             _element("updated", F.col("updated"))]
    end = F.when(F.expr(_CUT), F.lit("")).otherwise(F.lit("</item>"))
    return df.select("doc_id", "source", F.concat(
        F.lit("<item>"), F.concat_ws("", *parts), end).alias("xml"))


ENTRIES_A_FEED = 1_000  # ids; some fifty entries of one source


def atom_feeds(spark, sf_dir):
    """(source, part, value): Atom feeds of some fifty articles, linked by attribute."""
    df = articles(spark, sf_dir)
    link = F.when(F.col("url").isNotNull(), F.concat(
        F.lit('<link rel="self" href="http://example.com/feed"/><link href="'), F.col("url"),
        F.lit('"/>')))
    parts = [_element("title", F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.col("title"))),
             _element("summary", F.col("text")), link,
             _element("published", F.concat(F.col("date"), F.lit("T10:00:00Z")))]
    entry = F.concat(F.lit("<entry>"), F.concat_ws("", *parts), F.lit("</entry>"))
    part = F.floor(F.col("doc_id") / ENTRIES_A_FEED)
    return df.groupBy("source", part.alias("part")).agg(F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'),
        F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("value"))


def _strip(col: str) -> str:
    return f"regexp_replace({col}, '^[{WS}]+|[{WS}]+$', '', 'g')"


_TITLED = "doc_id || ' ' || title"


@query("rss_entries", f"""WITH {ARTICLES_SQL}
SELECT doc_id, {_strip('title')} AS title,
  md5({_strip(f"{_strip('title')} || '. ' || {_strip('text')}")}) AS text_md5,
  {_DAY} AS date, coalesce(url, '') AS url, source FROM articles WHERE NOT ({_CUT})""")
def rss_entries(spark, sf_dir):
    """Items parsed from XML and turned into articles."""
    items, _ = parse_items(feed_items(spark, sf_dir), "xml")
    rows = entries_to_articles(items, F.col("source"), F.lit(INGESTED).cast("timestamp"))
    return rows.select("doc_id", "title", F.md5("text").alias("text_md5"), "date", "url", "source")


@query("rss_broken", f"SELECT doc_id, source FROM documents WHERE {_CUT}")
def rss_broken(spark, sf_dir):
    """Items that are no XML, set aside."""
    return parse_items(feed_items(spark, sf_dir), "xml")[1].select("doc_id", "source")


@query("atom_entries", f"""WITH {ARTICLES_SQL}
SELECT {_strip("doc_id || ' ' || title")} AS title,
  md5({_strip(f"{_strip(_TITLED)} || '. ' || {_strip('text')}")}) AS text_md5, date,
  coalesce(url, 'http://example.com/feed') AS url, source FROM articles""")
def atom_entries(spark, sf_dir):
    """Feed files of every source, landed as XML and read back."""
    path = work_dir(spark, "atom")
    atom_feeds(spark, sf_dir).write.partitionBy("source", "part").text(path)
    items, _ = read_feeds(spark, path, "atom")
    rows = entries_to_articles(items, F.col("source"), F.lit(INGESTED).cast("timestamp"))
    return rows.select("title", F.md5("text").alias("text_md5"), "date",
                       F.when(F.col("url") == "", "http://example.com/feed")
                       .otherwise(F.col("url")).alias("url"), "source")


_BARE_TEXT = _strip("title || '. ' || text")


@query("rss_text", f"WITH {ARTICLES_SQL} SELECT doc_id, md5({_BARE_TEXT}) AS text_md5 FROM articles")
def rss_text(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "doc_id", F.md5(entry_text(F.col("title"), F.col("text"))).alias("text_md5"))


# --- pages -----------------------------------------------------------------------

BODY_SQL = f"regexp_replace(html, '{HIDDEN_PATTERN}', '', 'g')"


# The references that occur in the pages; ``amp`` comes last.
_REFERENCES = {"copy": "©", "middot": "·", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0",
               "amp": "&"}


def _decoded(col: str) -> str:
    for name, char in _REFERENCES.items():
        col = f"replace({col}, '&{name};', '{char}')"
    return col


_TAG_SQL = ANY_TAG.replace("'", "''")


def plain_sql(col: str) -> str:
    return _strip(_decoded(f"regexp_replace({col}, '{_TAG_SQL}', '', 'g')"))


def joined_sql(col: str) -> str:
    return _strip(_decoded(f"regexp_replace({col}, '[{WS}]*{_TAG_SQL}[{WS}]*', '', 'g')"))


ROOT_SQL = "regexp_extract(url, '^[A-Za-z]+://[^/?#]+')"
HREF_SQL = _decoded("""regexp_extract({0}, '(?i)href="([^"]*)"', 1)""")


_P_SQL, _H1_SQL = (x.replace("'", "''") for x in (pg.PARAGRAPH_START, pg.H1))


@query("html_article", f"""WITH bodies AS (SELECT page_id, url, {BODY_SQL} AS body FROM pages),
parts AS (SELECT page_id, url, body, list_filter(list_transform(
    string_split_regex(body, '{_P_SQL}')[2:],
    lambda p: {plain_sql(f"string_split_regex(p, '{pg.PARAGRAPH_END}')[1]")}),
  lambda t: length(t) > 30) AS ps FROM bodies)
SELECT page_id, url, CASE WHEN regexp_matches(body, '(?i)<h1')
    THEN {plain_sql(f"regexp_extract(body, '{_H1_SQL}', 1)")} ELSE 'Unknown Title' END AS title,
  md5(array_to_string(ps, ' ')) AS text_md5 FROM parts WHERE len(ps) > 0""")
def html_article(spark, sf_dir):
    return pg.html_article(pages(spark, sf_dir)).select(
        "page_id", "url", "title", F.md5("text").alias("text_md5"))


MIN_HEAD, MIN_LINK = 8, 6


@query("html_headlines", f"""WITH {LISTING_SQL},
bodies AS (SELECT page_id, url, {BODY_SQL} AS body FROM listing),
raw AS (SELECT page_id, url, 0 AS kind, regexp_extract_all(body, CASE page_id % 3
    WHEN 0 THEN '(?s)<h3>.*?</h3>' ELSE '(?s)<a [^>]*><h2>.*?</h2></a>' END) AS l FROM bodies
  UNION ALL SELECT page_id, url, 1, regexp_extract_all(body, '(?s)<a .*?</a>') FROM bodies),
each AS (SELECT page_id, url, kind, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS ord FROM raw),
cut AS (SELECT page_id, url, kind, CAST(ord AS INT) AS ord, {joined_sql('e')} AS headline,
  {HREF_SQL.format('e')} AS href FROM each),
good AS (SELECT * FROM cut WHERE length(headline) >= CASE kind WHEN 0 THEN {MIN_HEAD}
  ELSE {MIN_LINK} END AND NOT contains(lower(href), 'javascript')),
heads AS (SELECT page_id, count(*) AS n FROM good WHERE kind = 0 GROUP BY 1)
SELECT g.page_id, g.kind, g.ord, g.headline, {ROOT_SQL.replace('url', 'g.url')} || href AS link
FROM good g LEFT JOIN heads h USING (page_id) WHERE kind = 0 OR coalesce(h.n, 0) < 2""")
def html_headlines(spark, sf_dir):
    """Lower thresholds than for news sites: the menus of these pages are terse."""
    return pg.html_headlines(
        listing_pages(spark, sf_dir), min_head=MIN_HEAD, min_link=MIN_LINK).select(
            "page_id", "kind", "ord", "headline", "link")


@query("html_anchors", f"""WITH {LISTING_SQL},
bodies AS (SELECT page_id, url, regexp_extract_all({BODY_SQL}, '(?s)<a .*?</a>') AS l FROM listing),
each AS (SELECT page_id, url, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS ord FROM bodies),
cut AS (SELECT page_id, CAST(ord AS INT) AS ord, {plain_sql('e')} AS title,
  {ROOT_SQL} || {HREF_SQL.format('e')} AS link FROM each)
SELECT * FROM cut WHERE length(title) >= {MIN_LINK}""")
def html_anchors(spark, sf_dir):
    return pg.html_anchors(listing_pages(spark, sf_dir), min_len=MIN_LINK).drop("url")


@query("html_anchors_nested", rf"""WITH nested AS (SELECT page_id, url, regexp_replace(html,
  '<li>(<a [^>]*>)([^<]*)</a></li>', '\1<span><i>\2</i> <SPAN class="a">in</span> end</span> <span>tail</span></a>', 'g')
  AS html FROM pages),
bodies AS (SELECT page_id, url, regexp_extract_all({BODY_SQL}, '(?s)<a .*?</a>') AS l FROM nested),
each AS (SELECT page_id, url, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS ord FROM bodies),
cut AS (SELECT page_id, CAST(ord AS INT) AS ord, {plain_sql("replace(e, '<span>tail</span>', '')")} AS title,
  {ROOT_SQL} || {HREF_SQL.format('e')} AS link FROM each)
SELECT * FROM cut WHERE length(title) >= {MIN_LINK}""")
def html_anchors_nested(spark, sf_dir):
    """Titles in elements that hold others of their name, with a sibling behind them."""
    nested = F.regexp_replace("html", r"<li>(<a [^>]*>)([^<]*)</a></li>",
                              '$1<span><i>$2</i> <SPAN class="a">in</span> end</span> <span>tail</span></a>')
    return pg.html_anchors(pages(spark, sf_dir).withColumn("html", nested), min_len=MIN_LINK).drop("url")


_SHAPES = ["absolute", "host", "rooted", "relative", "query", "fragment", "up", "here"]


def _shape_sql(href: str) -> str:
    word = f"replace({href}, '/', '')"
    return (f"CASE ord % {len(_SHAPES)} WHEN 0 THEN 'https://other.example.org' || {href} "
            f"WHEN 1 THEN '//other.example.org' || {href} WHEN 2 THEN {href} WHEN 3 THEN {word} "
            f"WHEN 4 THEN '?q=' || {word} WHEN 5 THEN '#' || {word} "
            f"WHEN 6 THEN '../' || {word} ELSE './x/../' || {word} END")


def _page_links(spark, sf_dir):
    """(page_id, url, ord, href): the links of every page, written in eight ways."""
    body = visible(F.col("html"))
    tags = F.regexp_extract_all(body, F.lit(r"(?is)<a\b[^>]*>"), F.lit(0))
    links = pages(spark, sf_dir).select("page_id", "url", F.posexplode(tags).alias("ord", "tag"))
    href, word = F.col("h"), F.replace("h", F.lit("/"), F.lit(""))
    shapes = [F.concat(F.lit("https://other.example.org"), href),
              F.concat(F.lit("//other.example.org"), href), href, word,
              F.concat(F.lit("?q="), word), F.concat(F.lit("#"), word),
              F.concat(F.lit("../"), word), F.concat(F.lit("./x/../"), word)]
    return links.withColumn("h", attribute(F.col("tag"), "href")).select(
        "page_id", "url", "ord", F.get(F.array(*shapes), F.col("ord") % len(_SHAPES)).alias("href"))


_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
_FOLDER = f"regexp_extract({_PATH}, '^(.*/)', 1)"
_UP = f"regexp_extract({_PATH}, '^(.*/)[^/]*/[^/]*$', 1)"
_W = "replace(h, '/', '')"


@query("resolve_links", f"""WITH bodies AS (SELECT page_id, url, regexp_extract_all({BODY_SQL},
    '(?is)<a\\b[^>]*>') AS l FROM pages),
each AS (SELECT page_id, url, unnest(l) AS tag, generate_subscripts(l, 1) - 1 AS ord FROM bodies),
cut AS (SELECT page_id, url, CAST(ord AS INT) AS ord, {HREF_SQL.format('tag')} AS h FROM each),
hrefs AS (SELECT *, {_shape_sql('h')} AS href FROM cut)
SELECT page_id, ord, href, CASE WHEN starts_with(href, 'http') THEN href ELSE {ROOT_SQL} ||
  CASE WHEN starts_with(href, '/') THEN '' ELSE '/' END || href END AS prefix_link,
  CASE ord % {len(_SHAPES)} WHEN 0 THEN href
    WHEN 1 THEN regexp_extract(url, '^[A-Za-z]+:') || href WHEN 2 THEN {ROOT_SQL} || h
    WHEN 3 THEN {ROOT_SQL} || {_FOLDER} || {_W} WHEN 4 THEN {ROOT_SQL} || {_PATH} || href
    WHEN 5 THEN regexp_extract(url, '^[^#]*') || href
    WHEN 6 THEN {ROOT_SQL} || {_UP} || {_W} ELSE {ROOT_SQL} || {_FOLDER} || {_W} END AS rfc_link
FROM hrefs""")
def resolve_links(spark, sf_dir):
    """Both rules on the links of every page."""
    return _page_links(spark, sf_dir).select(
        "page_id", "ord", "href", resolve_link(F.col("url"), F.col("href")).alias("prefix_link"),
        resolve_link(F.col("url"), F.col("href"), "rfc").alias("rfc_link"))


@query("link_census", f"""WITH {LISTING_SQL},
bodies AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS site, {BODY_SQL} AS body FROM listing),
raw AS (SELECT page_id, site, 'heading' AS kind,
    regexp_extract_all(body, '(?is)<h[1-4]\\b[^>]*>.*?</h[1-4]>') AS l FROM bodies
  UNION ALL SELECT page_id, site, 'link', regexp_extract_all(body, '(?s)<a .*?</a>') FROM bodies),
each AS (SELECT page_id, site, kind, unnest(l) AS e, generate_subscripts(l, 1) AS ord FROM raw),
cut AS (SELECT *, CASE kind WHEN 'heading' THEN {joined_sql("regexp_extract(e, '(?s)<a .*?</a>')")}
  ELSE {joined_sql('e')} END AS text FROM each),
good AS (SELECT * FROM cut WHERE length(text) >= CASE kind WHEN 'heading' THEN 1 ELSE {MIN_LINK} END),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site, kind ORDER BY page_id, ord) AS rn FROM good),
per AS (SELECT site, count(*) FILTER (kind = 'heading') AS n_headings,
  count(*) FILTER (kind = 'link') AS n_links,
  string_agg(text, ' | ' ORDER BY rn) FILTER (kind = 'heading' AND rn <= 5) AS heading_samples,
  string_agg(text, ' | ' ORDER BY rn) FILTER (kind = 'link' AND rn <= 5) AS link_samples
  FROM ranked GROUP BY 1)
SELECT site, coalesce(n_headings, 0) AS n_headings, coalesce(n_links, 0) AS n_links,
  coalesce(heading_samples, '') AS heading_samples, coalesce(link_samples, '') AS link_samples
FROM (SELECT DISTINCT site FROM bodies) LEFT JOIN per USING (site)""")
def link_census(spark, sf_dir):
    return pg.link_census(listing_pages(spark, sf_dir), min_link=MIN_LINK)
