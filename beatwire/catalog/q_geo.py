"""Places of articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatwire.catalog.registry import query, table
from beatwire.catalog.views import ARTICLES_SQL, articles
from beatwire.dims import MAP_CENTER, gazetteer, gazetteer_table
from beatwire.operators.geo import extract_location, geocode_articles, geocode_lookup
from beatwire.operators.names import find_names
from beatwire.operators.select import map_points

_W = r"[\p{L}\p{N}_]"
_NOT_W = r"[^\p{L}\p{N}_]"


def _pattern(name: str) -> str:
    """RE2 has no look-around. A name ending in a combining mark, which is no
    word character, needs a word character behind it to end at a boundary."""
    end = f"($|{_NOT_W})" if name[-1].isalnum() else _W
    return f"(^|{_NOT_W}){name}{end}"


GAZ_SQL = "gaz(name, lat, lon, rank, pattern) AS (VALUES " + ", ".join(
    f"('{p.name}', {p.lat!r}::DOUBLE, {p.lon!r}::DOUBLE, {p.rank}, '{_pattern(p.name)}')"
    for p in gazetteer()) + ")"


def location_sql(col: str, name: str) -> str:
    """Names contained in the text first, then the boundaries of those few pairs."""
    return f"""{name}_near AS MATERIALIZED (
  SELECT a.doc_id, a.t, g.name, g.rank, g.pattern
  FROM (SELECT doc_id, lower({col}) AS t FROM articles) a JOIN gaz g ON contains(a.t, g.name)),
{name} AS (SELECT doc_id, arg_min(name, 1000 * (1000 - length(name)) + rank) AS location
  FROM {name}_near WHERE regexp_matches(t, pattern) GROUP BY 1)"""


@query("extract_location", f"WITH {ARTICLES_SQL}, {GAZ_SQL}, {location_sql('text', 'loc')} "
       "SELECT a.doc_id, l.location FROM articles a LEFT JOIN loc l USING (doc_id)")
def locations(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "doc_id", extract_location(F.col("text"), gazetteer()).alias("location"))


@query("geocode_lookup", f"WITH {ARTICLES_SQL}, {GAZ_SQL}, {location_sql('text', 'loc')} "
       "SELECT a.doc_id, l.location, g.lat, g.lon FROM articles a LEFT JOIN loc l USING (doc_id) "
       "LEFT JOIN gaz g ON lower(l.location) = g.name")
def lookup(spark, sf_dir):
    """Coordinates of the place that the text names."""
    return geocode_lookup(locations(spark, sf_dir), gazetteer_table(spark))


GEOCODED_SQL = f"""{ARTICLES_SQL}, {GAZ_SQL}, {location_sql('title', 'by_title')},
{location_sql('text', 'by_text')},
placed AS (SELECT a.*, coalesce(t.location, x.location) AS location FROM articles a
  LEFT JOIN by_title t USING (doc_id) LEFT JOIN by_text x USING (doc_id)),
geocoded AS (SELECT p.*, g.lat, g.lon FROM placed p LEFT JOIN gaz g ON p.location = g.name)"""


def geocoded(spark, sf_dir):
    return geocode_articles(articles(spark, sf_dir), gazetteer())


@query("geocode_articles", f"WITH {GEOCODED_SQL} SELECT doc_id, location, lat, lon FROM geocoded")
def geocode(spark, sf_dir):
    return geocoded(spark, sf_dir).select("doc_id", "location", "lat", "lon")


@query("map_points", f"WITH {GEOCODED_SQL} SELECT title, source, location, lat, lon "
       "FROM geocoded WHERE lat IS NOT NULL AND lon IS NOT NULL")
def points(spark, sf_dir):
    return map_points(geocoded(spark, sf_dir))


@query("map_points_or_center", f"""WITH {GEOCODED_SQL},
few AS (SELECT title, source, location, lat, lon FROM geocoded
  WHERE lat IS NOT NULL AND location = 'atlantis'),
located AS (SELECT title, source, location, lat, lon FROM geocoded WHERE lat IS NOT NULL),
center AS (SELECT NULL AS title, NULL AS source, NULL AS location,
  {MAP_CENTER[0]}::DOUBLE AS lat, {MAP_CENTER[1]}::DOUBLE AS lon)
SELECT 'none' AS kind, * FROM few UNION ALL
SELECT 'none', * FROM center WHERE NOT EXISTS (SELECT 1 FROM few) UNION ALL
SELECT 'all', * FROM located UNION ALL
SELECT 'all', * FROM center WHERE NOT EXISTS (SELECT 1 FROM located)""")
def points_or_center(spark, sf_dir):
    """Articles of an unknown place give the centre, all articles their points."""
    df = geocoded(spark, sf_dir)
    none = map_points(df.where("location = 'atlantis'"), center=True)
    every = map_points(df, center=True)
    return none.withColumn("kind", F.lit("none")).unionByName(
        every.withColumn("kind", F.lit("all")))


@query("geocode_names", f"""WITH {ARTICLES_SQL}, {GAZ_SQL}, {location_sql('title', 'by_title')},
{location_sql('text', 'by_text')} SELECT a.doc_id, coalesce(t.location, x.location) AS name
FROM articles a LEFT JOIN by_title t USING (doc_id) LEFT JOIN by_text x USING (doc_id)""")
def geocode_names(spark, sf_dir):
    """The places of ``geocode_articles`` by the search for names that are rows."""
    rows = articles(spark, sf_dir).select("doc_id", "title", "text")
    return find_names(rows, "doc_id", ["title", "text"], gazetteer_table(spark)).select("doc_id", "name")


# Firms of two tables, and an article that names up to two of them.
_FIRM = r"(?:customer|supplier)#[0-9]+"
FIRMS_SQL = rf"""{ARTICLES_SQL}, firms AS (
  SELECT c_name AS name, 2 * c_custkey AS rank, c_nationkey AS nation FROM customer
  UNION ALL SELECT s_name, 2 * s_suppkey + 1, s_nationkey FROM supplier),
mentions AS (SELECT doc_id, title, text || ' Seen by CUSTOMER#' || lpad(CAST(doc_id * 7 AS VARCHAR), 9, '0')
  || ' and Supplier#' || lpad(CAST(doc_id * 3 AS VARCHAR), 9, '0') || CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END
  AS text FROM articles),
named AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_FIRM}[\p{{L}}\p{{N}}_]*')) AS form FROM mentions),
placed AS (SELECT doc_id, arg_min(name, rank) AS name, arg_min(nation, rank) AS nation
  FROM named JOIN firms ON lower(name) = form GROUP BY doc_id)"""


@query("find_firms", f"WITH {FIRMS_SQL} SELECT m.doc_id, p.name, coalesce(p.nation, -1) AS nation FROM mentions m "
       "LEFT JOIN placed p USING (doc_id)")
def find_firms(spark, sf_dir):
    """Names of the customer and supplier tables in articles that mention firms."""
    def firms(name: str, prefix: str, odd: int):
        key, nation = (("c_custkey", "c_nationkey") if prefix == "c" else ("s_suppkey", "s_nationkey"))
        return table(spark, sf_dir, name).select(
            F.col(f"{prefix}_name").alias("name"), (F.col(key) * 2 + odd).alias("rank"),
            F.col(nation).alias("nation"))

    def number(times: int):
        return F.lpad((F.col("doc_id") * times).cast("string"), 9, "0")

    mentions = articles(spark, sf_dir).select("doc_id", "title", F.concat(
        "text", F.lit(" Seen by CUSTOMER#"), number(7), F.lit(" and Supplier#"), number(3),
        F.when(F.col("doc_id") % 4 == 0, "x").otherwise("")).alias("text"))
    names = firms("customer", "c", 0).unionByName(firms("supplier", "s", 1))
    return find_names(mentions, "doc_id", ["title", "text"], names).select(
        "doc_id", "name", F.coalesce("nation", F.lit(-1)).alias("nation"))
