"""Views that give the given tables the shape of the reference data.

Every view exists twice, as a DataFrame and as a SQL text for the check. The
documents hold no places, incident words, links or tags, so each article gets
a phrase in its headline and one at its end, chosen by its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatwire.catalog.registry import table
from beatwire.dims import OUTLETS, TAX11, phrase_vocab
from beatwire.functions.text import (
    KEYWORD_STRIP, TAG_PATTERN, URL_PATTERN, WS, clean_text, non_word_filter,
)
from beatwire.operators.classify import classify, lexicon_scorer
from beatwire.operators.select import settled

# Words of the names of the eleven categories.
PHRASES = phrase_vocab()

# One phrase per headline, by doc_id % 12.
HEADLINES = [
    "Thief snatched jewelry and money in Mumbai",
    "Gang smuggling heroin seized in raid at Navi Mumbai",
    "Truck collision on highway near Bengaluru leaves two dead",
    "Bank scam, phishing fraud online hits Pune",
    "Cricket festival and election weather update",
    "",
    "Police arrested two after attack, weapon recovered in Delhi, one injured",
    "ಹಾಸನ ನಗರ ಅಪಘಾತ ವರದಿ ಇಂದು",
    "ಬೆಂಗಳೂರು ಸುದ್ದಿ ಮತ್ತು ವರದಿ ಇಂದು",
    "Two held in murder and homicide case at Jaipur <b>live</b> https://example.com/x1?a=b café",
    "Robbery and car crash near Pimpri-Chinchwad as car crashed, stolen money found",
    "दिल्ली में चुनाव और मौसम की खबर",
]

# One phrase at the end of the text, by (doc_id // 12) % 5.
CLOSINGS = [
    " Reported from Chennai.",
    " See www.example.org/live for <i>updates</i>.",
    "",
    " Officials in Hubli-Dharwad and Surat confirmed a kidnapping and abduction.",
    " one\u00a0two\u2003three",
]

# Days of June and July 2024 are moved on by 61, which leaves two empty months.
GAP_FROM, GAP_TO, GAP_SHIFT = 152, 212, 61


def _quoted(items: list[str]) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def _choice(items: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(i) for i in items]), (index + 1).cast("int"))


def headline_phrase() -> Column:
    return _choice(HEADLINES, F.col("doc_id") % len(HEADLINES))


def closing_phrase() -> Column:
    return _choice(CLOSINGS, F.floor(F.col("doc_id") / len(HEADLINES)) % len(CLOSINGS))


def as_articles(docs: DataFrame) -> DataFrame:
    """documents, at rest or streaming, as articles.

    Columns: doc_id, ord, title, text, date, date_raw, url, source, outlet, lang.
    """
    i = F.col("doc_id")
    first_line = F.substring_index("text", "\n", 1)
    title = F.trim(F.concat_ws(" ", headline_phrase(), first_line))
    raw = (i * 37) % 730
    off = F.when(raw.between(GAP_FROM, GAP_TO), raw + GAP_SHIFT).otherwise(raw)
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), off.cast("int")),
                        "yyyy-MM-dd")
    url_id = F.when(i % 5 == 4, i - 1).otherwise(i)
    outlets = [o[0] for o in OUTLETS] + ["Local Desk"]
    return docs.select(
        "doc_id", i.alias("ord"), title.alias("title"),
        F.concat(title, F.lit(". "), F.col("text"), closing_phrase()).alias("text"),
        day.alias("date"),
        F.when(i % 50 == 13, "n/a").otherwise(day).alias("date_raw"),
        F.when(i % 10 != 7, F.concat(F.lit("http://example.com/news/"),
                                     url_id.cast("string"))).alias("url"),
        "source",
        _choice(outlets, F.substring("source", 4, 9).cast("int") % len(outlets)).alias("outlet"),
        "lang")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_articles(table(spark, sf_dir, "documents"))


ARTICLES_SQL = f"""articles0 AS (
  SELECT *, {_quoted(HEADLINES)}[doc_id % {len(HEADLINES)} + 1] AS headline,
         {_quoted(CLOSINGS)}[(doc_id // {len(HEADLINES)}) % {len(CLOSINGS)} + 1] AS closing,
         (doc_id * 37) % 730 AS raw_off
  FROM documents),
articles1 AS (
  SELECT *, trim(headline || ' ' || string_split(text, chr(10))[1]) AS title0,
         strftime(DATE '2024-01-01' + CAST(CASE WHEN raw_off BETWEEN {GAP_FROM} AND {GAP_TO}
                  THEN raw_off + {GAP_SHIFT} ELSE raw_off END AS INTEGER), '%Y-%m-%d') AS day0
  FROM articles0),
articles AS (
  SELECT doc_id, doc_id AS ord, title0 AS title, title0 || '. ' || text || closing AS text,
         day0 AS date, CASE WHEN doc_id % 50 = 13 THEN 'n/a' ELSE day0 END AS date_raw,
         CASE WHEN doc_id % 10 <> 7 THEN 'http://example.com/news/' ||
              CAST(CASE WHEN doc_id % 5 = 4 THEN doc_id - 1 ELSE doc_id END AS VARCHAR)
         END AS url,
         source,
         {_quoted([o[0] for o in OUTLETS] + ["Local Desk"])}[
             CAST(substr(source, 4) AS INTEGER) % {len(OUTLETS) + 1} + 1] AS outlet,
         lang
  FROM articles1)"""


def as_labelled(df: DataFrame) -> DataFrame:
    """articles with TAX11 flags, scored on the cleaned text."""
    cleaned = settled(df, {"clean_text": clean_text(F.col("text"))})
    return classify(cleaned, lexicon_scorer(PHRASES, hits_for_one=2), TAX11)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_labelled(articles(spark, sf_dir))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), "text")


CLAIMS_SQL = "claims AS (SELECT item_id AS claim_id, text FROM benchmark)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages whose menu entries became headings: around the link, inside it, or not."""
    html = F.col("html")
    outside = F.replace(F.replace(html, F.lit("<li>"), F.lit("<h3>")),
                        F.lit("</li>"), F.lit("</h3>"))
    inside = F.regexp_replace(html, r"<li>(<a [^>]*>)([^<]*)</a></li>", "<li>$1<h2>$2</h2></a></li>")
    return pages(spark, sf_dir).withColumn(
        "html", F.when(F.col("page_id") % 3 == 0, outside)
        .when(F.col("page_id") % 3 == 1, inside).otherwise(html))


LISTING_SQL = r"""listing AS (
  SELECT page_id, url, CASE page_id % 3
    WHEN 0 THEN replace(replace(html, '<li>', '<h3>'), '</li>', '</h3>')
    WHEN 1 THEN regexp_replace(html, '<li>(<a [^>]*>)([^<]*)</a></li>',
                               '<li>\1<h2>\2</h2></a></li>', 'g')
    ELSE html END AS html FROM pages)"""


# Text rules repeated in SQL.
def clean_sql(col: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
            f"lower(coalesce({col}, '')), '{URL_PATTERN}', '', 'g'), "
            f"'{TAG_PATTERN}', '', 'g'), '{non_word_filter()}', '', 'g'), "
            f"'[{WS}]+', ' ', 'g'))")


def keywords_sql(source: str, key: str, col: str, name: str, limit: int = 10) -> str:
    """CTEs that end in ``name`` (key, kws): the first distinct keywords as a list."""
    strip = KEYWORD_STRIP.replace("'", "''")
    return f"""{name}_split AS (
  SELECT {key}, string_split_regex(regexp_replace(coalesce({col}, ''), '{strip}', '', 'g'),
                                   '[{WS}]+') AS l FROM {source}),
{name}_words AS (SELECT {key}, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM {name}_split),
{name}_first AS (SELECT {key}, w, min(pos) AS p FROM {name}_words
                 WHERE length(w) > 2 GROUP BY ALL),
{name}_rank AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY p) AS rn
                FROM {name}_first),
{name}_list AS (SELECT {key}, list(w ORDER BY rn) AS kws FROM {name}_rank
                WHERE rn <= {limit} GROUP BY {key}),
{name} AS (SELECT s.{key}, coalesce(l.kws, []) AS kws
           FROM (SELECT {key} FROM {source}) s LEFT JOIN {name}_list l USING ({key}))"""


def hits_sql(col: str, words: list[str]) -> str:
    listed = ", ".join("'" + w.lower() + "'" for w in words)
    return (f"len(list_distinct(list_filter(string_split_regex(lower({col}), '[{WS}]+'), "
            f"lambda w: list_contains([{listed}]::VARCHAR[], w))))")


def scores_sql(source: str, col: str, vocab: dict, divisor: int) -> str:
    """A table with the columns of ``source`` and one score per category."""
    per = ", ".join(f"least(1.0::DOUBLE, {hits_sql(col, ws)} / {divisor}.0::DOUBLE) AS s_{c}"
                    for c, ws in vocab.items())
    return f"SELECT *, {per} FROM {source}"


def flags_sql(source: str, col: str, cats: list[str], thr: float = 0.4,
              min_len: int = 10, out: str = "") -> str:
    long_enough = (f"length(regexp_replace({col}, '^[{WS}]+|[{WS}]+$', '', 'g')) >= {min_len}")
    crime = " OR ".join(f"s_{c} > {thr}" for c in cats if c != "non_crime")
    cols = []
    for c in cats:
        cond = f"s_{c} > {thr}" + (f" OR NOT ({crime})" if c == "non_crime" else "")
        cols.append(f"CAST({long_enough} AND ({cond}) AS INTEGER) AS {out}{c}")
    return f"SELECT *, {', '.join(cols)} FROM {source}"


LABELLED_SQL = (f"{ARTICLES_SQL}, "
                f"cleaned0 AS (SELECT *, {clean_sql('text')} AS clean_text FROM articles), "
                f"scored0 AS ({scores_sql('cleaned0', 'clean_text', PHRASES, 2)}), "
                f"labelled AS ({flags_sql('scored0', 'clean_text', TAX11)})")
