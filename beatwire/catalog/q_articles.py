"""Scans, projections, filters, top-k reports and counts over articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatwire.catalog.registry import query
from beatwire.catalog.views import (
    ARTICLES_SQL, CLAIMS_SQL, LABELLED_SQL, articles, claims, clean_sql, keywords_sql,
    labelled,
)
from beatwire.dims import GROUPS, INDIC_LANGS, OUTLETS, TAX11, outlet_table
from beatwire.functions.labels import active_labels, display_name, label_groups, label_key
from beatwire.functions.text import (
    HINDI_WORDS, MARATHI_WORDS, SCRIPT_LANG, SCRIPT_RANGES, WS, clean_text, detect_language,
    extract_keywords,
)
from beatwire.operators import select as sel
from beatwire.operators import trend as tr
from beatwire.schemas import ARTICLE
from beatwire.session import work_dir
from beatwire.sources.outlets import attach_source
from beatwire.sources.tables import read_articles, write_articles


@query("scan_articles", f"WITH {ARTICLES_SQL} SELECT doc_id, title, date, url, source, "
       "md5(text) AS text_md5 FROM articles")
def scan_articles(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "doc_id", "title", "date", "url", "source", F.md5("text").alias("text_md5"))


@query("roundtrip_sink", f"WITH {ARTICLES_SQL} SELECT title, date_raw AS date, url, source, "
       "md5(text) AS text_md5 FROM articles")
def roundtrip_sink(spark, sf_dir):
    """Written by month, read back."""
    path = work_dir(spark, "articles")
    df = articles(spark, sf_dir).withColumn("date", F.col("date_raw")).select(*ARTICLE.names)
    write_articles(df, path)
    return read_articles(spark, path).select(
        "title", "date", "url", "source", F.md5("text").alias("text_md5"))


@query("source_lang", f"""WITH {ARTICLES_SQL},
outlets(source, kind, language) AS (VALUES {", ".join(
    f"('{o[0]}', '{o[2]}', {'NULL' if o[3] is None else repr(o[3])})" for o in OUTLETS)})
SELECT a.doc_id, a.outlet AS source, o.kind, o.language
FROM articles a LEFT JOIN outlets o ON a.outlet = o.source""")
def source_lang(spark, sf_dir):
    df = articles(spark, sf_dir).select("doc_id", F.col("outlet").alias("source"))
    return attach_source(df, outlet_table(spark)).select("doc_id", "source", "kind", "language")


@query("clean_text", f"WITH {ARTICLES_SQL} SELECT doc_id, {clean_sql('text')} AS clean_text "
       "FROM articles")
def clean_texts(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "doc_id", clean_text(F.col("text")).alias("clean_text"))


@query("clean_nonempty", f"WITH {ARTICLES_SQL}, cleaned AS (SELECT doc_id, "
       f"{clean_sql('text')} AS clean_text FROM articles) "
       "SELECT doc_id, clean_text FROM cleaned WHERE length(clean_text) > 0")
def clean_nonempty(spark, sf_dir):
    cleaned = sel.settled(articles(spark, sf_dir), {"clean_text": clean_text(F.col("text"))})
    return sel.drop_empty_clean(cleaned.select("doc_id", "clean_text"))


def _detect_sql(col: str) -> str:
    def count(r: str) -> str:
        return f"length(regexp_replace({col}, '[^{r}]', '', 'g'))"

    def hits(ws: list[str]) -> str:
        listed = ", ".join(f"'{w}'" for w in ws)
        return (f"len(list_filter(string_split_regex({col}, '[{WS}]+'), "
                f"lambda w: list_contains([{listed}], w)))")

    tokens = f"len(list_filter(string_split_regex({col}, '[{WS}]+'), lambda w: w <> ''))"
    top = "greatest(" + ", ".join(count(r) for r in SCRIPT_RANGES.values()) + ")"
    other = " ".join(f"WHEN {count(SCRIPT_RANGES[s])} = {top} THEN '{lang}'"
                     for s, lang in SCRIPT_LANG.items())
    return (f"CASE WHEN NOT regexp_matches({col}, '[\\x{{0900}}-\\x{{0D7F}}]') THEN 'en' "
            f"WHEN {tokens} < 5 THEN 'en' WHEN {count('a-z')} > {top} OR {top} = 0 THEN 'en' "
            f"WHEN {count(SCRIPT_RANGES['devanagari'])} = {top} THEN "
            f"CASE WHEN {hits(MARATHI_WORDS)} > {hits(HINDI_WORDS)} THEN 'mr' ELSE 'hi' END "
            f"{other} END")


LANGS_SQL = (f"{ARTICLES_SQL}, cleaned AS (SELECT doc_id, {clean_sql('title')} AS title, "
          f"{clean_sql('text')} AS text FROM articles), "
          f"langs AS (SELECT doc_id, {_detect_sql('title')} AS lang, "
          f"{_detect_sql('text')} AS text_lang FROM cleaned)")


@query("detect_language", f"WITH {LANGS_SQL} SELECT doc_id, lang, text_lang FROM langs")
def detect_languages(spark, sf_dir):
    """Language of the cleaned title and of the cleaned text of every article."""
    cleaned = articles(spark, sf_dir).select(
        "doc_id", clean_text(F.col("title")).alias("title"), clean_text(F.col("text")).alias("text"))
    return cleaned.select("doc_id", detect_language(F.col("title")).alias("lang"),
                          detect_language(F.col("text")).alias("text_lang"))


@query("language_counts", f"WITH {LANGS_SQL} SELECT lang, count(*) AS n FROM langs GROUP BY 1")
def language_counts(spark, sf_dir):
    return tr.language_counts(detect_languages(spark, sf_dir))


@query("extract_keywords", f"WITH {ARTICLES_SQL}, "
       f"{keywords_sql('articles', 'doc_id', 'text', 'kw')} "
       "SELECT doc_id, array_to_string(kws, '|') AS keywords FROM kw")
def keywords(spark, sf_dir):
    return articles(spark, sf_dir).select(
        "doc_id", F.array_join(extract_keywords(F.col("text")), "|").alias("keywords"))


@query("filter_source", f"WITH {ARTICLES_SQL} SELECT doc_id, source FROM articles "
       "WHERE source IN ('src3', 'src7')")
def filter_source(spark, sf_dir):
    return sel.filter_source(articles(spark, sf_dir), ["src3", "src7"]).select("doc_id", "source")


@query("filter_category", f"WITH {LABELLED_SQL} SELECT doc_id, title FROM labelled "
       "WHERE kidnapping = 1")
def filter_category(spark, sf_dir):
    return sel.filter_category(labelled(spark, sf_dir), "Kidnapping").select(
        "doc_id", "title")


@query("claims_valid", f"""WITH {CLAIMS_SQL}, firsts AS (
  SELECT claim_id, unnest(string_split(text, '. ')) AS text FROM claims)
SELECT claim_id, text, length(text) >= 50 AS accepted FROM firsts""")
def claims_valid(spark, sf_dir):
    """Every sentence of every claim, checked for length; both outcomes are shown."""
    parts = claims(spark, sf_dir).select(
        "claim_id", F.explode(F.split("text", r"\. ")).alias("text"))
    ok, rejected = sel.split_claims(parts)
    return ok.withColumn("accepted", F.lit(True)).unionByName(
        rejected.withColumn("accepted", F.lit(False)))


ROUTE_SQL = ("CASE WHEN lang IN (" + ", ".join(f"'{c}'" for c in INDIC_LANGS)
          + ") THEN 'indic' ELSE 'general' END")


@query("route_language", f"WITH {LANGS_SQL} SELECT doc_id, lang, {ROUTE_SQL} AS route FROM langs")
def route_language(spark, sf_dir):
    """Routes by the language of the title."""
    return sel.route_language(detect_languages(spark, sf_dir).drop("text_lang"))


@query("route_fallback", f"WITH {LANGS_SQL}, "
       f"routed AS (SELECT doc_id, lang, {ROUTE_SQL} AS route FROM langs) "
       "SELECT doc_id, 'indic' AS wanted FROM routed WHERE route = 'indic' "
       "OR (SELECT count(*) FROM routed WHERE route = 'indic') < 10 "
       "UNION ALL SELECT doc_id, 'none' AS wanted FROM routed "
       "WHERE (SELECT count(*) FROM routed WHERE route = 'none') < 10 OR route = 'none'")
def route_fallback(spark, sf_dir):
    """A route that is large enough, and one without rows, which gives everything."""
    routed = route_language(spark, sf_dir)
    return (sel.route_or_all(routed, "indic", 10).select("doc_id", F.lit("indic").alias("wanted"))
            .unionByName(sel.route_or_all(routed, "none", 10)
                         .select("doc_id", F.lit("none").alias("wanted"))))


@query("label_lite", f"WITH {ARTICLES_SQL} SELECT doc_id, "
       + ", ".join(f"{1 if c == 'non_crime' else 0} AS {c}" for c in TAX11) + " FROM articles")
def label_lite(spark, sf_dir):
    return sel.label_lite(articles(spark, sf_dir).select("doc_id"), TAX11)


@query("sample_records", f"WITH {ARTICLES_SQL} SELECT ord, left(title, 70) AS sample "
       "FROM articles ORDER BY ord LIMIT 3")
def sample_records(spark, sf_dir):
    return sel.sample_records(articles(spark, sf_dir), "ord", col="title")


_ACTIVE = ("list_filter([" + ", ".join(
    f"CASE WHEN {c} = 1 THEN '{c}' END" for c in TAX11) + "], lambda k: k IS NOT NULL)")
_GROUP = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GROUPS.items()) + " END"


@query("active_labels", f"""WITH {LABELLED_SQL}, marked AS (
  SELECT doc_id, CASE WHEN len({_ACTIVE}) = 0 THEN ['unclassified'] ELSE {_ACTIVE} END AS ls
  FROM labelled)
SELECT doc_id, array_to_string(ls, '|') AS labels,
  array_to_string(list_transform(ls, lambda k: array_to_string(list_transform(
    string_split(k, '_'), lambda w: upper(w[1]) || w[2:]), ' ')), '|') AS names,
  array_to_string(list_transform(ls, lambda k: {_GROUP}), '|') AS groups,
  array_to_string(ls, '|') AS keys_again FROM marked""")
def active(spark, sf_dir):
    df = labelled(spark, sf_dir).select("doc_id", active_labels(TAX11).alias("ls"))
    names = F.transform("ls", display_name)
    return df.select(
        "doc_id", F.array_join("ls", "|").alias("labels"),
        F.array_join(names, "|").alias("names"),
        F.array_join(label_groups(F.col("ls"), GROUPS), "|").alias("groups"),
        F.array_join(F.transform(names, label_key), "|").alias("keys_again"))


@query("live_feed", f"""WITH {ARTICLES_SQL}
SELECT doc_id, title, date, source, (SELECT count(*) FROM articles) AS n_total,
       least(20, (SELECT count(*) FROM articles)) AS n_shown
FROM articles ORDER BY date DESC NULLS LAST, ord LIMIT 20""")
def live_feed(spark, sf_dir):
    return sel.live_feed(articles(spark, sf_dir), "ord").select(
        "doc_id", "title", "date", "source", "n_total", "n_shown")


@query("browse_feed", f"""WITH {LABELLED_SQL}, passed AS (SELECT * FROM labelled
  WHERE source IN ('src2', 'src6', 'src14') AND robbery = 1)
SELECT doc_id, title, date, source, (SELECT count(*) FROM passed) AS n_total,
       least(10, (SELECT count(*) FROM passed)) AS n_shown
FROM passed ORDER BY date DESC NULLS LAST, doc_id LIMIT 10""")
def browse_feed(spark, sf_dir):
    """Three sources and one category, newest first, ten rows of so many."""
    return sel.browse(labelled(spark, sf_dir), "doc_id", ["src2", "src6", "src14"], "Robbery", 10,
                      ["title", "date", "source"])


_MATCHED = ("list_filter([CASE WHEN murder = 1 THEN 'murder' END, "
            "CASE WHEN rape = 1 THEN 'rape' END, "
            "CASE WHEN kidnapping = 1 THEN 'kidnapping' END], lambda k: k IS NOT NULL)")
ALERT_SQL = (f"chr(128680) || ' ' || title || ' (' || array_to_string(list_transform({_MATCHED}, "
             "lambda k: upper(k[1]) || k[2:]), ', ') || ')'")
CRITICAL_SQL = "murder = 1 OR rape = 1 OR kidnapping = 1"


@query("critical_alerts", f"WITH {LABELLED_SQL} SELECT ord, array_to_string({_MATCHED}, '|') "
       f"AS matched, {ALERT_SQL} AS message FROM labelled WHERE {CRITICAL_SQL} "
       "ORDER BY ord LIMIT 5")
def critical_alerts(spark, sf_dir):
    return sel.critical_alerts(labelled(spark, sf_dir), "ord").withColumn(
        "matched", F.array_join("matched", "|"))


@query("preview_100", f"WITH {ARTICLES_SQL} SELECT ord, title, date, url, source FROM articles "
       "ORDER BY ord LIMIT 100")
def preview_100(spark, sf_dir):
    return sel.preview(articles(spark, sf_dir), "ord").select(
        "ord", "title", "date", "url", "source")


@query("source_options", "SELECT 0 AS rank, 'All Sources' AS source UNION ALL "
       "SELECT DISTINCT 1 AS rank, source FROM documents WHERE source IS NOT NULL")
def source_options(spark, sf_dir):
    return sel.source_options(articles(spark, sf_dir))


@query("category_totals", f"WITH {LABELLED_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS category, CAST(sum({c}) AS BIGINT) AS total FROM labelled" for c in TAX11))
def category_totals(spark, sf_dir):
    return tr.category_totals(labelled(spark, sf_dir), TAX11)


@query("dataset_overview", f"WITH {LABELLED_SQL} SELECT count(*) AS n_articles, "
       "count(DISTINCT source) AS n_sources, "
       f"CAST(sum({' + '.join(TAX11)}) AS BIGINT) AS n_labels FROM labelled")
def dataset_overview(spark, sf_dir):
    return tr.overview(labelled(spark, sf_dir), TAX11)


@query("source_counts", f"WITH {ARTICLES_SQL} SELECT source, count(*) AS n FROM articles GROUP BY 1")
def source_counts(spark, sf_dir):
    return tr.source_counts(articles(spark, sf_dir))
