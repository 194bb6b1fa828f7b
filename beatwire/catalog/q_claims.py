"""Claims against the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatwire.catalog.registry import query
from beatwire.catalog.views import ARTICLES_SQL, CLAIMS_SQL, articles, claims, keywords_sql
from beatwire.operators import search as se
from beatwire.operators.word_index import WordIndex
from beatwire.session import work_dir


def _corpus(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", "title", "text", "url", "source")


SEARCH_SQL = f"""{ARTICLES_SQL}, {CLAIMS_SQL},
{keywords_sql('claims', 'claim_id', 'text', 'ck')},
words AS (SELECT claim_id, lower(unnest(kws)) AS kw FROM ck),
weights AS (SELECT claim_id, kw, count(*) AS weight FROM words GROUP BY ALL),
uniq AS (SELECT DISTINCT kw FROM weights),
low AS (SELECT doc_id, lower(title || ' ' || text) AS t FROM articles),
post AS MATERIALIZED (SELECT doc_id, kw FROM low JOIN uniq ON contains(t, kw)),
scored AS (SELECT claim_id, doc_id, CAST(sum(weight) AS BIGINT) AS score
  FROM weights JOIN post USING (kw) GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, doc_id) AS rank
  FROM scored),
hits AS (SELECT claim_id, rank, doc_id, score FROM ranks WHERE rank <= {se.TOP_HITS})"""


@query("keyword_matches", f"WITH {SEARCH_SQL} SELECT claim_id, kw, weight, "
       "(SELECT count(*) FROM post p WHERE p.kw = w.kw) AS n_docs FROM weights w")
def keyword_matches(spark, sf_dir):
    return se.keyword_matches(claims(spark, sf_dir), _corpus(spark, sf_dir))


@query("search_corpus", f"WITH {SEARCH_SQL} SELECT h.claim_id, h.rank, h.doc_id, a.title, a.url, "
       "a.source, h.score AS match_score FROM hits h JOIN articles a USING (doc_id)")
def search_corpus(spark, sf_dir):
    """The five best articles of every claim, with what is shown of them."""
    corpus = _corpus(spark, sf_dir)
    hits = se.search_corpus(claims(spark, sf_dir), corpus)
    return se.hit_articles(hits, corpus).select(
        "claim_id", "rank", "doc_id", "title", "url", "source",
        F.col("score").alias("match_score"))


@query("search_top5", f"WITH {SEARCH_SQL} SELECT * FROM hits")
def search_top5(spark, sf_dir):
    """The ranking alone."""
    return se.search_corpus(claims(spark, sf_dir), _corpus(spark, sf_dir))


@query("search_index", f"WITH {SEARCH_SQL} SELECT claim_id % 2 = 1 AS odd, * FROM hits")
def search_index(spark, sf_dir):
    """Half of the articles is indexed, the other half added; two batches of claims read both."""
    index = WordIndex(spark, work_dir(spark, "word-index"))
    corpus = _corpus(spark, sf_dir)
    for half in (0, 1):
        index.add(corpus.where(F.col("doc_id") % 2 == half))
    odd = F.col("claim_id") % 2 == 1
    checked = claims(spark, sf_dir)
    first, second = (index.search(checked.where(batch)) for batch in (odd, ~odd))
    return first.unionByName(second).select(odd.alias("odd"), "claim_id", "rank", "doc_id", "score")


SIMILARITY_SQL = f"""{SEARCH_SQL},
low_claims AS (SELECT claim_id, lower(text) AS text FROM claims),
{keywords_sql('low_claims', 'claim_id', 'text', 'ok')},
hit_docs AS (SELECT doc_id, lower(text) AS text FROM articles
  WHERE doc_id IN (SELECT doc_id FROM hits)),
{keywords_sql('hit_docs', 'doc_id', 'text', 'ak')},
sims AS (SELECT h.claim_id, h.rank, h.doc_id, CASE WHEN len(ok.kws) = 0 THEN 0.0::DOUBLE ELSE
  least(100.0::DOUBLE, len(list_intersect(ok.kws, ak.kws)) / len(ok.kws)::DOUBLE * 100.0::DOUBLE)
  END AS similarity FROM hits h JOIN ok USING (claim_id) JOIN ak USING (doc_id))"""


def _similarities(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    checked = claims(spark, sf_dir)
    hits = se.hit_articles(se.search_corpus(checked, corpus), corpus)
    return checked, se.claim_similarity(checked, hits)


@query("claim_similarity", f"WITH {SIMILARITY_SQL} SELECT claim_id, rank, doc_id, "
       "round(similarity, 6) AS similarity FROM sims")
def claim_similarity(spark, sf_dir):
    return _similarities(spark, sf_dir)[1].select(
        "claim_id", "rank", "doc_id", F.round("similarity", 6).alias("similarity"))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _counted(s: str) -> str:
    head, tail = s.split("%d")
    return f"{_text(head)} || CAST(n AS VARCHAR) || {_text(tail)}"


VERDICT_SQL = f"""{SIMILARITY_SQL},
per AS (SELECT c.claim_id, count(s.doc_id) AS n, coalesce(max(similarity), 0.0::DOUBLE) AS best,
  coalesce(avg(similarity), 0.0::DOUBLE) AS mean,
  coalesce(string_agg(doc_title || '=' || CAST(CAST(floor(similarity) AS INT) AS VARCHAR), '|'
    ORDER BY rank), '') AS sources
  FROM claims c LEFT JOIN (SELECT sims.*, a.title AS doc_title FROM sims JOIN articles a
    USING (doc_id)) s USING (claim_id) GROUP BY 1),
st AS (SELECT *, CASE WHEN n = 0 THEN 'Inconclusive' WHEN best > 75 THEN 'Verified'
  WHEN best > 40 THEN 'Partially Matches' ELSE 'Inconsistent / Low Evidence' END AS status FROM per)"""


@query("claim_verdict", f"""WITH {VERDICT_SQL}
SELECT claim_id, status, CAST(floor(best) AS INT) AS score, n AS n_sources,
  round(mean, 6) AS mean_similarity, sources,
  CASE WHEN n = 0 THEN {_text(se.REASON_NONE)} WHEN best > 75 THEN {_counted(se.REASON_HIGH)}
    WHEN best > 40 THEN {_counted(se.REASON_MIDDLE)} ELSE {_text(se.REASON_LOW)} END AS reasoning,
  CASE WHEN status = 'Verified' THEN 'green' WHEN contains(status, 'Matches') THEN 'orange'
    ELSE 'red' END AS light FROM st""")
def claim_verdict(spark, sf_dir):
    checked, sims = _similarities(spark, sf_dir)
    listed = F.array_join(F.transform("sources", lambda s: F.concat(
        s["title"], F.lit("="), s["similarity"].cast("string"))), "|")
    return se.claim_verdict(checked, sims).select(
        "claim_id", "status", "score", "n_sources",
        F.round("mean_similarity", 6).alias("mean_similarity"),
        listed.alias("sources"), "reasoning", "light")
