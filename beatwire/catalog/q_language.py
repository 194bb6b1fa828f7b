"""Language by profiles of character runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatwire.catalog.registry import query, table
from beatwire.functions.text import WS
from beatwire.operators.language import PAD, SIZE, fit_profiles, identify

# Fitted on documents with an even id, judged on the others.
_WORDS = f"list_filter(string_split_regex(lower(text), '[{WS}]+'), lambda w: w <> '')"
_GRAMS = (f"list_transform(range(1, greatest(length(w) + {3 - SIZE}, 1) + 1), "
          f"lambda i: substr('{PAD}' || w || '{PAD}', i, {SIZE}))")
PROFILE_SQL = f"""words AS (SELECT doc_id, lang, unnest({_WORDS}) AS w FROM documents),
counted AS (SELECT lang, w, count(*) AS n FROM words WHERE doc_id % 2 = 0 AND lang IS NOT NULL GROUP BY ALL),
grams AS (SELECT lang, n, unnest({_GRAMS}) AS gram FROM counted),
profile AS (SELECT lang, gram, CAST(sum(n) AS BIGINT) AS n FROM grams GROUP BY ALL)"""


def _profiles(spark, sf_dir):
    return fit_profiles(table(spark, sf_dir, "documents").where("doc_id % 2 = 0"))


@query("language_profile", f"WITH {PROFILE_SQL} SELECT lang, gram, n FROM profile")
def language_profile(spark, sf_dir):
    """Every run of three characters and its exact count in each language."""
    return _profiles(spark, sf_dir)


@query("language_agreement", f"""WITH {PROFILE_SQL},
sizes AS (SELECT lang, sum(n) AS total, (SELECT count(DISTINCT gram) FROM profile) AS v FROM profile GROUP BY lang),
logs AS (SELECT g.gram, s.lang, ln((coalesce(p.n, 0) + 1.0::DOUBLE) / (total + v)::DOUBLE) AS l
  FROM (SELECT DISTINCT gram FROM profile) g CROSS JOIN sizes s LEFT JOIN profile p ON p.gram = g.gram AND p.lang = s.lang),
held AS (SELECT doc_id, w, count(*) AS n FROM words WHERE doc_id % 2 = 1 GROUP BY ALL),
per_word AS (SELECT w, lang, sum(l) AS l FROM (SELECT w, unnest({_GRAMS}) AS gram
  FROM (SELECT DISTINCT w FROM held)) JOIN logs USING (gram) GROUP BY ALL),
scored AS (SELECT doc_id, lang, sum(l * n) AS l FROM held JOIN per_word USING (w) GROUP BY ALL),
guessed AS (SELECT doc_id, arg_max(lang, l) AS guess FROM scored GROUP BY doc_id)
SELECT d.lang, coalesce(g.guess, 'en') AS guess, count(*) AS n FROM documents d LEFT JOIN guessed g USING (doc_id)
WHERE d.doc_id % 2 = 1 GROUP BY ALL""")
def language_agreement(spark, sf_dir):
    """Languages stated and guessed, on documents that no profile was fitted on."""
    rest = table(spark, sf_dir, "documents").where("doc_id % 2 = 1").select("doc_id", "lang", "text")
    guess = identify(rest.select("doc_id", "text"), _profiles(spark, sf_dir), "doc_id")
    return (rest.select("doc_id", "lang").join(guess.select("doc_id", F.col("lang").alias("guess")), "doc_id")
            .groupBy("lang", "guess").agg(F.count(F.lit(1)).alias("n")))
