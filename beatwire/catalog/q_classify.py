"""Scores, labels, predictions and the linear baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatwire.catalog.registry import query, table
from beatwire.catalog.views import (
    ARTICLES_SQL, LABELLED_SQL, articles, clean_sql, flags_sql, labelled, scores_sql,
)
from beatwire.dims import TAX6, TAX11, VOCAB6
from beatwire.functions.text import WS, clean_text, words
from beatwire.operators.classify import (
    classify, lexicon_scorer, model_scorer, predict_labels, scores_long,
    threshold_labels as threshold_labels_of,
)
from beatwire.operators.evaluate import (
    confusion, fit_svm, fit_word_weights, load_svm, multilabel_metrics, predict_svm, save_svm,
    score_words,
)
from beatwire.operators.select import sample_records
from beatwire.operators.split import split_exact
from beatwire.session import work_dir, written


CLASSIFIED_SQL = (f"{ARTICLES_SQL}, scored AS ({scores_sql('articles', 'text', VOCAB6, 3)}), "
                  f"classified AS ({flags_sql('scored', 'text', TAX6)})")


def classified(spark, sf_dir):
    """articles with TAX6 flags from the default scorer, over raw text."""
    return classify(articles(spark, sf_dir), lexicon_scorer(VOCAB6), TAX6, text_col="text")


@query("lexicon_scores", f"WITH {ARTICLES_SQL}, "
       f"scored AS ({scores_sql('articles', 'text', VOCAB6, 3)}) " + " UNION ALL ".join(
           f"SELECT doc_id, '{c}' AS label, round(s_{c}, 6) AS score FROM scored" for c in TAX6))
def lexicon_scores(spark, sf_dir):
    scored = lexicon_scorer(VOCAB6)(articles(spark, sf_dir), "text")
    return scores_long(scored, "doc_id", TAX6).withColumn("score", F.round("score", 6))


@query("threshold_labels", f"WITH {LABELLED_SQL} SELECT doc_id, {', '.join(TAX11)} FROM labelled")
def threshold_labels(spark, sf_dir):
    """Eleven categories on the cleaned text of every article."""
    return labelled(spark, sf_dir).select("doc_id", *TAX11)


@query("classify_articles", f"WITH {ARTICLES_SQL}, cleaned AS (SELECT doc_id, "
       f"{clean_sql('text')} AS clean_text FROM articles), "
       f"scored AS ({scores_sql('cleaned', 'clean_text', VOCAB6, 3)}), "
       f"flagged AS ({flags_sql('scored', 'clean_text', TAX6)}) "
       f"SELECT doc_id, {', '.join(TAX6)} FROM flagged")
def classify_articles(spark, sf_dir):
    df = articles(spark, sf_dir).select("doc_id", clean_text(F.col("text")).alias("clean_text"))
    return classify(df, lexicon_scorer(VOCAB6), TAX6).select("doc_id", *TAX6)


_LABEL_LIST = ("list_filter([" + ", ".join(f"CASE WHEN {c} = 1 THEN '{c}' END" for c in TAX6)
               + "], lambda k: k IS NOT NULL)")


@query("predict_sample", f"""WITH {CLASSIFIED_SQL}
SELECT doc_id, left(title, 70) AS sample,
  CASE WHEN len({_LABEL_LIST}) = 0 THEN 'unclassified'
       ELSE array_to_string({_LABEL_LIST}, '|') END AS labels
FROM classified ORDER BY doc_id LIMIT 3""")
def predict_sample(spark, sf_dir):
    """Labels of the first three articles, the text cut to a line."""
    first = articles(spark, sf_dir).orderBy("doc_id").limit(3)
    labels = predict_labels(first, lexicon_scorer(VOCAB6), TAX6, text_col="text").select(
        "doc_id", F.array_join("labels", "|").alias("labels"))
    return sample_records(first, "doc_id", col="title").join(labels, "doc_id")


# --- the given labels: quality and toxic ---------------------------------------------

GIVEN = ["quality", "toxic"]


def labelled_texts(spark, sf_dir):
    """documents that have labels: doc_id, clean_text, quality, toxic."""
    texts = table(spark, sf_dir, "documents").select(
        "doc_id", clean_text(F.col("text")).alias("clean_text"))
    return texts.join(table(spark, sf_dir, "labels"), "doc_id")


_LABELLED = (f"given AS (SELECT doc_id, {clean_sql('text')} AS clean_text, quality, toxic "
             "FROM documents JOIN labels USING (doc_id))")
# A text guessed good has 50 words, one guessed toxic holds a word of this list.
WORDS_OF_GOOD, TOXIC_WORDS = 50, ["idiot", "moron", "stupid", "scum", "trash"]


def _metrics_sql(source: str) -> str:
    def rate(c):
        tp = f"count(*) FILTER ({c} = 1 AND p_{c} = 1)"
        either = f"count(*) FILTER ({c} = 1 OR p_{c} = 1)"
        return f"CASE WHEN {tp} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {tp} / ({tp} + {either}) END"
    wrong = " + ".join(f"CAST({c} <> p_{c} AS INTEGER)" for c in GIVEN)
    return (f"SELECT count(*) AS n_rows, "
            f"round(count(*) FILTER ({wrong} = 0) / count(*)::DOUBLE, 6) AS accuracy, "
            f"round(({' + '.join(rate(c) for c in GIVEN)}) / {len(GIVEN)}, 6) AS macro_f1, "
            f"round(sum({wrong}) / (count(*) * {len(GIVEN)})::DOUBLE, 6) AS hamming_loss "
            f"FROM {source}")


def _rounded(df):
    return df.select("n_rows", *[F.round(c, 6).alias(c)
                                 for c in ("accuracy", "macro_f1", "hamming_loss")])


_TOKENS = f"list_filter(string_split_regex(clean_text, '[{WS}]+'), lambda w: w <> '')"


@query("multilabel_metrics", f"WITH {_LABELLED}, guessed AS (SELECT *, "
       f"CAST(len({_TOKENS}) >= {WORDS_OF_GOOD} AS INTEGER) AS p_quality, "
       f"CAST(len(list_intersect({_TOKENS}, {TOXIC_WORDS!r})) > 0 AS INTEGER) AS p_toxic "
       f"FROM given) {_metrics_sql('guessed')}")
def metrics(spark, sf_dir):
    """The given labels against guesses from length and a word list."""
    tokens = F.filter(words(F.col("clean_text")), lambda w: w != "")
    listed = F.array(*[F.lit(w) for w in TOXIC_WORDS])
    guess = labelled_texts(spark, sf_dir).select(
        *GIVEN, (F.size(tokens) >= WORDS_OF_GOOD).cast("int").alias("p_quality"),
        F.arrays_overlap(tokens, listed).cast("int").alias("p_toxic"))
    return _rounded(multilabel_metrics(guess, GIVEN))


_PARTED = f"""{_LABELLED}, numbered AS (SELECT *, row_number() OVER (
    ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM given),
parted AS (SELECT *, rn <= floor(0.8::DOUBLE * (SELECT count(*) FROM given)) AS train FROM numbered)"""


def _parts(spark, sf_dir):
    rows = written(labelled_texts(spark, sf_dir), "labelled-texts")
    return written(split_exact(rows, "doc_id"), "parts")


@query("svm_baseline", f"""WITH {_PARTED}
SELECT label, count(*) AS n_rows, count(*) FILTER (train) AS n_train, count(*) FILTER (NOT train) AS n_test,
  sum(y)::BIGINT AS positives, count(*) FILTER (NOT train AND y = 1) AS test_positives,
  true AS fits_better_than_majority, count(*) AS same_after_reload
FROM (SELECT 'quality' AS label, quality AS y, train FROM parted
      UNION ALL SELECT 'toxic', toxic, train FROM parted) GROUP BY label""")
def svm_baseline(spark, sf_dir):
    """Trained on four fifths of the labelled texts, saved, loaded, applied to all.

    A row, of either part, counts as the same when the model that was saved and
    read back guesses what the fitted one does. Positives are those found and those
    missed of an exact confusion count; the flag says that no fewer of all rows are
    right than by always guessing the commoner label.
    """
    path = work_dir(spark, "svm")
    parts = _parts(spark, sf_dir)
    model = fit_svm(parts.where("part = 'train'"), GIVEN)
    save_svm(model, path)
    guess = predict_svm(model, parts, GIVEN)
    again = predict_svm(load_svm(path), parts, GIVEN).select(
        "doc_id", *[F.col(f"p_{c}").alias(f"q_{c}") for c in GIVEN])
    both = written(guess.drop("clean_text").join(again, "doc_id"), "guesses")
    same = both.agg(F.array(*[F.struct(
        F.lit(c).alias("label"), F.count_if(F.col(f"p_{c}") == F.col(f"q_{c}")).alias("same_after_reload"))
        for c in GIVEN]).alias("a")).select(F.inline("a"))
    held_out = confusion(both.where("part = 'test'"), GIVEN).select(
        "label", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n_test"),
        (F.col("tp") + F.col("fn")).alias("test_positives"))
    n_train = parts.agg(F.count_if(F.col("part") == "train")).scalar()
    yes, no = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return (confusion(both, GIVEN).join(F.broadcast(held_out), "label").join(F.broadcast(same), "label")
            .select("label", (yes + no).alias("n_rows"), n_train.alias("n_train"), "n_test",
                    yes.alias("positives"), "test_positives",
                    (F.col("tp") + F.col("tn") >= F.greatest(yes, no)).alias("fits_better_than_majority"),
                    "same_after_reload"))


_DISTINCT = f"list_distinct({_TOKENS})"


def _weights_sql(c: str) -> str:
    return f"""{c}_held AS (SELECT {c} AS y, unnest({_DISTINCT}) AS w FROM parted WHERE train),
{c}_size AS (SELECT count(*) FILTER ({c} = 1) AS ones, count(*) FILTER ({c} = 0) AS zeros FROM parted WHERE train),
{c}_weight AS (SELECT w, ln((count(*) FILTER (y = 1) + 1.0::DOUBLE) / (any_value(ones) + 2))
  - ln((count(*) FILTER (y = 0) + 1.0::DOUBLE) / (any_value(zeros) + 2)) AS weight
  FROM {c}_held, {c}_size GROUP BY w),
{c}_sum AS (SELECT doc_id, sum(weight) AS s FROM (SELECT doc_id, unnest({_DISTINCT}) AS w FROM parted
  WHERE NOT train) JOIN {c}_weight USING (w) GROUP BY doc_id),
{c}_guess AS (SELECT '{c}' AS label, p.{c} AS y, coalesce(s, 0) + ln(ones + 1.0::DOUBLE) - ln(zeros + 1.0::DOUBLE) > 0
  AS g FROM (SELECT * FROM parted WHERE NOT train) p CROSS JOIN {c}_size LEFT JOIN {c}_sum USING (doc_id))"""


@query("word_weights", f"""WITH {_PARTED}, {", ".join(map(_weights_sql, GIVEN))}
SELECT label, count(*) FILTER (y = 1 AND g) AS tp, count(*) FILTER (y = 0 AND g) AS fp,
  count(*) FILTER (y = 1 AND NOT g) AS fn, count(*) FILTER (y = 0 AND NOT g) AS tn
FROM ({" UNION ALL ".join(f"SELECT * FROM {c}_guess" for c in GIVEN)}) GROUP BY label""")
def word_weights(spark, sf_dir):
    """The linear model in closed form: confusion counts on the rows held out."""
    parts = _parts(spark, sf_dir)
    test = parts.where("part = 'test'")
    for c in GIVEN:
        weights = fit_word_weights(parts.where("part = 'train'"), c)
        found = score_words(test.select("doc_id", "clean_text"), weights, "doc_id")
        test = test.join(found.select("doc_id", (F.col("score") > 0).cast("int").alias(f"p_{c}")), "doc_id")
    return confusion(test, GIVEN)


# --- a model given from outside --------------------------------------------------------

# A stand-in for a model: how often a text holds a phrase, of the times that score 1.
MODEL_PHRASES, MODEL_FULL = ["the", "ion", "und", "que"], 40


def load_counting_model():
    """What a worker loads once: texts and phrases to a matrix of scores."""
    def model(texts, phrases):
        return [[min(1.0, text.lower().count(p) / MODEL_FULL) for p in phrases] for text in texts]

    return model


_COUNT = "(length(lower(text)) - length(replace(lower(text), '{0}', ''))) / {1}"


@query("model_labels", f"WITH {ARTICLES_SQL}, scored AS (SELECT doc_id, length(regexp_replace(text, "
       f"'^[{WS}]+|[{WS}]+$', '', 'g')) AS size, " + ", ".join(
           "least(1.0::DOUBLE, " + _COUNT.format(p, f"{len(p)}.0::DOUBLE / {MODEL_FULL}.0::DOUBLE")
           + f") AS s_{p}" for p in MODEL_PHRASES)
       + " FROM articles) SELECT doc_id, " + ", ".join(
           f"round(s_{p}, 6) AS score_{p}, CAST(size >= 10 AND s_{p} > 0.4 AS INTEGER) AS {p}"
           for p in MODEL_PHRASES) + " FROM scored")
def model_labels(spark, sf_dir):
    """Scores and labels of a model that runs in Python on Arrow batches."""
    scorer = model_scorer("counting", load_counting_model, MODEL_PHRASES)
    scored = scorer(articles(spark, sf_dir).select("doc_id", "text"), "text")
    return written(threshold_labels_of(scored, MODEL_PHRASES, "text"), "model-labels").select(
        "doc_id", *[F.round(F.get("scores", F.lit(i)), 6).alias(f"score_{p}")
                    for i, p in enumerate(MODEL_PHRASES)], *MODEL_PHRASES)
