"""Multi-label classification: a scorer, a threshold, a fallback.

A scorer is any function ``(df, text_col) -> df`` that adds ``scores``, an
array with one number per category, in category order. Scores stay in the row
of their article, so labelling is a projection and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwire.dims import FALLBACK_LABEL
from beatwire.functions.labels import active_labels
from beatwire.functions.text import at_least, words
from beatwire.operators.select import settled

Scorer = Callable[[DataFrame, str], DataFrame]


def lexicon_scorer(vocab: Mapping[str, Sequence[str]], hits_for_one: int = 3) -> Scorer:
    """Score = distinct vocabulary words in the text / ``hits_for_one``, at most 1.

    The text is cut down to the words of any vocabulary once; the categories
    are scored on what is left, a few dozen words at most.
    """
    lowered = {label: sorted({w.lower() for w in ws}) for label, ws in vocab.items()}
    every = sorted({w for ws in lowered.values() for w in ws})

    def known(ws: Sequence[str]) -> Column:
        return F.array(*[F.lit(w) for w in ws]).cast("array<string>")

    def score(df: DataFrame, text_col: str) -> DataFrame:
        text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
        hits = F.array_intersect(words(text), known(every))
        per_label = [
            F.least(F.lit(1.0), F.size(F.array_intersect(F.col("_hits"), known(ws)))
                    / F.lit(float(hits_for_one)))
            for ws in lowered.values()]
        return (df.withColumn("_hits", hits)
                .withColumn("scores", F.array(*per_label)).drop("_hits"))

    return score


# Models of this worker process, by name.
_MODELS: dict[str, Callable] = {}


def model_scorer(name: str, load: Callable[[], Callable[[list[str], list[str]], np.ndarray]],
                 phrases: Sequence[str]) -> Scorer:
    """A scorer around any model of text against label phrases.

    ``load`` runs once per Python worker process and name; it returns a function
    from a list of texts and the phrases to a matrix with one row per text and
    one column per phrase. If a batch fails its texts are tried one by one, and
    a text that fails alone gets no scores.
    """
    phrases = list(phrases)

    def rows(model: Callable, texts: list[str]) -> list:
        try:
            return list(np.asarray(model(texts, phrases), dtype="float64").reshape(len(texts), -1))
        except Exception:  # whatever the model raises, the other texts are scored
            return [None] if len(texts) == 1 else [r for t in texts for r in rows(model, [t])]

    @F.pandas_udf("array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _MODELS:
            _MODELS[name] = load()
        for texts in batches:
            yield pd.Series(rows(_MODELS[name], texts.fillna("").tolist()), dtype=object)

    return lambda df, text_col: df.withColumn("scores", predict(F.col(text_col)))


def scores_long(scored: DataFrame, key: str, categories: Sequence[str]) -> DataFrame:
    """One row per article and category: key, label, score."""
    labels = F.array(*[F.lit(c) for c in categories])
    return scored.select(key, F.inline(F.arrays_zip(
        labels.alias("label"), F.col("scores").alias("score"))).alias("label", "score"))


def threshold_labels(scored: DataFrame, categories: Sequence[str], text_col: str,
                     threshold: float = 0.4, min_len: int = 10) -> DataFrame:
    """Flags from scores: 1 above the threshold, fallback 1 when no crime is set.

    A text shorter than ``min_len``, or one the scorer gave no scores for,
    keeps all flags at 0, the fallback's too.
    """
    scored = scored.withColumn("_usable", F.coalesce(
        at_least(F.col(text_col), min_len) & F.col("scores").isNotNull(),
        F.lit(False)))
    usable = F.col("_usable")
    raw = {c: F.coalesce(F.get("scores", F.lit(i)) > threshold, F.lit(False))
           for i, c in enumerate(categories)}
    flags = {c: (usable & raw[c]).cast("int") for c in categories}
    if FALLBACK_LABEL in raw:
        crime = F.lit(False)
        for c in categories:
            if c != FALLBACK_LABEL:
                crime = crime | raw[c]
        flags[FALLBACK_LABEL] = (usable & (raw[FALLBACK_LABEL] | ~crime)).cast("int")
    return settled(scored, flags).drop("_usable")


def classify(df: DataFrame, scorer: Scorer, categories: Sequence[str],
             text_col: str = "clean_text", threshold: float = 0.4,
             min_len: int = 10) -> DataFrame:
    """Score, threshold, fall back."""
    scored = scorer(df, text_col)
    return threshold_labels(scored, categories, text_col, threshold, min_len).drop("scores")


def predict_labels(df: DataFrame, scorer: Scorer, categories: Sequence[str],
                   text_col: str = "clean_text", threshold: float = 0.4) -> DataFrame:
    """Names of the predicted labels of each row."""
    return classify(df, scorer, categories, text_col, threshold).withColumn(
        "labels", active_labels(categories))
