"""Language of a text by the letters it is made of.

A profile holds, for each language, how often every run of three characters
occurs in labelled texts; a text is given to the language under which its runs
are likeliest. Runs are counted through distinct words, each padded by a blank
on either side: texts are split into words once, and everything behind that works
on the vocabulary, not on the texts. The rule by script decides where no word of
a text has a known run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwire.functions.text import detect_language, words
from beatwire.session import written

SIZE = 3  # characters of a run
PAD = "_"
BROADCAST_WORDS = 200_000  # words with their likelihoods that are broadcast; beyond, the join shuffles


def runs(word: Column, size: int = SIZE) -> Column:
    """Runs of characters of a padded word, repeated ones as often as they occur."""
    padded = F.concat(F.lit(PAD), word, F.lit(PAD))
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (size - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substr(padded, i, F.lit(size)))


def _counted_words(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, word, n): added up in every task before the shuffle."""
    listed = F.filter(words(F.lower(F.col(text))), lambda w: w != "")
    return (rows.select(*keys, F.explode(listed).alias("word")).groupBy(*keys, "word")
            .agg(F.count(F.lit(1)).alias("n")))


def fit_profiles(rows: DataFrame, text: str = "text", lang: str = "lang",
                 size: int = SIZE) -> DataFrame:
    """(lang, gram, n): exact counts over all rows whose language is known, kept as a table."""
    counted = _counted_words(rows.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), text),
                             ["lang"], text)
    return written(counted.select("lang", "n", F.explode(runs(F.col("word"), size)).alias("gram"))
                   .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "profiles")


def _likelihoods(profiles: DataFrame, langs: list[str]) -> DataFrame:
    """(gram, logs): one number a language, with one added to every count."""
    sizes = {r.lang: r.total for r in profiles.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    distinct = profiles.agg(F.count_distinct("gram")).first()[0]

    def log(lang: str) -> Column:
        seen = F.coalesce(F.max(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0))
        return F.log((seen + 1.0) / F.lit(float(sizes[lang] + distinct)))

    return profiles.groupBy("gram").agg(F.array(*[log(x) for x in langs]).alias("logs"))


def identify(rows: DataFrame, profiles: DataFrame, key: str, text: str = "text",
             size: int = SIZE) -> DataFrame:
    """(key, lang, by_profile): the likeliest language of every row, ties to the first by name.

    There are as many numbers per run as languages, so their number should stay
    in the hundreds; words and runs may be as many as they like.
    """
    langs = sorted(r.lang for r in profiles.select("lang").distinct().collect())
    by_script = rows.select(F.col(key).alias("_key"), detect_language(F.col(text)).alias("script"))
    if not langs:
        return by_script.select(F.col("_key").alias(key), F.col("script").alias("lang"),
                                F.lit(False).alias("by_profile"))
    held = written(_counted_words(rows.select(F.col(key).alias("_key"), text), ["_key"], text), "text-words")
    grams = (held.select("word").distinct()
             .select("word", F.explode(runs(F.col("word"), size)).alias("gram"))
             .join(_likelihoods(profiles, langs), "gram"))
    per_word = written(grams.groupBy("word").agg(*[
        F.sum(F.get("logs", F.lit(i))).alias(f"l{i}") for i in range(len(langs))]), "word-logs")
    few = per_word.count() <= BROADCAST_WORDS
    sums = (held.join(F.broadcast(per_word) if few else per_word, "word").groupBy("_key").agg(*[
        F.sum(F.col(f"l{i}") * F.col("n")).alias(f"l{i}") for i in range(len(langs))]))
    best = F.array_max(F.array(*[F.struct(F.col(f"l{i}").alias("l"), F.lit(-i).alias("i"))
                                 for i in range(len(langs))]))
    named = F.element_at(F.array(*[F.lit(x) for x in langs]), 1 - best["i"])
    found = sums.select("_key", named.alias("_lang"))
    return (by_script.withColumnRenamed("_key", "_id")
            .join(found, F.col("_id").eqNullSafe(F.col("_key")), "left")
            .select(F.col("_id").alias(key), F.coalesce("_lang", "script").alias("lang"),
                    F.col("_lang").isNotNull().alias("by_profile")))
