import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from beatwire.operators import language
from beatwire.operators.language import fit_profiles, identify, runs

LABELLED = [("en", "the thing that they think"), ("en", "This and that"), ("de", "das ist die Zeit und der Tag"),
            ("de", None), (None, "nobody knows"), ("it", "che cosa è questo"), ("it", "questa è la casa")]


def grams(word):
    padded = f"_{word}_"
    return [padded[i:i + 3] for i in range(max(1, len(padded) - 2))]


def counts(rows):
    out = defaultdict(Counter)
    for lang, text in rows:
        if lang is not None:
            out[lang].update(g for w in (text or "").lower().split() for g in grams(w))
    return out


def brute(rows, texts):
    profile = counts(rows)
    known = {g for c in profile.values() for g in c}
    langs = sorted(x for x in profile if profile[x])
    out = []
    for text in texts:
        found = [g for w in (text or "").lower().split() for g in grams(w) if g in known]
        score = {x: sum(math.log((profile[x][g] + 1) / (sum(profile[x].values()) + len(known)))
                        for g in found) for x in langs}
        out.append(max(langs, key=lambda x: (round(score[x], 9), -langs.index(x))) if found else None)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def test_runs(value):
    assert value(lambda c: runs(c), "a", "ab", "aaaa", "") == [["_a_"], ["_ab", "ab_"],
                                                               ["_aa", "aaa", "aaa", "aa_"], ["__"]]


def test_counts_are_exact(spark):
    got = {(r.lang, r.gram): r.n for r in fit_profiles(frame(spark, LABELLED)).collect()}
    assert got == {(x, g): n for x, c in counts(LABELLED).items() for g, n in c.items()}


def test_identify_equals_brute_force(spark, monkeypatch):
    texts = ["the cat", "der Hund", "una casa", "è", "", None, "zzz qqq", "THE THING", "die", "x " * 500 + "the",
             "ದಿನ ದಿನ ದಿನ ದಿನ ದಿನ ದಿನ"]
    rows = spark.createDataFrame([*enumerate(texts), (None, "der")], "id int, text string").withColumn(
        "lang", F.lit("clash")).withColumn("word", F.lit("clash"))
    profiles = fit_profiles(frame(spark, LABELLED))
    want = dict(enumerate(brute(LABELLED, texts))) | {None: "de"}
    for few in (language.BROADCAST_WORDS, 0):
        monkeypatch.setattr(language, "BROADCAST_WORDS", few)
        got = {r.id: r for r in identify(rows, profiles, "id").collect()}
        assert len(got) == len(texts) + 1
        assert {i: r.lang if r.by_profile else None for i, r in got.items()} == want
        assert [got[i].lang for i in (4, 5, 6, 10)] == ["en", "en", "en", "kn"]  # by script


def test_without_a_profile_the_script_decides(spark):
    rows = spark.createDataFrame([(1, "das ist die Zeit")], "id int, text string")
    got = identify(rows, fit_profiles(frame(spark, LABELLED).limit(0)), "id").first()
    assert (got.id, got.lang, got.by_profile) == (1, "en", False)
