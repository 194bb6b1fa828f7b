"""Searches of long texts: what they skip, and that they find the same by their definitions."""

import re

from pyspark.sql import functions as F

from beatwire.dims import TAX11, gazetteer, phrase_vocab
from beatwire.functions.text import (
    SCRIPT_RANGES, TAG_PATTERN, URL_PATTERN, at_least, clean_text, collapse, detect_language, words,
)
from beatwire.operators.classify import lexicon_scorer
from beatwire.operators.geo import extract_location
from beatwire.plans.batch import clean_articles, label_articles

SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + (
    "\u2028\u2029\u202f\u205f\u3000")
TEXTS = ["", " ", "a", "\u2003a\u00a0\n b  c\t", "one  two \x1c\x1f three", "no\u200bspace \ufeffhere", "x\u3000\u3000y ",
         "\U0001d400b \U0001f600 c", "É <b>http www</b> <www x> < http://a>b> c", "a<\n>b", "htt p ww w <", *SPACE,
         "ಕ ನ\u0ccd ನ-ಡ हि  ಾ", "abc" + " " * 50_000 + "d", "word" * 20_000, "\n" * 50_000 + "end"]


def _python(pattern):
    """A pattern of Java in the notation of Python."""
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: "\\u" + m.group(1).zfill(4), pattern)


def test_words_and_runs(value):
    assert value(words, *TEXTS) == [re.split(f"[{SPACE}]+", t) for t in TEXTS]
    assert value(collapse, *TEXTS) == [re.sub(f"[{SPACE}]+", " ", t).strip(" ") for t in TEXTS]


def test_clean_text_by_its_definition(value):
    def clean(text, ranges):
        for pattern in (_python(URL_PATTERN), _python(TAG_PATTERN), _python(f"[^a-z0-9{SPACE}{ranges}]")):
            text = re.sub(pattern, "", text.lower() if "http" in pattern else text)
        return re.sub(f"[{SPACE}]+", " ", text).strip(" ")

    kept = SCRIPT_RANGES["devanagari"] + SCRIPT_RANGES["kannada"]
    assert value(clean_text, *TEXTS) == [clean(t, kept) for t in TEXTS]


def test_length_between_white_space(value):
    for n in (1, 2, 3, 10):
        assert value(lambda c: at_least(c, n), *TEXTS) == [len(t.strip(SPACE)) >= n for t in TEXTS]
    assert value(lambda c: at_least(c, 0), "", " ", None) == [True, True, False]


def test_every_script_wins_by_its_letters(value):
    names = {"devanagari": "hi", "bengali": "bn", "gurmukhi": "pa", "gujarati": "gu", "tamil": "ta",
             "telugu": "te", "kannada": "kn", "malayalam": "ml"}
    first = {s: chr(int(r[3:7], 16) + 0x15) for s, r in SCRIPT_RANGES.items()}
    for script, lang in names.items():
        other = first["kannada" if script != "kannada" else "tamil"]
        assert value(detect_language, f"ab  {first[script] * 5} {other * 2} b.\u2003 c", f"abcd {first[script] * 3} b c d",
                     f" {first[script]} b\n c d ", f"Z {first[script]} Z É 1") == [lang, "en", "en", lang]
    assert value(detect_language, "ನ " * 20_000) == ["kn"]


def test_names_at_the_edges_of_a_text(value):
    for mode in ("parity", "unicode"):
        assert value(lambda c: extract_location(c, gazetteer(), mode), "delhi", "Delhi.", "xdelhi", "édelhi", "_delhi",
                     "9delhi", "é delhi", "delhi delhi-mumbai", "navi navi mumbai") == [
            "delhi", "delhi", None, None, None, None, "delhi", "mumbai", "navi mumbai"]


def test_no_letter_of_a_text_becomes_a_value(spark):
    """Letters are counted without a list of them, and ends are not searched for all along a text."""
    df = spark.createDataFrame([("t", "x", "2024-01-01", "u", "s")], "title string, text string, date string, "
                               "url string, source string")
    labelled = label_articles(clean_articles(df), TAX11, lexicon_scorer(phrase_vocab()))
    plan = labelled._jdf.queryExecution().optimizedPlan().toString()
    assert "[a-z], 0)" not in plan and "]+$" not in plan
    detected = df.select(detect_language(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in detected
