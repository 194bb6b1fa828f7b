"""Text expressions: cleaning, keywords, language. Column in, Column out.

Patterns are written in the common subset of Java regular expressions and RE2
and name Unicode white space explicitly, because ``\\s`` is ASCII in both.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Body of a character class: every character Unicode counts as white space,
# and the four ASCII separators 1C-1F.
WS = (r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")

# Java tests a class of ranges range by range, but a class of single characters
# by one bit. A search for any other character than those, whose class is asked for
# behind it, is several times faster in mostly plain text and changes no match.
PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789"
LETTERS = PLAIN + PLAIN[:26].upper()
WS_BUT_SPACE = WS.replace(r"\x{1c}-\x{20}", r"\x{1c}-\x{1f}")
OTHER_SPACE = rf"[^{LETTERS} ](?<=[{WS_BUT_SPACE}])"

URL_PATTERN = rf"(http|www)[^{WS}]+"
TAG_PATTERN = r"<[^>\n]*>"

# Every match of a pattern holds one of its signs.
URL_SIGNS = ("http", "www")
TAG_SIGNS = ("<",)

# Unicode blocks of the scripts; "parity" keeps only the first and the sixth.
SCRIPT_RANGES = {
    "devanagari": r"\x{0900}-\x{097F}",
    "bengali": r"\x{0980}-\x{09FF}",
    "gurmukhi": r"\x{0A00}-\x{0A7F}",
    "gujarati": r"\x{0A80}-\x{0AFF}",
    "tamil": r"\x{0B80}-\x{0BFF}",
    "telugu": r"\x{0C00}-\x{0C7F}",
    "kannada": r"\x{0C80}-\x{0CFF}",
    "malayalam": r"\x{0D00}-\x{0D7F}",
}
PARITY_SCRIPTS = ("devanagari", "kannada")
INDIC = r"\x{0900}-\x{0D7F}"

SCRIPT_LANG = {
    "bengali": "bn", "gurmukhi": "pa", "gujarati": "gu", "tamil": "ta",
    "telugu": "te", "kannada": "kn", "malayalam": "ml",
}

# Function words that tell Marathi from Hindi; both are written in Devanagari.
MARATHI_WORDS = ["आहे", "आणि", "नाही", "आहेत", "होते", "झाला", "झाली", "केली", "मध्ये", "या"]
HINDI_WORDS = ["है", "और", "नहीं", "हैं", "में", "की", "के", "का", "से", "को"]


def _kept(scripts: Sequence[str]) -> str:
    return f"a-z0-9{WS}{''.join(SCRIPT_RANGES[s] for s in scripts)}"


def non_word_filter(scripts: Sequence[str] = PARITY_SCRIPTS) -> str:
    return f"[^{_kept(scripts)}]"


def bind(c: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(c)`` with ``c`` computed once, however often ``fn`` mentions it.

    The optimizer copies an expression into every place that uses it when a
    filter moves below the projection; a lambda variable stays one value.
    """
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def _replaced(c: Column, pattern: str, by: str, signs: Sequence[str]) -> Column:
    """Replace a pattern in texts that hold one of its signs; others are not searched."""
    return bind(c, lambda t: F.when(
        reduce(or_, [F.contains(t, F.lit(s)) for s in signs]),
        F.regexp_replace(t, pattern, by)).otherwise(t))


def single_spaced(c: Column) -> Column:
    """Runs of white space become one space."""
    return _replaced(F.regexp_replace(c, OTHER_SPACE, " "), " {2,}", " ", ["  "])


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at either end."""
    return F.trim(single_spaced(c))


def strip_space(c: Column) -> Column:
    """Remove white space, in the Unicode sense, at both ends."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def at_least(c: Column, n: int) -> Column:
    """Whether ``n`` characters or more are left without the white space at both ends.

    The search ends at the first character that is far enough from the first one.
    """
    if n < 1:
        return c.isNotNull()
    far = "" if n == 1 else rf".{{{n - 2},}}?[^{WS}]"
    return F.rlike(c, F.lit(rf"(?s)\A[{WS}]*+[^{WS}]{far}"))


def words(c: Column) -> Column:
    """White-space separated words; may hold an empty first or last element."""
    return F.split(single_spaced(c), " ")


def clean_text(c: Column, scripts: Sequence[str] = PARITY_SCRIPTS) -> Column:
    """Lower-case, drop links, tags and symbols, collapse white space.

    ``scripts`` are the scripts kept beside ASCII letters and digits. With the
    default a text in any other script becomes empty.
    """
    c = F.lower(F.coalesce(c, F.lit("")))
    c = _replaced(c, URL_PATTERN, "", URL_SIGNS)
    c = _replaced(c, TAG_PATTERN, "", TAG_SIGNS)
    c = F.regexp_replace(c, f"[^{PLAIN} ](?<![{_kept(scripts)}])", "")
    return collapse(c)


# Fixed value: characters that are no part of a keyword.
KEYWORD_STRIP = r"""[.,!?"'()\[\]{}:;—-]"""


def extract_keywords(c: Column, limit: int | None = 10) -> Column:
    """Distinct words of three or more characters, in order of first use.

    Case is kept: ``Delhi`` and ``delhi`` are two keywords.
    """
    stripped = F.regexp_replace(F.coalesce(c, F.lit("")), KEYWORD_STRIP, "")
    kws = F.array_distinct(F.filter(words(stripped), lambda w: F.length(w) > 2))
    return kws if limit is None else F.slice(kws, 1, limit)


def match_count(keywords: Column, text: Column, title: Column) -> Column:
    """How many keywords occur, as a substring in any case, in text or title."""
    text = F.lower(F.coalesce(text, F.lit("")))
    title = F.lower(F.coalesce(title, F.lit("")))
    return F.size(F.filter(
        keywords,
        lambda k: F.contains(text, F.lower(k)) | F.contains(title, F.lower(k))))


def _count_of(text: Column, chars: str) -> Column:
    """How many characters of a class there are, without a list of them."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _by_script(text: Column, indic: Column) -> Column:
    """Language by the commonest script of a text whose Indian characters are ``indic``."""
    # The largest count wins; the order of the list decides between equals.
    letters = F.array(*[
        F.struct(_count_of(indic, r).alias("n"), F.lit(-i).alias("order"), F.lit(s).alias("script"))
        for i, (s, r) in enumerate(SCRIPT_RANGES.items())])
    lang = F.create_map(*[F.lit(v) for kv in SCRIPT_LANG.items() for v in kv])
    hindi_or_marathi = bind(words(text), lambda ws: F.when(
        F.size(F.filter(ws, lambda w: w.isin(MARATHI_WORDS)))
        > F.size(F.filter(ws, lambda w: w.isin(HINDI_WORDS))), "mr").otherwise("hi"))
    return bind(F.array_max(letters), lambda top: F.when(
        (top["n"] == 0) | (_count_of(text, "a-z") > top["n"]), "en").when(
        top["script"] == "devanagari", hindi_or_marathi).otherwise(
        F.try_element_at(lang, top["script"])))


def _language_of(text: Column) -> Column:
    indic = F.rlike(text, F.lit(f"[{INDIC}]"))
    five_words = F.rlike(text, F.lit(rf"\A[{WS}]*+(?:[^{WS}]++[{WS}]++){{4}}[^{WS}]"))
    by_script = bind(F.regexp_replace(text, f"[^{INDIC}]+", ""), lambda found: _by_script(text, found))
    return F.when(~indic, "en").when(~five_words, "en").otherwise(by_script)


def detect_language(c: Column) -> Column:
    """Language from the dominant script; Marathi and Hindi by function words.

    Fewer than five words, or no letter of a known Indian script, means ``en``.
    A text without any Indian character is settled by one search.
    """
    return bind(F.coalesce(c, F.lit("")), _language_of)


def title_case(c: Column) -> Column:
    """Capitalise every run of letters, also after a hyphen or underscore."""
    runs = F.split(c, r"(?<=[^\p{L}])")
    return F.array_join(
        F.transform(runs, lambda w: F.concat(
            F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")
