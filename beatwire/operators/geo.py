"""Places named in text, and their coordinates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwire.dims import Place
from beatwire.functions.text import PLAIN

WORD = r"[\p{L}\p{N}_]"


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _edge(char: str, before: bool, mode: str) -> str:
    """Boundary beside the first or last character of a name.

    "parity": combining vowel signs are no word characters, so a name that
    ends in one is found only with a letter glued on. "unicode": they are,
    which is what a reader expects.
    """
    if mode == "unicode":
        return r"\b"
    if mode != "parity":
        raise ValueError(f"unknown mode {mode!r}")
    look = "?<" if before else "?"
    return f"({look}!{WORD})" if _is_word(char) else f"({look}={WORD})"


def _quoted(text: str) -> str:
    return re.sub(r"([.\\+*?\[\]^$(){}|-])", r"\\\1", text)


def _name_pattern(places: Sequence[Place], mode: str) -> str:
    """A look-ahead with every name in it, grouped by first character.

    Being a look-ahead it consumes no letter of a name, so names that overlap are
    all found, each at its own position; of two names at one position the longer
    is tried first. The character in front of a name is consumed, so the text is
    to begin with a blank.
    """
    groups: dict[str, list[str]] = {}
    for p in sorted(places, key=lambda p: -len(p.name)):
        rest = _quoted(p.name[1:]) + _edge(p.name[-1], False, mode)
        groups.setdefault(p.name[0], []).append(rest)
    # Names begin with letters, so one left boundary serves all of them.
    left = {_edge(c, True, mode) for c in groups}
    if len(left) != 1:
        raise ValueError("place names must all begin with a word character")
    # In front of a letter that begins a name is none of these, which one bit tells.
    before = f"[^{PLAIN}]" if all(c.isalpha() for c in groups) else ""
    names = "|".join(f"{_quoted(c)}(?:{'|'.join(rests)})" for c, rests in groups.items())
    return f"{'(?U)' if mode == 'unicode' else ''}{before}{left.pop()}(?=({names}))"


def place_of(c: Column, places: Sequence[Place], mode: str = "parity") -> Column:
    """The longest place name that stands in the text as a word; ties by rank.

    A struct of location, lat and lon, null when there is none. A projection:
    one search per text, no join. Meant for a gazetteer that is a constant of
    the program, of up to a few thousand names.
    """
    # In this order the first of the names found is the answer.
    ordered = sorted(places, key=lambda p: (-len(p.name), p.rank))
    names = F.array(*[F.lit(p.name) for p in ordered])
    values = F.array(*[F.struct(F.lit(p.name).alias("location"), F.lit(p.lat).alias("lat"),
                                F.lit(p.lon).alias("lon")) for p in ordered])
    text = F.concat(F.lit(" "), F.lower(c))
    found = F.regexp_extract_all(text, F.lit(_name_pattern(places, mode)), F.lit(1))
    first = F.array_min(F.transform(
        F.array_distinct(found), lambda n: F.array_position(names, n).cast("int")))
    return F.try_element_at(values, first)


def extract_location(c: Column, places: Sequence[Place], mode: str = "parity") -> Column:
    """Name of the place of :func:`place_of`."""
    return place_of(c, places, mode)["location"]


def geocode_lookup(df: DataFrame, gazetteer: DataFrame, col: str = "location") -> DataFrame:
    """Add ``lat`` and ``lon`` of a place name in any case; null when unknown."""
    dim = gazetteer.select(F.col("name").alias("_name"), "lat", "lon")
    return df.join(dim, F.lower(F.col(col)) == F.col("_name"), "left").drop("_name")


def geocode_articles(df: DataFrame, places: Sequence[Place],
                     mode: str = "parity") -> DataFrame:
    """Place of an article: named in the title, else in the text, both as they came.

    The three columns come out of a generator, so that a later filter on one
    of them does not make Spark search the text again.
    """
    place = F.coalesce(place_of(F.col("title"), places, mode),
                       place_of(F.col("text"), places, mode))
    return df.drop("location", "lat", "lon").select("*", F.inline(F.array(place)))
