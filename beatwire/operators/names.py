"""Names from a large table found in text: the place search for millions of names.

:mod:`beatwire.operators.geo` looks for a constant gazetteer with one pattern.
Here names are rows. A text is cut into words, each with the signs behind it;
every run of as many words as some name has is a candidate, and a join on equal
text tells which candidates are names. Runs overlap, so overlapping names are all
found; the longest wins. The definition of a name's borders is that of
:func:`beatwire.operators.geo.place_of`, and on the same names both agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwire.functions.text import bind
from beatwire.session import written

# Characters of a word: "parity" leaves combining vowel signs out, "unicode" has them.
WORD_CHARS = {"parity": r"\p{L}\p{N}_", "unicode": r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}"}
BROADCAST_NAMES = 200_000  # names that are broadcast; beyond, the join shuffles candidates


def _classes(mode: str) -> tuple[str, str]:
    if mode not in WORD_CHARS:
        raise ValueError(f"unknown mode {mode!r}")
    return f"[{WORD_CHARS[mode]}]+", f"[^{WORD_CHARS[mode]}]*"


def word_parts(c: Column, mode: str = "parity") -> Column:
    """Words of a text in lower case, each with what stands between it and the next."""
    word, between = _classes(mode)
    return F.regexp_extract_all(F.lower(c), F.lit(f"({word}{between})"), F.lit(1))


def listed_names(names: DataFrame, mode: str = "parity") -> DataFrame:
    """Names (name, rank, ...) with their lower-case form, its number of words and its end.

    Of names with one lower-case form the one of the least rank stays. A name
    that ends in a sign, no word character, is ``open``: it needs a word right
    behind it. Names that do not begin with a word character are left out.
    """
    word, _ = _classes(mode)
    form = F.lower("name")
    best = (names.where(F.col("name").isNotNull()).withColumn("_form", form)
            .groupBy("_form").agg(F.min_by(F.struct(*names.columns), "rank").alias("_row")))
    parts = F.size(word_parts(F.col("_form"), mode))
    return (best.where(F.col("_form").rlike(f"^{word}"))
            .select("_form", parts.alias("_words"), (~F.col("_form").rlike(f"{word}$")).alias("_open"),
                    F.length("_form").alias("_length"), "_row.*"))


def candidates(c: Column, sizes: list[tuple[int, bool, str]], mode: str = "parity") -> Column:
    """Distinct runs of words of a text, for each number of words and kind of end.

    ``sizes`` also has the first characters of the names of a kind; runs that begin
    with another are left out at once.
    """
    word, _ = _classes(mode)

    def run_of(parts: Column, alone: Column, n: int, is_open: bool):
        def run(i: Column) -> Column:
            if is_open:
                return F.array_join(F.slice(parts, i, F.lit(n)), "")
            return F.concat(F.array_join(F.slice(parts, i, F.lit(n - 1)), ""), F.get(alone, i + (n - 2)))

        return run

    def runs(parts: Column, alone: Column) -> Column:
        lists = []
        for n, is_open, firsts in sizes:
            def begins(w: Column, firsts: str = firsts) -> Column:
                return F.contains(F.lit(firsts), F.left(w, F.lit(1)))

            if n == 1 and not is_open:
                lists.append(F.filter(alone, lambda w: begins(w)))
                continue
            last = F.size(parts) - n + (0 if is_open else 1)  # an open name has a word behind it
            starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(
                F.expr("cast(array() as array<int>)"))
            starts = F.filter(starts, lambda i: begins(F.get(alone, i - 1)))
            lists.append(F.transform(starts, run_of(parts, alone, n, is_open)))
        return F.array_distinct(F.concat(*lists))

    def with_words(parts: Column) -> Column:
        alone = F.transform(parts, lambda p: F.regexp_extract(p, f"^{word}", 0))
        return bind(alone, lambda words: runs(parts, words))

    return bind(word_parts(c, mode), with_words)


def find_names(rows: DataFrame, key: str, cols: list[str], names: DataFrame,
               mode: str = "parity") -> DataFrame:
    """``rows`` plus the columns of the longest name in the first column that has one.

    ``names`` has name and rank (which settles equal lengths) and any other
    columns; ``key`` tells the rows apart. Words are looked up through the
    distinct candidates of all texts, so what is shuffled for a frequent one does
    not grow with the texts that hold it.
    """
    kept = [c for c in names.columns if c != "rank"]
    known = written(listed_names(names, mode), "names")
    kinds = known.groupBy("_words", "_open").agg(  # characters of an alphabet, not names
        F.array_join(F.sort_array(F.collect_set(F.left("_form", F.lit(1)))), "").alias("firsts")).collect()
    sizes = [(r["_words"], r["_open"], r["firsts"]) for r in kinds]
    if not sizes:
        return rows.select("*", *[F.lit(None).cast(names.schema[c].dataType).alias(c) for c in kept])
    held = rows.select(F.col(key).alias("_key"), F.posexplode(F.array(*[
        candidates(F.col(c), sorted(sizes), mode) for c in cols])).alias("_col", "_runs"))
    held = held.select("_key", "_col", F.explode("_runs").alias("_form"))
    if known.count() <= BROADCAST_NAMES:
        found = held.join(F.broadcast(known), "_form")
    else:
        seen = written(held.select("_form").distinct().join(known, "_form"), "found-names")
        few = seen.count() <= BROADCAST_NAMES
        found = held.join(F.broadcast(seen) if few else seen, "_form")
    order = F.struct("_col", -F.col("_length"), "rank")
    best = (found.groupBy("_key").agg(F.min_by(F.struct(*kept), order).alias("_name")))
    matched = rows.join(best, F.col(key).eqNullSafe(F.col("_key")), "left")
    return matched.select(*[c for c in rows.columns if c not in kept], "_name.*")
