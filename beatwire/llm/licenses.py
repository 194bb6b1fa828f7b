"""Fuzzy search for licence notices, exact search for short phrases.

Texts are reduced to lower-case words joined by one space. A notice may differ
by k edits: it is cut into k + 1 pieces, one of which must then occur exactly.
One automaton finds all pieces of all notices in a single pass; the regex
library's bounded-error matching verifies the surroundings of every hit and
reports span and number of edits. Short phrases have to stand word for word.

Defined cases: null and empty texts have no words and no hits; texts are read
whole; overlapping places of a phrase all count; rows are handled one by one,
so repeated rows and null ids each get their row; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_AN_EDIT = 15  # one edit is allowed for so many characters of a notice

# Phrases that must stand word for word, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Openings of common notices, as words, with their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under a creative commons attribution license": "cc-by",
    "licensed under creative commons attribution sharealike": "cc-by-sa",
    "all rights reserved": "reserved",
    "released under the mit license": "mit",
    "this work is dedicated to the public domain": "public-domain",
}

# Words: ASCII digits and letters, lower-cased, and everything beyond ASCII.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A
              else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
              for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


@dataclass(frozen=True)
class Notice:
    text: str
    label: str

    @property
    def edits(self) -> int:
        return len(self.text) // CHARS_AN_EDIT

    @cached_property
    def pattern(self) -> regex.Pattern:
        return regex.compile(f"(?:{regex.escape(self.text, special_only=True)}){{e<={self.edits}}}",
                             regex.BESTMATCH)

    def best(self, text: str, start: int, end: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best place in a stretch."""
        m = self.pattern.search(text, start, end) if start < end else None
        return (sum(m.fuzzy_counts), m.start(), m.end()) if m and m.end() > m.start() else None

    def places(self, text: str, windows: Iterable[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Places in the windows that do not overlap, those of fewest edits first.

        A window is little longer than the notice. One whose best place overlaps
        an accepted one is searched again in what that leaves of it, which is
        shorter; so the work grows with the number of windows.
        """
        heap = [(*hit, start, end) for start, end in windows if (hit := self.best(text, start, end))]
        heapq.heapify(heap)
        taken: list[tuple[int, int, int]] = []  # start, end, edits; in order
        while heap:
            edits, at, until, start, end = heapq.heappop(heap)
            i = bisect.bisect_right(taken, (at,))
            over = [t for t in taken[max(0, i - 1):i + 1] if t[0] < until and at < t[1]]
            if not over:
                bisect.insort(taken, (at, until, edits))
                continue
            for left, right in ((start, min(end, over[0][0])), (max(start, over[-1][1]), end)):
                hit = self.best(text, left, right)
                if hit:
                    heapq.heappush(heap, (*hit, left, right))
        return taken

    def seeds(self) -> list[tuple[int, str]]:
        """edits + 1 pieces with their place in the notice."""
        n, parts = len(self.text), self.edits + 1
        cuts = [n * i // parts for i in range(parts + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """All notices and phrases, ready to search one text after another."""

    def __init__(self, notices: dict[str, str], phrases: dict[str, str]):
        self.notices = [Notice(t, label) for t, label in notices.items()]
        self.phrases = {f" {p} ": label for p, label in phrases.items()}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(self.notices):
            for at, piece in notice.seeds():
                pieces.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def windows(self, text: str) -> dict[int, set[tuple[int, int]]]:
        """Stretches that can hold a notice, one for each place a piece points to."""
        found: dict[int, set[tuple[int, int]]] = {}
        if self.empty:
            return found
        for last, (size, owners) in self.automaton.iter(text):
            for k, at in owners:
                notice = self.notices[k]
                start = last + 1 - size - at - notice.edits
                end = start + len(notice.text) + 2 * notice.edits
                found.setdefault(k, set()).add((max(0, start), min(end, len(text))))
        return found

    def fuzzy(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, length of the notice) of every verified place."""
        hits = []
        for k, spans in self.windows(text).items():
            notice = self.notices[k]
            hits += [(start, end, notice.label, edits, len(notice.text))
                     for start, end, edits in notice.places(text, spans)]
        return sorted(hits)

    def exact(self, text: str) -> list[tuple[int, str, int]]:
        """(first word, label, words) of every place of a phrase, overlaps included."""
        padded, hits = f" {text} ", []
        for phrase, label in self.phrases.items():
            at = padded.find(phrase)
            while at >= 0:
                hits.append((at, label, phrase.count(" ") - 1))
                at = padded.find(phrase, at + 1)
        hits.sort()
        words = _word_numbers(padded, [at for at, _, _ in hits])
        return [(w, label, n) for w, (_, label, n) in zip(words, hits)]


_LOADED: dict[tuple, Scanner] = {}


def loaded(notices: dict[str, str], phrases: dict[str, str]) -> Scanner:
    """One scanner for each set of notices and phrases in a worker process."""
    key = (tuple(notices.items()), tuple(phrases.items()))
    if key not in _LOADED:
        _LOADED[key] = Scanner(notices, phrases)
    return _LOADED[key]


def _word_numbers(padded: str, places: Sequence[int]) -> list[int]:
    """Which word starts after each place; ascending places, one pass over the text."""
    out, seen, before = [], 0, 0
    for at in places:
        seen += padded.count(" ", before, at)
        before = at
        out.append(seen)
    return out


HITS = ("n_words long, phrases array<struct<label:string,first_word:long,n_words:int>>, "
        "notices array<struct<label:string,first_word:long,span:string,edits:int,score:double>>")


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  notices: dict[str, str] = NOTICES,
                  phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, n_words, phrases, notices): words, exact phrases, fuzzy notices of a text.

    Spans are words of the normalised text; ``first_word`` counts from 0 and is
    the word in which the span begins.
    """
    def scan(scanner: Scanner, content: str | None) -> tuple:
        words = words_of(content)
        joined = b" ".join(words).decode("utf-8", "surrogatepass")
        fuzzy = scanner.fuzzy(joined)
        starts = _word_numbers(joined, [start for start, *_ in fuzzy])
        return (len(words),
                [{"label": label, "first_word": w, "n_words": n}
                 for w, label, n in scanner.exact(joined)],
                [{"label": label, "first_word": w, "span": joined[start:end], "edits": edits,
                  "score": 1 - edits / size}
                 for w, (start, end, label, edits, size) in zip(starts, fuzzy)])

    @F.pandas_udf(HITS)
    def search(texts: pd.Series) -> pd.DataFrame:
        scanner = loaded(notices, phrases)
        return pd.DataFrame([scan(scanner, t) for t in texts],
                            columns=["n_words", "phrases", "notices"])

    return (docs.select(F.col(doc_id).alias("doc_id"), search(F.col(text)).alias("h"))
            .select("doc_id", "h.*"))


def license_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One line a document: base places, labels and the score of the best hit."""
    labels = F.transform("phrases", lambda p: p["label"])
    more = F.transform("notices", lambda p: p["label"])
    starts = F.transform("phrases", lambda p: p["first_word"])
    score = F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(
        F.array_max(F.transform("notices", lambda p: p["score"])), F.lit(0.0)))
    listed = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return scan_licenses(docs, doc_id, text).select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(labels).alias("base_labels"), listed(F.concat(labels, more)).alias("labels"),
        score.alias("score"))
