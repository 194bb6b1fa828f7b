import random
import re
import time
from pathlib import Path

import pytest
import regex

from beatwire.llm.catalog import QUERIES
from beatwire.llm.licenses import (NOTICES, PHRASES, Notice, Scanner, license_report,
                                   scan_licenses, words_of)

SCANNER = Scanner(NOTICES, PHRASES)
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    """n_words, starts and base labels by the plain definition."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words, hits = WORD.findall(low), []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), sorted(i for i, _ in hits), sorted({label for _, label in hits})


TEXTS = ["", None, "All rights reserved.", "CC-BY cc by, cc by", "allrights reserved",
         "the GNU General\nPublic License; all  rights reserved", "ccby", "cc by", "É cc by é",
         "all rights all rights reserved", "cc " * 30_000 + "by", "_cc_by_ x", "ccé by"]


@pytest.mark.parametrize("text", TEXTS)
def test_words_and_phrases(text):
    words = words_of(text)
    joined = b" ".join(words).decode()
    got = SCANNER.exact(joined)
    assert (len(words), [w for w, *_ in got], sorted({x for _, x, _ in got})) == brute(text)


def test_edited_notices_are_found():
    rnd = random.Random(4)
    for text, label in NOTICES.items():
        notice = Notice(text, label)
        for _ in range(30):
            edited = list(text)
            for _ in range(notice.edits):
                at = rnd.randrange(len(edited))
                edited[at:at + 1] = rnd.choice([[], ["q"], [edited[at], "z"]])
            hits = SCANNER.fuzzy("some words " + "".join(edited) + " and more")
            assert any(h[2] == label and h[3] <= notice.edits for h in hits), (text, edited)


@pytest.mark.parametrize("text,edits", [
    ("all right reserved all rights reserved", [1, 0]),
    ("all rights reserved all right reserved", [0, 1]),
    ("all right reserved all rights reservd all rights reserved al rights reserved", [1, 1, 0, 1])])
def test_adjacent_notices(text, edits):
    assert [k for _, _, label, k, _ in SCANNER.fuzzy(text) if label == "reserved"] == edits


def test_places_do_not_overlap_and_none_is_missed():
    rnd = random.Random(11)
    notice = Notice("all rights reserved", "reserved")
    only = Scanner({notice.text: notice.label}, {})
    for _ in range(200):
        parts = rnd.choices(["all rights reserved", "all right reserved", "al rights reserved", "x", "all rights",
                             "reserved", "allrights reserved"], k=8)
        text = " ".join(parts)
        hits = only.fuzzy(text)
        assert all(a[1] <= b[0] for a, b in zip(hits, hits[1:]))
        at = 0
        for start, end, *_ in [*hits, (len(text), len(text))]:  # nothing is left in the gaps
            assert notice.best(text, at, start) is None
            at = end


def test_a_text_of_near_notices_takes_linear_time():
    def seconds(n):
        start = time.process_time()
        hits = SCANNER.fuzzy("all right reserved x " * n)
        assert len([h for h in hits if h[2] == "reserved"]) == n
        return time.process_time() - start

    seconds(100)
    assert seconds(8_000) < 20 * max(seconds(800), 0.05)
    assert seconds(50_000) < 60  # 1 MB


def test_same_as_search_without_seeds():
    rnd = random.Random(9)
    for _ in range(60):
        parts = []
        for _ in range(6):
            text = list(rnd.choice(list(NOTICES)))
            for _ in range(rnd.randrange(7)):
                text[rnd.randrange(len(text))] = rnd.choice("abz ")
            parts.append("".join(text))
        joined = " ".join(" filler ".join(parts).split())
        seen = {(label, k) for _, _, label, _, k in SCANNER.fuzzy(joined)}
        for text, label in NOTICES.items():
            plain = regex.search(Notice(text, label).pattern, joined) is not None
            assert plain == ((label, len(text)) in seen)


def test_report_cases(docs_of):
    docs = docs_of(*enumerate(TEXTS), (None, "cc by"), (2, TEXTS[2]),
                   (50, "Licenced under the Apache Licens, Version 2.0"),
                   extra="labels n_words phrases h")
    rows = license_report(docs).collect()
    assert len(rows) == len(TEXTS) + 3
    got = {r.doc_id: r for r in rows}
    for i, text in enumerate(TEXTS):
        n, starts, labels = brute(text)
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(starts), ",".join(labels))
        assert (r.first_word, r.last_word) == ((starts[0], starts[-1]) if starts else (None, None))
    assert got[50].labels == "apache-2.0" and 0.9 < got[50].score < 1 and got[50].n_base == 0
    assert got[0].score == 0 and got[0].labels == ""
    assert license_report(docs.limit(0)).collect() == []


def test_spans(docs_of):
    r = scan_licenses(docs_of((1, "x y. Licensed under the Apache License, Version 2.0!"))).first()
    assert [(h.label, h.first_word, h.edits) for h in r.notices] == [("apache-2.0", 2, 0)]
    assert r.notices[0].span == "licensed under the apache license version 2 0"


def test_query_against_the_definition(spark):
    tables = Path("/root/testdata/sf0.001")
    if not tables.exists():
        pytest.skip("no test tables")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    rows = QUERIES["op10_licenses"](spark, str(tables)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, starts, labels = brute(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(starts), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
