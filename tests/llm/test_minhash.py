import random
import re
from pathlib import Path

import numpy as np
import pytest

from beatwire.llm import minhash
from beatwire.llm.catalog import QUERIES
from beatwire.llm.components import connected_components
from beatwire.llm.minhash import drop_near_duplicates, near_duplicates, shingle_set


def brute_sets(rows):
    out = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5
                   else {tuple(w)} if w else set())
    return out


def brute(rows):
    """Sets and components by comparing every pair that shares a shingle."""
    sets = brute_sets(rows)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = {(i, j) for members in where.values() for j in members for i in members if i < j}
    for i, j in pairs:
        common = len(sets[i] & sets[j])
        if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    names = {}
    for i, (key, _) in enumerate(rows):
        names[root(i)] = min(names.get(root(i), key), key)
    return [(key, len(sets[i]), names[root(i)]) for i, (key, _) in enumerate(rows)]


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def near_rows(seed, groups=12, size=14):
    """Chains and stars of edited texts, and texts that share one long passage."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(10**6)}"
    rows = []
    for g in range(groups):
        text = [word() for _ in range(rnd.choice([8, 30, 60, 150]))]
        for _ in range(size):
            base = rnd.choice(rows[-3:])[1].split() if rows and rnd.random() < .3 else text
            edited = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                edited[rnd.randrange(len(edited))] = word()
            rows.append((rnd.randrange(10**9), " ".join(edited)))
    passage = [word() for _ in range(40)]
    rows += [(rnd.randrange(10**9), " ".join(passage + [word() for _ in range(rnd.randrange(4, 25))]))
             for _ in range(40)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(docs_of, seed):
    rows = near_rows(seed)
    assert result(near_duplicates(docs_of(*rows))) == sorted(brute(rows))


def test_links_that_no_hub_shows(docs_of):
    """Members of a bucket that are like each other and not like its smallest member."""
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(10**6)}"
    base = [word() for _ in range(60)]
    rows = [(1, " ".join(base))]
    for g in range(30):
        other = base[:48] + [word() for _ in range(12)]  # 44 of 68 shingles in common
        rows.append((10 + 10 * g, " ".join(other)))
        other[rnd.randrange(50, 60)] = word()
        rows.append((11 + 10 * g, " ".join(other)))
    assert result(near_duplicates(docs_of(*rows))) == sorted(brute(rows))


def test_blocks_change_nothing(docs_of, monkeypatch):
    """Every component compared in blocks of a few sets."""
    monkeypatch.setattr(minhash, "FEW", 0)
    monkeypatch.setattr(minhash, "BLOCK", 200)
    rows = near_rows(3, groups=4)
    assert result(near_duplicates(docs_of(*rows))) == sorted(brute(rows))


def test_cases(docs_of):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "One two"), (9, "one TWO"), (10, "one two three"),
            (11, "a b c d e"), (12, "A B C D E"), (13, "É b c d e"), (14, "é b c d e"),
            (15, "x " * 100_000), (16, "x x x x x x")]
    docs = docs_of(*rows, (12, "A B C D E"), (None, "a b c d e"), extra="same sig keys rep n")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept)
                 for r in near_duplicates(docs).collect())
    assert got == [(-1, None, True), (5, 5, True), (6, 6, True), (7, 7, True), (8, 8, True),
                   (9, 8, False), (10, 10, True), (11, 11, True), (12, 11, False),
                   (12, 11, False), (13, 13, True), (14, 14, True), (15, 15, True),
                   (16, 15, False)]
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 10


def test_empty_table(docs_of):
    assert near_duplicates(docs_of((1, "x")).limit(0)).collect() == []


def test_shingles_whole_text():
    text = " ".join(map(str, range(5_000)))
    assert len(shingle_set(text)) == 4_996


def test_bands_find_what_is_similar():
    """Random pairs at 0.75 share a band."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(0, 2**64, 800, dtype=np.uint64)
        a, b = pool[:700], np.concatenate([pool[:600], pool[700:]])  # 600 of 800
        x, y = minhash.minima(a), minhash.minima(b)
        assert (minhash.band_keys(x) == minhash.band_keys(y)).any()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(1, 2), (3, 1)],
                                  "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 2: 1, 3: 1}


def test_query_against_brute_force(spark):
    tables = Path("/root/testdata/sf0.001")
    if not tables.exists():
        pytest.skip("no test tables")
    rows = [(r.doc_id, r.text) for r in
            spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op7_minhash"](spark, str(tables))) == sorted(brute(rows))
