import numpy as np
import pytest
from pyspark.sql import functions as F

from beatwire.llm import fuse
from beatwire.llm.exact_dedup import by_halves, drop_copies, exact_dedup


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 5_000, 60_000])
def test_filter_holds_its_keys(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    made = fuse.build(np.concatenate([keys, keys[:5]]))
    assert fuse.contains(made, keys).all()
    foreign = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    assert fuse.contains(made, foreign).mean() < 0.02
    if n >= 5_000:
        assert len(made) < 1.35 * n


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return groups


ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "a "), (7, "x" * 300_000),
        (8, "x" * 300_000), (9, "A"), (10, "é")]


@pytest.mark.parametrize("split", [lambda: F.lit(True), lambda: F.lit(False), by_halves])
@pytest.mark.parametrize("digest", [None, lambda t: F.unhex(F.hex(F.length(t)))])
def test_groups_for_any_split_and_digest(docs_of, split, digest):
    more = [(i, f"copy {i % 3}") for i in range(20, 60)]
    docs = docs_of(*ROWS, *more, extra="digest salt keep_id")
    kind = {} if digest is None else {"digest": digest}
    got = exact_dedup(docs, split(), **kind).collect()
    groups = brute(ROWS + more)
    assert len(got) == len(ROWS + more)
    texts = dict(ROWS + more)
    for r in got:
        same = groups[texts[r.doc_id] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))


def test_nulls_and_repeated_rows(docs_of):
    docs = docs_of((None, "a"), (1, "a"), (1, "a"), (None, "z"), (None, "z"))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in
                  exact_dedup(docs, by_halves()).collect()), key=repr)
    assert got == sorted([(None, 1, 3, False), (1, 1, 3, True), (1, 1, 3, False),
                          (None, None, 2, True), (None, None, 2, False)], key=repr)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in drop_copies(docs).collect()))) == \
        sorted(map(repr, [(1, "a"), (None, "z")]))


def test_drop_copies_keeps_columns(docs_of):
    docs = docs_of(*ROWS, extra="digest kept id row __id")
    out = drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 5, 6, 8, 9, 10]


def test_empty_table(docs_of):
    empty = docs_of((1, "x")).limit(0)
    assert exact_dedup(empty, by_halves()).collect() == []
    assert drop_copies(empty).collect() == []


def test_query_equals_sql(spark, same_as_sql):
    same_as_sql(spark, "op2_exact_dedup")
