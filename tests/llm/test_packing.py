import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from beatwire.llm.catalog import QUERIES
from beatwire.llm.packing import Coder, pack, pack_docs, pieces_of, plan, sequences

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODER = Coder(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def expected_pieces(docs, capacity):
    out = []
    for doc_id, text in docs:
        ids = library_ids(text)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            out.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=repr)


def check_places(rows, capacity):
    """Every sequence is filled from 0 without gaps, up to the capacity; returns their number."""
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(seqs)


def check(docs, rows, capacity):
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=repr) == expected_pieces(docs, capacity)
    return check_places(rows, capacity)


@pytest.mark.parametrize("text", [
    "ΣΑΣ ΟΔΟΣ", "á ́x İstanbul", "x\x0by　z\x1c\x1dq\x85\xa0w", "don't I'LL 'S ''s <|endoftext|> A<|startoftext|>b",
    "<|ENDOFTEXT|>", "힣 한국어 ", "  ​ ﬁ ½ ²", "  ", "ª º µ ß ÷×", "Ünï_cödé12 3.5!?..", "é "])
def test_ids_are_those_of_the_library(text):
    got = np.frombuffer(Coder(PATH).encode(text), "<u4").tolist()
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_ids_of_any_text(text):
    got = np.frombuffer(CODER.encode(text), "<u4").tolist()
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plan_uses_every_piece_once(histogram):
    used = defaultdict(int)
    patterns = plan(histogram, 40)
    for times, need in patterns:
        assert times > 0 and sum(n * c for n, c in need.items()) <= 40
        for n, c in need.items():
            used[n] += c * times
    assert used == histogram


def brute_force(pieces, capacity):
    """The fewest sequences, by trying everything; small inputs only."""
    best = len(pieces)

    def go(left, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if not left:
            best = len(gaps)
            return
        for i in sorted({gaps.index(g) for g in gaps if g >= left[0]}):
            go(left[1:], gaps[:i] + [gaps[i] - left[0]] + gaps[i + 1:])
        go(left[1:], gaps + [capacity - left[0]])

    go(sorted(pieces, reverse=True), [])
    return best


def test_plan_near_the_fewest():
    rng = random.Random(5)
    extra = 0
    for _ in range(60):
        pieces = [rng.randint(1, 20) for _ in range(9)]
        histogram = {n: pieces.count(n) for n in set(pieces)}
        extra += sum(t for t, _ in plan(histogram, 20)) - brute_force(pieces, 20)
    assert 0 <= extra <= 3


def test_gaps_are_filled_exactly():
    histogram = {900: 10, 1148: 10, 1000: 4, 600: 4, 448: 4, 700: 3, 650: 3, 398: 3, 300: 3}
    assert sum(t for t, _ in plan(histogram)) == 17  # one, two, three parts: no token to spare


def test_large_counts_do_not_cost_more():
    few, many = ({n: k * (n % 7 + 1) for n in range(1, 2049)} for k in (1, 10**9))
    assert len(plan(many)) <= len(plan(few)) + 2048


def test_documents(spark, docs_of):
    texts = ["", None, "One two, three.", "One two, three.", "A b " * 1_500, "é" * 9_000, "x " * 4_095,
             "1 " * 2_047, "<|endoftext|>"]
    docs = [*enumerate(texts), (None, "One two"), (3, "again"), (3, "again")]
    df = docs_of(*docs, extra="piece start length ids sums n_ids c sequence_id offset __place")
    check(docs, pack_docs(df.repartition(3), PATH).collect(), 2048)


def test_small_capacity_and_ids(spark, docs_of):
    docs = [(i, "word " * (i % 9)) for i in range(60)]
    packed = pack_docs(docs_of(*docs), PATH, capacity=5, with_ids=True)
    n = check(docs, packed.collect(), 5)
    got = sequences(packed).collect()
    assert len(got) == n and max(len(r.ids) for r in got) <= 5
    assert sorted(i for r in got for i in r.ids) == sorted(
        i for _, t in docs for i in library_ids(t))


def test_a_hot_length(spark):
    pieces = spark.range(3_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, 100).otherwise(F.col("id") % 90 + 1)
        .cast("long").alias("length")).repartition(7)
    from beatwire.session import written
    rows = pack(written(pieces, "test")).collect()
    total = sum(r.length for r in rows)
    assert len(rows) == 3_000 and check_places(rows, 2048) == -(-total // 2048)


def test_reruns_agree_whatever_the_split(spark, docs_of):
    docs = [(i % 50, "word " * (i % 7)) for i in range(200)]
    runs = [sorted(map(tuple, pack_docs(docs_of(*docs).repartition(n), PATH, capacity=8).collect()))
            for n in (1, 5)]
    assert runs[0] == runs[1]


def test_empty_table(docs_of):
    empty = docs_of((1, "x")).limit(0)
    assert pack_docs(empty, PATH).collect() == []
    assert pieces_of(empty, PATH).columns == ["doc_id", "piece", "start", "length", "ids_crc32"]


def test_query_against_the_library(spark):
    tables = Path("/root/testdata/sf0.001")
    if not tables.exists():
        pytest.skip("no test tables")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    df = QUERIES["op13_packing"](spark, str(tables))
    assert df.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"),
                         ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"),
                         ("offset", "bigint")]
    rows = df.collect()
    n = check(docs, rows, 2048)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 2048)
