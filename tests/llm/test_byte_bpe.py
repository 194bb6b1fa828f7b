import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from beatwire.llm import byte_bpe
from beatwire.llm.byte_bpe import (ByteBpe, decode_docs, digest_docs, encode_docs, make_model,
                                   read_ranks)
from beatwire.llm.catalog import QUERIES

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = read_ranks(PATH)
CODEC = ByteBpe(make_model(RANKS), P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "  a", "a  ", "I'll we'd 'S", "é ß 漢字 🙂", "\x00\x1c\x85  x﻿", "<|endoftext|>",
       "▁x <unk> <s>", "١٢ ½", "a\r\n\r\n b", "x" * 3_000, "ab " * 50_000, "🙂" * 500]


def test_every_token_is_reachable():
    pieces = [byte_bpe.spelled(t) for t in RANKS]
    assert CODEC.processor.encode(pieces) == [[r] for r in RANKS.values()]


@pytest.mark.parametrize("text", ODD)
def test_as_the_library(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_any_text(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text) and CODEC.decode(ids) == text.encode()


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    codec = ByteBpe(make_model(RANKS), P.PATTERN)
    for text in ("a b c d e f g", "f g h i a", "a z"):
        assert codec.encode(text) == LIBRARY.encode_ordinary(text)


def test_operators(docs_of):
    docs = docs_of(*enumerate(ODD), (None, None), (1, " "), extra="ids d n_tokens")
    encoded = encode_docs(docs, PATH, P.PATTERN)
    got = {r.doc_id: r for r in encoded.collect()}
    assert got[None].ids == [] and got[None].n_tokens == 0
    back = {r.doc_id: bytes(r.data) for r in decode_docs(encoded, PATH, P.PATTERN).collect()}
    for i, text in enumerate(ODD):
        assert got[i].ids == LIBRARY.encode_ordinary(text) and back[i] == text.encode()
    assert encoded.count() == len(ODD) + 2
    assert digest_docs(docs.limit(0), PATH, P.PATTERN).collect() == []


def test_coded_in_slices(docs_of, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", 3)
    docs = docs_of(*enumerate(ODD), (None, None), extra="ids n_tokens")
    got = byte_bpe.code_docs(docs, PATH, P.PATTERN, keep=("doc_id", "source"))
    assert got.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(ODD) + 1 and rows[None].ids == []
    for i, text in enumerate(ODD):
        assert rows[i].ids == LIBRARY.encode_ordinary(text) and rows[i].n_tokens == len(rows[i].ids)
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.code_docs(docs.limit(0), PATH, P.PATTERN).collect() == []


def test_query_against_the_library(spark):
    from pathlib import Path
    TABLES = Path("/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    rows = QUERIES["op3_byte_bpe"](spark, str(TABLES)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
