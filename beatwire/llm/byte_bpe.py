"""Byte-level BPE with a sentencepiece model made from a rank file.

The vocabulary becomes a sentencepiece BPE model without any training: every
token's bytes are written as one printable character each, its score is its
negative rank, and the normaliser is the identity. Each match of the split
pattern is encoded separately; ids are the ranks. Decoding maps ids back to
pieces and pieces back to bytes.

Defined cases: null or empty text has no ids and decodes to no bytes; a text is
read whole; rows are handled one by one, so repeated rows, ties and null ids
each get their row; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

# Pre-tokens whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 40_000
SLICE = 256
UNKNOWN = "<unk>"


def byte_chars() -> list[str]:
    """One character for every byte: itself if printable and no space, else from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


TO_CHARS = dict(enumerate(byte_chars()))  # code point of a Latin-1 byte -> character
TO_BYTE = {c: b for b, c in TO_CHARS.items()}


def spelled(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_CHARS)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def make_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model whose ids are the ranks."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    model = proto.ModelProto()
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        model.pieces.add(piece=spelled(token), score=-float(rank),
                         type=proto.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece=UNKNOWN, score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    trainer, normalizer = model.trainer_spec, model.normalizer_spec
    trainer.model_type = proto.TrainerSpec.BPE
    trainer.vocab_size = len(ranks) + 1
    trainer.unk_id = len(ranks)
    trainer.bos_id = trainer.eos_id = trainer.pad_id = -1
    normalizer.name = "identity"
    normalizer.add_dummy_prefix = False
    normalizer.remove_extra_whitespaces = False
    normalizer.escape_whitespaces = False
    return model.SerializeToString()


class ByteBpe:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes, pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}
        size = self.processor.get_piece_size() - 1
        self.pieces = [bytes(TO_BYTE[c] for c in self.processor.id_to_piece(i))
                       for i in range(size)]

    def encode(self, text: str | None) -> list[int]:
        parts = self.split(text or "")
        known = self.known
        missing = list({p for p in parts if p not in known})
        if missing:
            if len(known) > REMEMBERED:
                kept = {p: known[p] for p in set(parts) if p in known}
                known.clear()
                known.update(kept)
            spelt = [spelled(p.encode()) for p in missing]
            known.update(zip(missing, self.processor.encode(spelt, num_threads=1)))
        return [i for p in parts for i in known[p]]

    def decode(self, ids: Iterable[int]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])


_LOADED: dict[str, ByteBpe] = {}


def loaded(model: bytes, pattern: str) -> ByteBpe:
    """One codec for each model and pattern in a worker process."""
    key = hashlib.sha256(model + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(model, pattern)
    return _LOADED[key]


def encoder(model: bytes, pattern: str):
    """A column function, text -> array of ids."""
    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        codec = loaded(model, pattern)
        return pd.Series([np.array(codec.encode(t), np.int32) for t in texts], dtype=object)

    return encode


def decoder(model: bytes, pattern: str):
    """A column function, array of ids -> bytes; null for null."""
    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        codec = loaded(model, pattern)
        return pd.Series([None if i is None else codec.decode(i) for i in ids], dtype=object)

    return decode


def digester(model: bytes, pattern: str):
    """Encode, decode what was encoded, and keep digests of both; one pass over the text."""
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        codec = loaded(model, pattern)
        numbers = [str(i) for i in range(len(codec.pieces))]
        rows = []
        for text in texts:
            ids = codec.encode(text)
            listed = " ".join([numbers[i] for i in ids]).encode()
            rows.append((len(ids), hashlib.sha256(listed).hexdigest(),
                         hashlib.sha256(codec.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def encode_docs(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    ids = encoder(make_model(read_ranks(vocabulary)), pattern)
    return (docs.select(F.col(doc_id).alias("doc_id"), ids(F.col(text)).alias("ids"))
            .select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids"))


def decode_docs(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, data): the bytes of every row of ``encode_docs``."""
    data = decoder(make_model(read_ranks(vocabulary)), pattern)
    return encoded.select("doc_id", data(F.col("ids")).alias("data"))


def digest_docs(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    digest = digester(make_model(read_ranks(vocabulary)), pattern)
    return (docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("d"))
            .select("doc_id", "d.*"))


def code_docs(docs: DataFrame, vocabulary: str, pattern: str, keep: Sequence[str] = ("doc_id",),
              text: str = "text") -> DataFrame:
    """(*keep, n_tokens, ids, decoded_sha256) of every row, one pass over the text.

    Ids leave a worker in slices of ``SLICE`` rows, so that it never holds those
    of a whole batch.
    """
    model = make_model(read_ranks(vocabulary))
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([kept.schema[c] for c in keep] + [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded_sha256", T.StringType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(model, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                ids = [np.array(codec.encode(t), np.int32) for t in part.column("__text").to_pylist()]
                decoded = [hashlib.sha256(codec.decode(i.tolist())).hexdigest() for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([len(i) for i in ids], pa.int64()),
                     pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                    names=schema.names)

    return kept.mapInArrow(code, schema)
