"""Best-fit packing of token sequences by exact complements.

Only lengths matter for a plan, and there are at most ``capacity`` of them: the
exact histogram of lengths, one number each, is all that the plan is made from.
The plan indexes the sums of one, two and three available lengths. Longest
first, a length takes a combination that fills its gap to the last token, as
often as the available pieces allow; every such step uses up a length. What has
no exact combination is filled best-fit: the longest length that fits, until
the rest of the gap can be filled exactly or nothing fits.

Spark does the rest: pieces are placed in the order of their length, and the
place tells sequence and offset by a search in the plan's intervals, at most one
for each length of each pattern. No text or id goes through the driver.

Defined cases: null and empty texts have the end id alone; repeated rows and
null ids are documents of their own; a piece as long as the capacity is a
sequence by itself; an empty table gives an empty result; only the id and the
text are read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatwire.llm.byte_bpe import spelled
from beatwire.llm.ranks import ranked
from beatwire.session import written

CAPACITY = 2048
END = 0
# Words whose ids a worker remembers; a full memory is kept beside a new one until that is full.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 48
SLICE = 256  # documents whose pieces leave a worker together
BLANKS_APART = re.compile(r"[^ \t\n\r]+")


def latin_pattern(pattern: str) -> re.Pattern:
    """A split pattern with its classes of letters, numbers and white space written out.

    For Latin-1 texts only; the standard library reads it twice as fast.
    """
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        chars = [chr(c) for c in range(256) if regex.fullmatch(name, chr(c))]
        pattern = pattern.replace(name, "".join(re.escape(c) for c in chars))
    return re.compile(pattern)


class Coder:
    """Ids of texts by a tokenizer file, as little-endian 32-bit bytes.

    For a tokenizer that lower-cases and splits by a pattern leaving white space
    out, as ``word_bpe_49k``. Each part is encoded by the library once and
    remembered: the words of the file's pattern, each byte spelt as one character,
    where the text is Latin-1 (its normal form is the text in lower case), else
    stretches between blanks.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.split = latin_pattern(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _parts(self, text: str) -> tuple[list[str], bool]:
        """The parts of a text, and whether they are words of the split pattern."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return BLANKS_APART.findall(text), False
        lower = text.lower()
        if any(mark in lower for mark in self.marks):
            return BLANKS_APART.findall(text), False
        return self.split.findall(lower), True

    def encode(self, text: str | None) -> bytes:
        parts, are_words = self._parts(text or "")
        codes = list(map(self.known.get, parts))
        if all(codes):
            return b"".join(codes)
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        missing = {p for p, code in zip(parts, codes) if code is None}
        self._learn(missing, are_words)
        data = b"".join([self.known[p] if code is None else code for p, code in zip(parts, codes)])
        for p in missing:
            if len(p) > LONGEST_REMEMBERED:
                del self.known[p]
        return data

    def _learn(self, parts: set[str], are_words: bool) -> None:
        new = []
        for p in parts:
            code = self.older.get(p)
            if code is None:
                new.append(p)
            else:
                self.known[p] = code
        if are_words:  # the pattern would not part them again, so the model can have them at once
            tokenize = self.tokenizer.model.tokenize
            for p in new:
                self.known[p] = array("I", [t.id for t in tokenize(spelled(p.encode()))]).tobytes()
        else:
            coded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            self.known.update(zip(new, [array("I", e.ids).tobytes() for e in coded]))


_LOADED: dict[str, Coder] = {}


def loaded(path: str) -> Coder:
    """One coder for each file in a worker process."""
    if path not in _LOADED:
        _LOADED[path] = Coder(path)
    return _LOADED[path]


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END,
              doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece, and its ``ids`` if asked for."""
    width, last = 4 * capacity, np.array([end], "<u4").tobytes()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    numbers = [("piece", "int32"), ("start", "int64"), ("length", "int64"), ("ids_crc32", "int64")]
    schema = ", ".join([f"doc_id {read.schema['doc_id'].dataType.simpleString()}", "piece int",
                        "start long", "length long", "ids_crc32 long",
                        *["ids array<int>"] * with_ids])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(vocabulary)
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                row, cells, ids = [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    data = coder.encode(t) + last
                    for k in range(0, len(data), width):
                        piece = data[k:k + width]
                        row.append(i)
                        cells.append((k // width, k // 4, len(piece) // 4, zlib.crc32(piece)))
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                columns = np.array(cells, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())),
                     *[pa.array(columns[:, j].astype(kind)) for j, (_, kind) in enumerate(numbers)],
                     *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])],
                    names=["doc_id", *[name for name, _ in numbers], *["ids"] * with_ids])

    return read.mapInArrow(cut, schema)


@dataclass
class Shelf:
    """Available lengths, with the sums of one, two and three of them as bits."""

    counts: dict[int, int]
    capacity: int
    sums: list[int] = field(default_factory=list)

    def __post_init__(self):
        self._index()

    def _index(self) -> None:
        self.lengths = sorted((n for n, c in self.counts.items() if c), reverse=True)
        mask = (1 << (self.capacity + 1)) - 1
        self.sums = [1]
        for _ in range(3):
            bits = 0
            for n in self.lengths:
                bits |= self.sums[-1] << n
            self.sums.append(bits & mask)

    def take(self, need: dict[int, int], times: int) -> None:
        for n, copies in need.items():
            self.counts[n] -= copies * times
        if any(self.counts[n] == 0 for n in need):
            self._index()

    def free(self, n: int, need: dict[int, int]) -> bool:
        return self.counts.get(n, 0) > need.get(n, 0)

    def longest(self, gap: int, need: dict[int, int]) -> int | None:
        return next((n for n in self.lengths if n <= gap and self.free(n, need)), None)

    def exact(self, gap: int, need: dict[int, int], parts: int, most: int | None = None
              ) -> list[int] | None:
        """``parts`` lengths, none over ``most``, that add up to ``gap`` beside ``need``."""
        if gap <= 0 or not self.sums[parts] >> gap & 1:
            return None
        if parts == 1:
            return [gap] if gap <= (most or gap) and self.free(gap, need) else None
        for n in self.lengths:
            if n * parts < gap:
                return None
            if n >= gap or n > (most or n) or not self.free(n, need):
                continue
            if not self.sums[parts - 1] >> (gap - n) & 1:
                continue
            rest = self.exact(gap - n, {**need, n: need.get(n, 0) + 1}, parts - 1, n)
            if rest:
                return [n, *rest]
        return None

    def fill(self, gap: int, need: dict[int, int]) -> list[int] | None:
        """The fewest of one to three lengths that fill the gap exactly."""
        return next((found for parts in (1, 2, 3) if (found := self.exact(gap, need, parts))), None)

    def times(self, need: dict[int, int]) -> int:
        return min(self.counts[n] // copies for n, copies in need.items())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times, {length: copies}) that use every piece of the histogram once.

    At most as many steps as lengths, but for the last pieces of one length.
    """
    shelf = Shelf(dict(histogram), capacity)
    patterns: list[tuple[int, dict[int, int]]] = []

    def use(need: dict[int, int]) -> None:
        times = shelf.times(need)
        shelf.take(need, times)
        patterns.append((times, need))

    def with_all(need: dict[int, int], more: list[int]) -> dict[int, int]:
        need = dict(need)
        for n in more:
            need[n] = need.get(n, 0) + 1
        return need

    if histogram.get(capacity):
        use({capacity: 1})
    for parts in (1, 2, 3):  # exact complements
        for n in sorted(histogram, reverse=True):
            while shelf.counts[n] and (found := shelf.exact(capacity - n, {n: 1}, parts)):
                use(with_all({n: 1}, found))
    for n in sorted(histogram, reverse=True):  # best fit for the rest
        while shelf.counts[n]:
            need, gap = {n: 1}, capacity - n
            while gap:
                found = shelf.fill(gap, need)
                if found:
                    need, gap = with_all(need, found), 0
                    continue
                one = shelf.longest(gap, need)
                if one is None:
                    break
                need, gap = with_all(need, [one]), gap - one
            use(need)
    return patterns


def intervals(histogram: dict[int, int], patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (first place, first sequence, copies, offset, length), by place.

    Places number the pieces from the shortest on; an interval's pieces go to one
    sequence after the other, ``copies`` to each.
    """
    free, first = {}, 0
    for n in sorted(histogram):
        free[n] = first
        first += histogram[n]
    rows, sequence = [], 0
    for times, need in patterns:
        offset = 0
        for n, copies in need.items():
            rows.append((free[n], sequence, copies, offset, n))
            free[n] += times * copies
            offset += n * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` plus ``sequence_id`` (from 0) and ``offset``.

    ``pieces`` is a written table with ``length`` from 1 to ``capacity``; its
    other columns, in their order, settle which of equal lengths goes where.
    """
    counted = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # capacity rows at most
    histogram = {r.length: r.n for r in counted}
    found = intervals(histogram, plan(histogram, capacity))
    firsts = found[:, 0].copy()

    @F.pandas_udf("sequence_id long, offset long")
    def locate(places: pd.Series) -> pd.DataFrame:
        at = places.to_numpy(np.int64)
        row = found[np.searchsorted(firsts, at, side="right") - 1]
        step = at - row[:, 0]
        return pd.DataFrame({"sequence_id": row[:, 1] + step // row[:, 2],
                             "offset": row[:, 3] + step % row[:, 2] * row[:, 4]})

    order = ["length", *[c for c, kind in pieces.dtypes if c != "length" and "array" not in kind]]
    placed = ranked(pieces, order, place="__place")
    return placed.select(*pieces.columns, locate("__place").alias("__at")).select(
        *pieces.columns, "__at.*")


def pack_docs(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END,
              doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(written(pieces_of(docs, vocabulary, capacity, end, doc_id, text, with_ids),
                        "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, ids) of pieces packed with their ids; a sequence is one row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.col("parts.doc_id").alias("doc_ids"),
        F.flatten(F.col("parts.ids")).alias("ids"))
