"""Repair of conversation structure by a streamed cheapest edit.

The roles of a conversation should read ``(s?(ua)+)?``: nothing, or an optional
system turn and then user and assistant in turn. Keeping a row costs 0, giving it
the role user or assistant 2, deleting it 3, inserting an empty turn 2; a row cut
off in mid-sentence adds 1 unless deleted. Blank and repeated rows must go.

Rows are dealt out by conversation and sorted by turn. The first stream walks
each conversation from its last row to its first. Its state is the cost to the
end from each of four positions of the pattern, whatever the conversation's
length, and is carried across Arrow batches. Each row leaves with the cheapest
edit from every position, ties to the least letter, packed into one byte. The
second stream reads the rows in order, follows these bytes, and writes edits and
repaired turns. Between the two streams Spark sorts each task's rows once more,
spilling to disk what exceeds memory: there the back pointers of a giant
conversation rest. Rows are not shuffled again, and neither stream holds more
than a batch and one conversation's state and edit letters.

Defined cases: a null conversation id is a conversation, null turns come first,
null role or text counts as one space; rows of one turn are ordered by role, then
text; repeated rows count as repeated; a text of any length is hashed whole, row
by row; a conversation without rows after damage gives zeros; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bytes that are blank, and the ends of a sentence.
INK = r"[^\x20\x09-\x0D]"
ENDS = ".!?"
UNFINISHED = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"

# Positions in the pattern: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by a user or assistant turn
ROLE = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, KEEP, REROLE = range(4)  # in the order of their letters
LETTERS = "DIKR"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
CUT_OFF = 1  # added for an undeleted truncated row
AT_END = (0, 4, 2, 0)  # cost of the missing turns when no row is left


def kept_position(position: int, initial: str) -> int | None:
    """Where a kept row of this role leads; none if it may not stand there."""
    if initial == "s" and position == START:
        return SYSTEM
    after = NEXT[position]
    return after if ROLE[after][0] == initial else None


def step(costs: tuple[int, ...], initial: str, must_go: bool, cut: bool
         ) -> tuple[tuple[int, ...], int]:
    """Costs to the end from in front of a row, and its edits: two bits a position."""
    edits = []
    for p in range(4):
        options = {DELETE: COST[DELETE] + costs[p]}
        if not must_go:
            to, extra = kept_position(p, initial), CUT_OFF * cut
            if to is not None:
                options[KEEP] = COST[KEEP] + extra + costs[to]
            options[REROLE] = COST[REROLE] + extra + costs[NEXT[p]]
        edits.append(options)
    best = [min(o.values()) for o in edits]
    for _ in range(2):  # an insertion leads on to another position in front of the same row
        best = [min(best[p], COST[INSERT] + best[NEXT[p]]) for p in range(4)]
    byte = 0
    for p, options in enumerate(edits):
        options[INSERT] = COST[INSERT] + best[NEXT[p]]
        byte |= min(e for e, c in options.items() if c == best[p]) << 2 * p
    return tuple(best), byte


class Backward:
    """The state of the first stream: costs to the end, less the least of them."""

    def __init__(self):
        self.key: object = self  # of no conversation
        self.known: dict[tuple, tuple] = {}
        self.costs = AT_END

    def edits(self, key, initial: str, must_go: bool, cut: bool) -> int:
        if key != self.key:
            self.key, self.costs = key, AT_END
        row = (self.costs, initial if initial in ("s", "u", "a") else "", must_go, cut)
        if row not in self.known:
            costs, byte = step(*row)
            self.known[row] = tuple(c - min(costs) for c in costs), byte
        self.costs, byte = self.known[row]
        return byte


class Forward:
    """One conversation in the second stream."""

    def __init__(self, key):
        self.key = key
        self.position, self.cost, self.letters = START, 0, []
        self.hash, self.lines = hashlib.sha256(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.first, self.last, self.initial = 0, None, None, None

    def line(self, role: str, text: str) -> None:
        if self.lines:
            self.hash.update(b"\n")
        self.lines += 1
        self.hash.update(role.encode("utf-8", "surrogatepass"))
        self.hash.update(b":")
        self.hash.update(text.encode("utf-8", "surrogatepass"))

    def insert(self) -> None:
        self.edit(INSERT)
        self.position = NEXT[self.position]
        self.line(ROLE[self.position], "")

    def edit(self, kind: int) -> None:
        self.letters.append(LETTERS[kind])
        self.cost += COST[kind]

    def row(self, turn: int | None, role: str, text: str, fault: str, byte: int) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        while byte >> 2 * self.position & 3 == INSERT:
            self.insert()
        kind = byte >> 2 * self.position & 3
        self.edit(kind)
        if kind == DELETE:
            return
        self.cost += CUT_OFF * (fault == "truncated")
        if kind == KEEP:
            self.position = kept_position(self.position, role[:1])
            self.line(role, text)
        else:
            self.position = NEXT[self.position]
            self.line(ROLE[self.position], text)

    def result(self) -> tuple:
        while self.position in (SYSTEM, USER):
            self.insert()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal,
                self.cost, "".join(self.letters), self.hash.hexdigest())


def blank(text: Column) -> Column:
    return ~text.rlike(INK)


def unfinished(text: Column) -> Column:
    """The last character that is not blank ends no sentence."""
    return text.rlike(UNFINISHED)


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): rows dropped, emptied, cut, doubled or given
    another role by a checksum of their conversation and turn. Dropped ones stay as
    ``gone``, so that their conversation is not forgotten."""
    space = F.lit(" ")
    named = [F.coalesce(F.col(c).cast("string"), space) for c in (conv_id, turn)]
    rows = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
        (F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20).alias("kind"))
    kind = F.col("kind")
    changed = (F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ENDS, ""))
               .otherwise(F.col("text")))
    rows = rows.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        changed.alias("text"), (kind == 0).alias("gone"),
        F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "gone",
                       F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")


RESULT = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, "
          "cost long, audit string, repaired_sha256 string")
EDITED = ("conv string, turn string, role string, text string, gone boolean, fault string, "
          "number long, edits int")


def walk_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows from the last to the first, each with its edits and a running number."""
    state, number = Backward(), 0
    for batch in batches:
        edits = []
        for key, gone, role, fault in zip(batch["conv"], batch["gone"], batch["role"], batch["fault"]):
            edits.append(0 if gone else state.edits(
                key, role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        yield batch.assign(number=range(number, number + len(batch)), edits=edits)
        number += len(batch)


def walk_forth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each conversation, when its last row has passed."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    now = None
    for batch in batches:
        done = []
        for key, turn, role, text, gone, fault, byte in zip(*[batch[c] for c in (
                "conv", "turn", "role", "text", "gone", "fault", "edits")]):
            if now is None or key != now.key:
                if now is not None:
                    done.append(now.result())
                now = Forward(key)
            if not gone:
                now.row(None if turn is None else int(turn), role, text, fault, byte)
        yield pd.DataFrame(done, columns=names)
    if now is not None:
        yield pd.DataFrame([now.result()], columns=names)


def repair(rows: DataFrame) -> DataFrame:
    """The audit of (conv_id, turn, role, text) and, if there, ``gone``: one row a conversation.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (the letters of
    Delete, Insert, Keep, Rerole in order) and the digest of the repaired turns.
    """
    conv_type = rows.schema["conv_id"].dataType
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    same = Window.partitionBy("conv", "gone", "role", F.sha2("text", 256)).orderBy(
        "order", "role", "text")
    fault = (F.when(blank(F.col("text")), "blank").when(F.col("copy") > 1, "duplicate")
             .when(unfinished(F.col("text")), "truncated").otherwise(""))
    together = (rows.select(F.col("conv_id").cast("string").alias("conv"),
                            F.col("turn").cast("string").alias("turn"), F.col("turn").alias("order"),
                            "role", "text", "gone")
                .repartition("conv")  # the window and both streams keep this partitioning
                .withColumn("copy", F.row_number().over(same))
                .withColumn("fault", fault))
    last_first = ["conv", F.desc_nulls_last("order"), F.desc("role"), F.desc("text"), F.desc("copy")]
    back = (together.sortWithinPartitions(*last_first)
            .select("conv", "turn", "role", "text", "gone", "fault")
            .mapInPandas(walk_back, EDITED))
    forth = (back.sortWithinPartitions("conv", F.desc("number"))
             .drop("number").mapInPandas(walk_forth, RESULT))
    return forth.select(F.col("conv").cast(conv_type).alias("conv_id"),
                        *[c.split()[0] for c in RESULT.split(", ")][1:])


def repair_damaged(rows: DataFrame) -> DataFrame:
    """:func:`repair` of :func:`damaged` rows."""
    return repair(damaged(rows))
