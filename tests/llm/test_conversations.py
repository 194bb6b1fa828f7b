import hashlib
import re
import sys
import zlib
from functools import cache
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from beatwire.llm.catalog import QUERIES
from beatwire.llm.conversations import repair, repair_damaged

sys.setrecursionlimit(20_000)  # the exhaustive search goes as deep as a conversation
SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def fault(row, before):
    ink = row[3].strip(BLANK)
    if not ink:
        return "blank"
    if row[2:] in [b[2:] for b in before]:
        return "duplicate"
    return "" if ink[-1] in ".!?" else "truncated"


def cheapest(rows, faults):
    """The least (cost, letters) over every sequence of edits, and the repaired lines.

    More than two insertions in front of a row are never worth their cost.
    """
    whole = re.compile(r"(s?(ua)+)?")
    begins = re.compile(r"s?(ua)*u?")

    @cache
    def best(i, initials, left):
        options = [(0, "", ())] if i == len(rows) and whole.fullmatch(initials) else []

        def add(cost, letter, nxt, line=None):
            i, initials, left = nxt
            if begins.fullmatch(initials):
                rest = best(i, {"u": "u", "a": "ua"}.get(initials[-1:], initials), left)
                if rest is not None:
                    options.append((cost + rest[0], letter + rest[1],
                                    (() if line is None else (line,)) + rest[2]))

        if i < len(rows):
            role, text = rows[i][2:]
            add(3, "D", (i + 1, initials, 2))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                if role[:1] in ("s", "u", "a"):
                    add(cut, "K", (i + 1, initials + role[0], 2), f"{role}:{text}")
                for other in ("user", "assistant"):
                    add(2 + cut, "R", (i + 1, initials + other[0], 2), f"{other}:{text}")
        if left:
            for other in ("user", "assistant"):
                add(2, "I", (i, initials + other[0], left - 1), f"{other}:")
        return min(options) if options else None

    return best(0, "", 2)


def brute(original):
    rows, out = damage(original), []
    for conv in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == conv),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = [fault(r, mine[:i]) for i, r in enumerate(mine)]
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest(mine, faults)
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, extra=(), batch=None):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in extra:
        df = df.withColumn(name, F.lit("clash"))
    assert sorted((tuple(r) for r in repair_damaged(df).collect()), key=repr) == brute(rows)


TEXTS = ["Yes.", "No", "  ", "Why? ", "So be it!\n\x0b", "A. b", "", "ß…", "Hm."]


def test_many_small_conversations(spark):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", ""]
    rows = []
    for conv in range(150):
        for turn in range(conv % 8):
            pick = zlib.crc32(f"{conv} {turn} pick".encode())
            rows.append((conv, turn * (1 + pick % 2), roles[pick // 7 % len(roles)],
                         f"{TEXTS[pick // 64 % len(TEXTS)]}" + "x." * (pick % 3 == 0) * turn))
    check(spark, rows)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None), (None, 3, "user", "A."), (7, None, "user", "A."),
            (7, None, "assistant", "B."), (7, 1, None, "C."), (7, 1, "user", None),
            (8, None, "system", "S."), (-5, 2, "user", "long " * 40_000 + "."),
            (-5, 3, "assistant", "x" * 100_000)]
    check(spark, rows + rows, extra=("conv", "order", "copy", "fault", "number", "edits", "kind",
                                     "gone", "times"))


def test_conversations_that_lose_all_rows(spark):
    lost = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows = repair_damaged(spark.createDataFrame([(c, 0, "user", "Hi.") for c in lost], SCHEMA)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, rows)) == [(c, 0, 0, 0, 0, 0, 0, "", empty) for c in lost]


def test_state_is_carried_across_batches(spark):
    """A giant conversation among small ones, in Arrow batches of seven rows."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(1, t, ("user", "assistant")[t % 3 > 0], f"Turn {t % 150}" + "." * (t % 5 > 0))
                for t in range(200)]
        rows += [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(2, 9) for t in range(4)]
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("roles, cost, audit", [
    ("", 0, ""), ("s", 3, "D"), ("ua", 0, "KK"), ("sua", 0, "KKK"), ("a", 2, "IK"), ("u", 2, "KI"),
    ("uu", 2, "KR"), ("au", 4, "IKKI"), ("us", 2, "KR"), ("uaa", 2, "KKIK"), ("ss", 4, "KIR")])
def test_known_repairs(spark, roles, cost, audit):
    full = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(1, i, full[r], f"{i}.") for i, r in enumerate(roles)] or [(1, 0, "user", " ")]
    got = repair(spark.createDataFrame(rows, SCHEMA)).first()
    if roles:
        assert (got.cost, got.audit) == (cost, audit)
    else:
        assert (got.cost, got.audit) == (3, "D")


def test_empty_table(spark):
    assert repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_sql(spark, same_as_sql):
    same_as_sql(spark, "op11_conversations")


def test_query_against_brute_force(spark):
    tables = Path("/root/testdata/sf0.01")
    if not tables.exists():
        pytest.skip("no test tables")
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversations"](spark, str(tables)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
