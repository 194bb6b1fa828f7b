import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from beatwire.llm import merkle
from beatwire.llm.merkle import verified_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, text):
    return sha(*map(framed, (row[0], row[3], row[2], row[4], text)))


def climb(nodes):
    """The root, and for every node the siblings left and right, level by level."""
    paths = [[] for _ in nodes]
    members = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 8, len(nodes))) for i in range(0, len(nodes), 8)]
        for run in runs:
            for i in run:
                left, right = [nodes[j] for j in run if j < i], [nodes[j] for j in run if j > i]
                for m in members[i]:
                    paths[m].append((left, right))
        members = [[m for i in run for m in members[i]] for run in runs]
        nodes = [sha(*[nodes[i] for i in run]) for run in runs]
    return nodes[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r) for r in rows
                       if r[2] == lang), key=lambda x: x[:3])
        trees.append((mine, *climb([x[2] for x in mine])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (mine, subroot, paths), top in zip(trees, tops):
        for (_, _, leaf, row), path in zip(mine, paths):
            fold = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                fold = leaf_of(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1]))
            for left, right in path + top:
                fold = sha(*left, fold, *right)
            siblings = [h for left, right in path + top for h in left + right]
            out.append((row[0], leaf, subroot, root, sha(*siblings), fold, fold == root))
    return sorted(out, key=repr)


def check(spark, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in extra:
        df = df.withColumn(name, F.lit("clash"))
    got = verified_manifest(df).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_sizes(spark, n):
    check(spark, [(i * 7 % 101, f"Text {i}", "en", "s", i) for i in range(n)])


def test_several_rounds_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    check(spark, [(i, f"Text {i}", "en" if i % 3 else f"l{i}", None, i) for i in range(200)])


def test_more_rows_than_a_block(spark):
    check(spark, [(i, f"T{i}", "en" if i < 700 else "fr", "s", 1) for i in range(800)])


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (None, "A", None, "s", 1), (1, "", "", "", 0),
            (1, "", "", "", 0), (2, "É" * 50_000 + "Z", "de", "s", 5), (2, "other", "de", "s", 5),
            (3, "ABC", "zz", "ß", 3), (3, "ABC", "é", "ß", 3), (-4, "ABC", "Z", "x", 3)]
    check(spark, rows * 2, extra=("block", "place", "hash", "item", "path", "grp", "k", "d0", "id"))


def test_empty_table(spark):
    assert verified_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_sql(spark, same_as_sql):
    same_as_sql(spark, "op12_merkle")
