import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from beatwire.llm import mixing
from beatwire.llm.catalog import QUERIES
from beatwire.llm.mixing import (_prefix_sums, hypergeometric, mix, mix_report, rank_sources,
                                 split_tickets, take_mix)


def brute_targets(rows):
    """Shares by weight; what is above three times the size goes to the others."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    order += [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, full = sum(sizes.values()), dict.fromkeys(order, 0.0), set()
    while True:
        free = sum(weight[s] for s in order if s not in full)
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return sizes, target
        full |= over


def check(rows, got):
    sizes, target = brute_targets(rows)
    taken, longest, spent = defaultdict(int), defaultdict(int), Counter()
    source_of = {key: source for key, _, source in rows}
    words = {(k, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for k, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        source = source_of[r.doc_id]
        assert (r.doc_id, r.size) in words and r.source_size == sizes[source]
        assert math.isclose(r.target, target[source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert len(r.shards) == (r.taken // r.size if r.size else 0)
        taken[source] += r.taken
        longest[source] = max(longest[source], r.size)
        spent.update(r.shards)
    for source, t in target.items():
        assert t - longest[source] - 1 <= taken[source] <= t + 1, source
    return taken, target, spent


def random_rows(seed, n=900):
    rnd = random.Random(seed)
    names = ["a", "B", "é", "z", "\U0001f600", None, "", "a2", "hot", "tiny"]
    weights = [5, 3, 2, 2, 1, 2, 1, 4, 20, .2]
    return [(i, None if rnd.random() < .02 else "w " * int(rnd.lognormvariate(3, 1.2)),
             rnd.choices(names, weights)[0]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_limits(docs_of, seed):
    rows = random_rows(seed)
    docs = docs_of(*rows, extra="size target taken no block")
    got = mix_report(docs).collect()
    taken, target, spent = check(rows, got)
    assert sum(taken.values()) > 0.97 * sum(target.values())
    assert set(spent) == set(range(16))
    again = mix_report(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_many_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 0.5)  # more than ten bits of blocks
    rows = [(i, "w " * (i % 40), "big" if i % 3 else "b") for i in range(1_500)]
    taken, target, _ = check(rows, mix_report(docs_of(*rows)).collect())
    for s in target:
        assert abs(taken[s] - target[s]) < 40


def test_cases(docs_of):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x y", None), (None, "x y z", "c"), (5, "q " * 70_000, "d")]
    rows += [(7, "p q", "e")] * 5
    got = mix_report(docs_of(*rows)).collect()
    assert len(got) == len(rows)
    assert len({(r.taken, tuple(r.shards)) for r in got if r.doc_id == 7}) == 1
    by = {r.doc_id: r for r in got}
    assert by[1].target == by[2].target == 0 and by[1].taken == by[2].taken == 0
    sizes, target = brute_targets(rows)
    assert math.isclose(by[3].target, target[None]) and math.isclose(by[None].target, target["c"])
    empty = docs_of((1, "x")).limit(0)
    assert mix_report(empty).collect() == [] and take_mix(empty).collect() == []
    assert [r.taken for r in mix_report(docs_of((1, None))).collect()] == [0]
    one = mix_report(docs_of((1, "x y", "s"), (2, "x", "s"))).collect()
    assert sorted((r.doc_id, r.taken) for r in one) == [(1, 2), (2, 1)]


def test_rows_of_the_mix(docs_of):
    rows = random_rows(4, 300)
    docs = docs_of(*rows, extra="size shards row id")
    want = {r.doc_id: r.rounds for r in mix(docs).collect()}
    out = take_mix(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter(r.doc_id for r in got) == {k: n for k, n in want.items() if n}
    texts = {k: t for k, t, _ in rows}
    assert all(r.text == texts[r.doc_id] for r in got)


@pytest.mark.parametrize("n,k,d", [(10, 4, 5), (50, 20, 25), (7, 7, 3), (9, 0, 4), (0, 0, 0)])
def test_hypergeometric_draws(spark, n, k, d):
    draws = 20_000
    u = (F.col("id") + 0.5) / draws
    got = Counter(r[0] for r in spark.range(draws).select(hypergeometric(
        F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(d).cast("long"), u)).collect())
    whole = math.comb(n, d)
    for x in range(0, d + 1):
        p = math.comb(k, x) * math.comb(n - k, d - x) / whole if d - x <= n - k else 0
        assert abs(got[x] / draws - p) < 2e-4


@pytest.mark.parametrize("counts", [[100], [3, 50, 0, 7, 900], [1] * 9])
def test_tree_is_exact(spark, counts):
    quotas = spark.createDataFrame([(i, n) for i, n in enumerate(counts) if n], "no long, n long")
    rows = split_tickets(quotas, len(counts), depth=3).collect()
    per_source, per_shard = Counter(), Counter()
    for r in rows:
        per_source[r.no] += r.n
        per_shard[r.shard] += r.n
    assert per_source == Counter({i: n for i, n in enumerate(counts) if n})
    loads = [per_shard[s] for s in range(8)]
    assert max(loads) - min(loads) <= 3


def test_prefix_sums_over_many_cells(spark):
    cells = spark.range(5_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("at"),
                                      (F.col("id") % 7).alias("v"))
    got = {(r.g, r["at"]): r.before for r in _prefix_sums(cells, "at", "v", 13, ["g"]).collect()}
    sums = [0, 0]
    for i in range(5_000):
        assert got[i % 2, i] == sums[i % 2]
        sums[i % 2] += i % 7


def test_rank_by_code_point(spark):
    names = ["b", "a", "B", None, "é", "￿", "\U0001f600", "", "aa"]
    df = spark.createDataFrame([(n,) for n in names], "source string").repartition(5)
    got = {r.source: r.no for r in rank_sources(df).collect()}
    order = sorted((n for n in names if n is not None)) + [None]
    assert got == {n: i for i, n in enumerate(order)}


def test_query(spark):
    tables = Path("/root/testdata/sf0.001")
    if not tables.exists():
        pytest.skip("no test tables")
    rows = [(r.doc_id, r.text, r.source) for r in
            spark.read.parquet(f"{tables}/documents.parquet").collect()]
    check(rows, QUERIES["op4_mixing"](spark, str(tables)).collect())
