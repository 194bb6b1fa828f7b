import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken
from test_minhash import brute

import corpus_pipeline
from beatwire.llm.byte_bpe import read_ranks
from beatwire.llm.mixing import mix

LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                            mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")))


def keeps(text):
    """The quality rules in plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    size = sum(map(len, words))
    return (len(words) >= 50 and 2 * len(repeated) <= len(words)
            and 2 * len(words) <= size <= 15 * len(words)
            and 5 * len(re.findall(r"[#*$%&|<>]", text)) <= len(words)
            and 2 * (len(lines) - len(set(lines))) <= len(lines))


def run_stages(spark, docs, tmp_path):
    """What every stage returns, each written and read again."""
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs)
    return out


def check(spark, rows, stages):
    """``rows`` are (doc_id, text, source)."""
    texts = {k: t for k, t, _ in rows}
    good = {k for k, t, _ in rows if keeps(t)}
    assert sorted(r.doc_id for r in stages[0].collect()) == sorted(k for k, t, _ in rows if keeps(t))
    last = {}
    for k in good:
        last[texts[k]] = max(k, last.get(texts[k], k))
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(last.values())
    left = [(k, texts[k]) for k in last.values()]
    firsts = sorted(k for k, _, name in brute(left) if k == name)
    assert sorted(r.doc_id for r in stages[2].collect()) == firsts
    rounds = {r.doc_id: r.rounds for r in mix(stages[2]).collect()}
    taken = Counter(r.doc_id for r in stages[3].collect())
    assert taken == Counter({k: n for k, n in rounds.items() if n})
    final = stages[4].collect()
    assert Counter(r.doc_id for r in final) == taken
    for r in final:
        assert r.ids == LIBRARY.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "exact dedup", "minhash near-dedup", "mixing sources", "byte-level bpe"]


def test_made_rows(spark, docs_of, tmp_path):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    rows = []
    for i in range(120):
        base = [word() for _ in range(rnd.choice([20, 60, 90]))]
        for j in range(rnd.choice([1, 1, 2, 3])):
            text = list(base)
            if j == 2:
                text[rnd.randrange(len(text))] = word()
            rows.append((len(rows) * 3, " ".join(text), rnd.choice(["a", "b", "c", None])))
    rows += [(9_000, None, "a"), (9_001, "", None), (9_002, "## " * 60, "b"), (9_003, "x " * 70, "c")]
    docs = docs_of(*rows, extra="lang size kept digest")
    stages = run_stages(spark, docs, tmp_path)
    assert all(s.columns == docs.columns for s in stages[:-1])
    check(spark, rows, stages)


def test_empty_table(spark, docs_of, tmp_path):
    empty = docs_of((1, "x"), extra="lang").limit(0)
    assert [s.count() for s in run_stages(spark, empty, tmp_path)] == [0] * 5


def test_small_tables(spark, tmp_path):
    tables = Path("/root/testdata/sf0.001")
    if not tables.exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = run_stages(spark, docs, tmp_path)
    assert all(s.columns == docs.columns for s in stages[:-1])
    check(spark, [(r.doc_id, r.text, r.source) for r in docs.collect()], stages)
    assert corpus_pipeline.run(spark, str(tables)).count() == stages[-1].count()
