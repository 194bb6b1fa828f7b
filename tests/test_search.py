import random

import pytest
from pyspark.sql import functions as F

from beatwire.operators import search as se
from beatwire.plans.verify import verify_claims

# Own sentences. Of the first ten words of either (river bridge closed after the barge
# struck its eastern pier / crews inspected the river bridge after one barge drifted into)
# the, river, bridge, after and barge are shared: 5 of 10.
CLAIM = "River bridge closed after the barge struck its eastern pier, officials say on Monday."
ARTICLE = ("Crews inspected the river bridge after one barge drifted into it. The eastern pier, "
           "struck on Monday, stays closed; officials say more later.")


# The keyword that a word of the test claims gives: none for short ones, signs are left out.
KEYWORDS = {"a": None, "b": None, "c": None, "is": None, "break-in": "breakin",
            "http://x.y/Zed": "http//xy/Zed"}


def keywords(text):
    """The different keywords of a claim that is made of known words, ten at most."""
    return [*dict.fromkeys(k for w in text.split() if (k := KEYWORDS.get(w, w)))][:10]


def brute_force(claims, docs, k):
    out = []
    for cid, text in claims:
        scored = []
        for did, title, body in docs:
            low = ((title or "").lower(), (body or "").lower())
            n = sum(any(kw.lower() in part for part in low) for kw in keywords(text))
            if n:
                scored.append((-n, did))
        out += [(cid, i + 1, did, -n) for i, (n, did) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    words = ["the", "The", "car", "cart", "scar", "delhi", "Delhi", "fort", "police", "a", "is",
             "http://x.y/Zed", "naïve", "ಹಾಸನ", "ಹಾಸನದ", "break-in", "theft", "thefts", "rare1"]
    docs = [(i, " ".join(rnd.choices(words, k=2)) if i % 7 else None,
             " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for i in range(120)]
    claims = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 14)))) for i in range(40)]
    claims += [(90, "a b c"), (91, "zzzz qqqq"), (92, "THE the The")]
    return (claims, docs, spark.createDataFrame(claims, "claim_id long, text string"),
            spark.createDataFrame(docs, "doc_id long, title string, text string"))


@pytest.mark.parametrize("seeds", [1, 6, 100])
def test_search_equals_brute_force(corpus, seeds):
    claims, docs, cdf, ddf = corpus
    got = sorted((r.claim_id, r["rank"], r.doc_id, r.score)
                 for r in se.search_corpus(cdf, ddf, seeds=seeds).collect())
    assert got == brute_force(claims, docs, se.TOP_HITS)


def test_shuffled_joins_give_the_same(corpus, monkeypatch):
    claims, docs, cdf, ddf = corpus
    monkeypatch.setattr(se, "BROADCAST_WANTED", 0)
    monkeypatch.setattr(se, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(se, "SLICE", 7)
    got = sorted((r.claim_id, r["rank"], r.doc_id, r.score)
                 for r in se.search_corpus(cdf, ddf).collect())
    assert got == brute_force(claims, docs, se.TOP_HITS)


def test_few_pairs_pass_the_bound(spark):
    """Claims of eight frequent words and two rare ones over 2,000 articles."""
    frequent = [f"word{c}" for c in "abcdefgh"]
    docs = [(i, "", " ".join(w for j, w in enumerate(frequent) if i >> j & 1 or i % 11 == j)
             + (f" rare{i % 40}x" if i % 5 == 0 else "")) for i in range(2_000)]
    claims = [(c, " ".join([*frequent, f"rare{c}x", f"rare{c + 1}x"])) for c in range(0, 40, 5)]
    cdf = spark.createDataFrame(claims, "claim_id long, text string")
    postings = se.Postings(se.keyword_postings(cdf, spark.createDataFrame(
        docs, "doc_id long, title string, text string")))
    wanted = se.claim_keywords(cdf).join(postings.counts(), "kw").cache()
    bars = {r.claim_id: r.bar for r in se.bars(wanted, postings, 5, se.SEEDS).collect()}
    assert len(bars) == len(claims) and min(bars.values()) > 0
    passed = se.candidates(wanted, postings, 5)
    holding = {c: sum(any(k in d[2].split() for k in text.split()) for d in docs) for c, text in claims}
    assert passed.count() < sum(holding.values()) / 3  # every other article holds each frequent word
    hits = {(c, d) for c, _, d, _ in brute_force(claims, docs, 5)}
    assert hits <= {(r.claim_id, r.doc_id) for r in passed.collect()}


def test_a_word_in_every_article_is_spread(spark):
    """A third of all postings belongs to one keyword; no part of the join gets much more."""
    rows = spark.range(0, 60_000, 1, 8).select(F.col("id").alias("doc_id"), F.explode(F.array(
        F.lit("hot"), F.concat(F.lit("a"), F.col("id") % 500), F.concat(F.lit("b"), F.col("id") % 700)))
        .alias("kw"))
    counts = rows.groupBy("kw").agg(F.count("*").alias("n_docs"))
    followed = counts.crossJoin(spark.range(2).select(F.col("id").alias("claim_id")))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = se.sliced_join(rows, followed, size=500)
        parts = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        assert joined.count() == 2 * 180_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) == 16 and parts[-1] <= 3 * parts[len(parts) // 2]


def test_a_corpus_stays_where_it_is(corpus, spark):
    """Neither its words nor its texts are shuffled for claims that can be broadcast."""
    claims, docs, cdf, ddf = corpus
    ddf = ddf.withColumns({"url": F.lit("u"), "source": F.lit("s")})
    hits = se.hit_articles(se.search_corpus(cdf, ddf), ddf)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    postings = se.Postings(se.keyword_postings(cdf, ddf))
    assert "Aggregate" not in postings.table._jdf.queryExecution().optimizedPlan().toString()
    wanted = se.claim_keywords(cdf).join(postings.counts(), "kw")
    pairs = spark.createDataFrame([(claims[0][0], 1)], "claim_id long, doc_id long")
    assert "strategy=broadcast" in postings.score(pairs, wanted)._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.claim_id, r["rank"], r.doc_id, r.score, r.text) for r in hits.collect())
    assert [r[:4] for r in got] == brute_force(claims, docs, se.TOP_HITS)
    assert all(r[4] == docs[r[2]][2] for r in got)


def test_keywords_of_words_that_are_forgotten(monkeypatch):
    words = ["cart", "scar", "theft", "ಹಾಸನದ", "arc", "xx", "carcar"]
    kws = ["car", "cart", "ಹಾಸನ", "eft", "arc"]
    monkeypatch.setattr(se, "KNOWN_WORDS", 2)
    held = se.HeldKeywords(kws)
    for _ in range(2):
        assert {w: set(held[w]) for w in words} == {w: {k for k in kws if k in w} for w in words}
    assert len(held) <= 2


def test_keyword_matches(corpus):
    claims, docs, cdf, ddf = corpus
    got = {(r.claim_id, r.kw): (r.weight, r.n_docs)
           for r in se.keyword_matches(cdf, ddf).collect()}
    want = {}
    for cid, text in claims:
        for kw in keywords(text):
            w, _ = want.get((cid, kw.lower()), (0, 0))
            n = sum(kw.lower() in (t or "").lower() or kw.lower() in b.lower()
                    for _, t, b in docs)
            want[(cid, kw.lower())] = (w + 1, n)
    assert got == want


def test_match_count(spark):
    from beatwire.functions.text import match_count
    df = spark.createDataFrame([(["car", "Fort", "xyz"], "a CART", "fort")],
                               "k array<string>, text string, title string")
    assert df.select(match_count(F.col("k"), F.col("text"), F.col("title"))).first()[0] == 2


def _similarity(spark, claim, article, limit=10):
    df = spark.createDataFrame([(claim, article)], "c string, a string")
    return df.select(se.keyword_overlap(F.col("c"), F.col("a"), limit)).first()[0]


def test_similarity_sees_ten_words(spark):
    assert _similarity(spark, CLAIM, ARTICLE) == 50.0
    assert _similarity(spark, CLAIM, ARTICLE, None) > 75
    assert _similarity(spark, "a b", ARTICLE) == 0.0
    assert _similarity(spark, CLAIM, None) == 0.0


def test_verdict_borders(spark):
    claims = spark.createDataFrame([(i, "x") for i in range(5)], "claim_id long, text string")
    sims = spark.createDataFrame(
        [(1, 1, "t", "u", "s", 40.0), (2, 1, "t", "u", "s", 75.0), (3, 1, "t", "u", "s", 75.4),
         (3, 2, "t2", None, "s", 10.9), (4, 1, None, "u", None, 40.5)],
        "claim_id long, rank int, title string, url string, source string, similarity double")
    got = {r.claim_id: r for r in se.claim_verdict(claims, sims).collect()}
    assert [got[i].status for i in range(5)] == [
        "Inconclusive", "Inconsistent / Low Evidence", "Partially Matches", "Verified",
        "Partially Matches"]
    assert [got[i].score for i in range(5)] == [0, 40, 75, 75, 40]
    assert [got[i].light for i in range(5)] == ["red", "red", "orange", "green", "orange"]
    assert got[0].sources == []
    assert [(s.title, s.url, s.source, s.similarity) for s in got[3].sources] == [
        ("t", "u", "s", 75), ("t2", "#", "s", 10)]
    assert got[4].sources[0].title == "Related News" and got[4].sources[0].source == "Unknown"
    assert "from 2 sources" in got[3].reasoning


def test_verify_plan(spark):
    claims = spark.createDataFrame([(1, CLAIM), (2, "too short")], "claim_id long, text string")
    corpus = spark.createDataFrame(
        [(7, "Bridge under inspection", ARTICLE, "http://example.com/bridge", "River Post")],
        "doc_id long, title string, text string, url string, source string")
    verdicts, rejected = verify_claims(claims, corpus)
    (v,) = verdicts.collect()
    assert (v.claim_id, v.status, v.score) == (1, "Partially Matches", 50)
    assert [r.claim_id for r in rejected.collect()] == [2]
