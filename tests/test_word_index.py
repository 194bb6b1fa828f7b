import pytest
from pyspark.sql import functions as F

from beatwire.operators import search as se
from beatwire.operators.word_index import WordIndex
from test_search import brute_force, corpus  # noqa: F401  (the fixture)


def found(hits):
    return sorted((r.claim_id, r["rank"], r.doc_id, r.score) for r in hits.collect())


@pytest.fixture()
def index(spark, tmp_path):
    return WordIndex(spark, str(tmp_path / "index"), buckets=4)


def test_batches_added_one_after_the_other(corpus, index):  # noqa: F811
    claims, docs, cdf, ddf = corpus
    for third in range(3):
        index.add(ddf.where(F.col("doc_id") % 3 == third))
        have = [d for d in docs if d[0] % 3 <= third]
        assert found(index.search(cdf)) == brute_force(claims, have, se.TOP_HITS)
    assert [n for _, _, n in index.segments()] == [40, 40, 40]


def test_known_articles_and_repeated_calls_change_nothing(corpus, index):  # noqa: F811
    claims, docs, cdf, ddf = corpus
    number = index.add(ddf.where("doc_id < 50"))
    index.add(ddf)
    index.add(ddf.where("doc_id < 50"), segment=number)  # that call is repeated
    assert sorted(r.doc_id for r in index.articles().collect()) == [d[0] for d in docs]
    assert found(index.search(cdf)) == brute_force(claims, docs, se.TOP_HITS)


def test_compaction(corpus, index, tmp_path):  # noqa: F811
    claims, docs, cdf, ddf = corpus
    for part in range(4):
        index.add(ddf.where(F.col("doc_id") % 4 == part))
    index.compact()
    assert [n for _, _, n in index.segments()] == [len(docs)]
    assert not (tmp_path / "index" / "s1").exists()
    assert found(index.search(cdf)) == brute_force(claims, docs, se.TOP_HITS)


def test_blocks_state_their_bounds(corpus, index):  # noqa: F811
    index.add(corpus[3])
    for b in index.blocks().collect():
        assert (b.n, b.lo, b.hi) == (len(b.docs), min(b.docs), max(b.docs))
        assert b.docs == sorted(set(b.docs))


def test_an_unlogged_segment_is_not_read(corpus, index, spark):  # noqa: F811
    claims, docs, cdf, ddf = corpus
    index.add(ddf.where("doc_id < 60"))
    lost = WordIndex(spark, index.path + "-lost", buckets=4)
    lost.add(ddf.where("doc_id >= 60"))
    spark.read.parquet(lost.segments()[0][1] + "/articles").write.parquet(index.path + "/s2/articles")
    assert found(index.search(cdf)) == brute_force(claims, [d for d in docs if d[0] < 60], se.TOP_HITS)
    assert index.add(ddf) == 2
    assert found(index.search(cdf)) == brute_force(claims, docs, se.TOP_HITS)


def test_empty_index(index, corpus):  # noqa: F811
    with pytest.raises(ValueError):
        index.articles()
    index.add(corpus[3].limit(0))
    assert found(index.search(corpus[2])) == []


def test_articles_are_not_shuffled(corpus, index):  # noqa: F811
    """They lie in the parts they were read in; of repeated and known ones one stays."""
    claims, docs, cdf, ddf = corpus
    index.add(ddf.where("doc_id < 80").repartitionByRange(3, F.desc("doc_id")))
    parts = {}
    for r in index.articles().collect():
        parts.setdefault(r.part, []).append(r.doc_id)
    assert len(parts) == 3 and min(parts[0]) > max(parts[2])
    index.add(ddf.where("doc_id >= 60").unionByName(ddf.where("doc_id > 100")))
    assert sorted(r.doc_id for r in index.articles().collect()) == [d[0] for d in docs]
    assert found(index.search(cdf)) == brute_force(claims, docs, se.TOP_HITS)


def test_many_keywords_give_the_same(corpus, index, monkeypatch):  # noqa: F811
    from beatwire.operators import word_index
    claims, docs, cdf, ddf = corpus
    index.add(ddf)
    monkeypatch.setattr(se, "BROADCAST_WANTED", 0)
    monkeypatch.setattr(word_index, "BROADCAST_WANTED", 0)
    assert found(index.search(cdf)) == brute_force(claims, docs, se.TOP_HITS)
