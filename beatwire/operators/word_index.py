"""The words of a corpus, kept for many batches of claims.

An index is a folder of segments, one for each batch of articles that was added.
A segment holds its articles with their distinct words, in the parts they were
read in, and an inverted list: for each word and part one block with its
articles in order, their number and the first and last of them. Blocks lie in
buckets of their word's hash. A frequent word has a block in every part, so it
is spread over tasks when it is built and when it is read, and no block holds
more than the articles of a part. Articles are shuffled only if some came twice
or are known; otherwise their ids alone are, and then the words of the blocks.

Keywords that are few enough to broadcast are looked for in the blocks where these
lie; otherwise blocks and the words that match are joined.

A segment is written first and then entered in a log; readers see what the log
names. Adding a batch again replaces its own segment, and articles that are
already known are left out, so an interrupted call can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatwire.operators.merge import first_per
from beatwire.operators.search import (
    BROADCAST_WANTED, SEEDS, TOP_HITS, _listed, best_hits, claim_keywords, corpus_words, few,
    kept_few, keyword_finder, sliced_join, word_matches,
)
from beatwire.session import remove, written
from beatwire.sources.tables import _load_or_none

LOG_SCHEMA = "segment long, path string, n_articles long, replaces array<long>"
BUCKETS = 32
FIRST_BLOCKS = 200  # blocks of a keyword that its first articles are taken from


class WordIndex:
    """An index below ``path``; ``key`` names the id of an article."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def segments(self) -> list[tuple[int, str, int]]:
        """(number, path, articles) of every segment that counts, oldest first.

        The log has a row for each call that added or compacted.
        """
        log = _load_or_none(self.spark.read.schema(LOG_SCHEMA), "parquet", f"{self.path}/_log")
        rows = {r.segment: r for r in log.collect()} if log is not None else {}
        gone = {n for r in rows.values() for n in r.replaces or []}
        return [(n, rows[n].path, rows[n].n_articles) for n in sorted(rows) if n not in gone]

    def _union(self, table: str) -> DataFrame:
        parts = [self.spark.read.parquet(f"{path}/{table}") for _, path, n in self.segments() if n]
        if not parts:
            raise ValueError(f"nothing is indexed in {self.path}")
        return reduce(DataFrame.unionByName, parts)

    def articles(self) -> DataFrame:
        """(doc_id, words, part)."""
        return self._union("articles")

    def blocks(self) -> DataFrame:
        """(word, part, n, lo, hi, docs, bucket)."""
        return self._union("blocks")

    def add(self, corpus: DataFrame, segment: int | None = None) -> int:
        """Index articles (doc_id, title, text) that are not known yet; the segment's number.

        With the number of an earlier call that call is repeated: its segment is
        written again, whatever became of it.
        """
        known = [s for s in self.segments() if s[0] != segment]
        number = segment if segment is not None else 1 + max((s[0] for s in known), default=0)
        self._write(corpus_words(corpus), number, [], [path for _, path, n in known if n])
        return number

    def compact(self) -> int:
        """Bring all segments together into one; the replaced files are deleted."""
        old = self.segments()
        number = 1 + max(s[0] for s in old)
        self._write(self.articles().select("doc_id", "words"), number, [s[0] for s in old])
        for _, path, _ in old:
            remove(self.spark, path)
        return number

    def _write(self, split: DataFrame, number: int, replaces: list[int],
               known: Sequence[str] = ()) -> None:
        """A segment of the articles that no segment of ``known`` has, each of them once."""
        path = f"{self.path}/s{number}"
        self._write_articles(split, path)
        articles = self.spark.read.parquet(f"{path}/articles")
        ids = [self.spark.read.parquet(f"{p}/articles").select("doc_id", F.lit(True).alias("known"))
               for p in known]
        surplus = written(
            reduce(DataFrame.unionByName, ids, articles.select("doc_id", F.lit(False).alias("known")))
            .groupBy("doc_id").agg(F.max("known").alias("known"), F.count_if(~F.col("known")).alias("n"))
            .where((F.col("n") > 1) | (F.col("known") & (F.col("n") > 0))), "surplus")
        if not surplus.isEmpty():
            ours = few(surplus)
            again = articles.join(ours.where(~F.col("known")).select("doc_id"), "doc_id", "left_semi")
            split = articles.join(ours.select("doc_id"), "doc_id", "left_anti").unionByName(
                again.dropDuplicates(["doc_id"]))
            self._write_articles(written(split.select("doc_id", "words"), "words"), path)
            articles = self.spark.read.parquet(f"{path}/articles")
        blocks = (articles.select("part", "doc_id", F.explode("words").alias("word"))
                  .groupBy("word", "part")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"),
                       F.max("doc_id").alias("hi"), F.sort_array(F.collect_list("doc_id")).alias("docs"))
                  .withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int")))
        (blocks.sortWithinPartitions("bucket", "word", "lo")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks"))
        entry = [(number, path, articles.count(), replaces)]
        (self.spark.createDataFrame(entry, LOG_SCHEMA).coalesce(1)
         .write.mode("append").parquet(f"{self.path}/_log"))

    def _write_articles(self, split: DataFrame, path: str) -> None:
        (split.select("doc_id", "words", F.spark_partition_id().alias("part"))
         .write.mode("overwrite").parquet(f"{path}/articles"))

    def postings(self, claims: DataFrame) -> "IndexPostings":
        return IndexPostings(self, claim_keywords(claims).select("kw").distinct())

    def search(self, claims: DataFrame, k: int = TOP_HITS, seeds: int = SEEDS) -> DataFrame:
        """What :func:`search_corpus` finds in all articles added so far."""
        if not any(n for _, _, n in self.segments()):
            return claims.select("claim_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                                 F.lit(0).cast("long").alias("score")).limit(0)
        return best_hits(claims, self.postings(claims), k, seeds)


class IndexPostings:
    """The postings of some keywords in an index, as the search asks for them.

    ``held`` has the blocks of every word that contains a keyword, with that keyword:
    (kw, word, n, lo, docs), found in one reading of the index.
    """

    def __init__(self, index: WordIndex, keywords: DataFrame):
        self.index = index
        blocks = index.blocks().select("word", "n", "lo", "docs")
        keywords = written(keywords, "keywords")
        if keywords.count() <= BROADCAST_WANTED:
            find = keyword_finder([r.kw for r in keywords.collect()])  # counted, as for a broadcast
            held = blocks.withColumn("kw", F.explode(find(F.col("word"))))
        else:
            # the join shuffles blocks by word; a frequent word has many, which Spark
            # splits when it finds the part skewed
            words = written(blocks.select("word").distinct(), "vocabulary")
            held = blocks.join(kept_few(word_matches(words, keywords)), "word")
        self.held = written(held, "held-blocks")

    def _blocks(self, keywords: DataFrame) -> DataFrame:
        return self.held.join(kept_few(keywords.select("kw").distinct()), "kw", "left_semi")

    def counts(self) -> DataFrame:
        """(kw, n_docs), an article counted for each of its words that contain the keyword.

        Good enough to order keywords by, and never too small.
        """
        return self.held.groupBy("kw").agg(F.sum("n").alias("n_docs"))

    def first(self, keywords: DataFrame, n: int) -> DataFrame:
        """(kw, doc_id): some of the first articles of each keyword, from its first blocks."""
        near = first_per(self._blocks(keywords), ["kw"], [F.asc("lo"), F.asc("word")], FIRST_BLOCKS)
        rows = near.select("kw", F.explode("docs").alias("doc_id")).distinct()
        return first_per(rows, ["kw"], [F.asc("doc_id")], n)

    def reach(self, followed: DataFrame) -> DataFrame:
        """Every article of every followed keyword, see :meth:`Postings.reach`."""
        rows = (self._blocks(followed).select("kw", F.explode("docs").alias("doc_id"))
                .distinct())
        if followed.count() <= BROADCAST_WANTED:
            return rows.join(F.broadcast(followed), "kw")
        return sliced_join(rows, followed)

    def score(self, pairs: DataFrame, wanted: DataFrame) -> DataFrame:
        """(claim_id, doc_id, score) of (claim_id, doc_id), over all keywords of the claim."""
        score = F.aggregate(
            F.filter("pairs", lambda p: F.exists("words", lambda w: F.contains(w, p["kw"]))),
            F.lit(0).cast("bigint"), lambda acc, p: acc + p["weight"])
        return (self.index.articles().select("doc_id", "words").join(kept_few(pairs), "doc_id")
                .join(_listed(wanted), "claim_id")
                .select("claim_id", "doc_id", score.alias("score")))
