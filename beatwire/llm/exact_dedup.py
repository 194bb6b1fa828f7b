"""Exact de-duplication against an immutable snapshot.

Texts become SHA-256 digests. A snapshot keeps one row per digest in buckets
and a static binary-fuse filter per bucket. A new batch is grouped by digest
on its own; its digests are screened by the filters, and only positives are
joined with the exact buckets. Texts of digests that occur more than once are
then compared byte by byte: they are grouped by the text itself, so texts that
merely share a digest stay apart.

Hot groups: rows are grouped by (digest, salt) before they are grouped by
digest, and results go back to the rows by (digest, salt) too, so a group with
a third of all rows is spread over ``SALTS`` keys a batch.

Defined cases: null text counts as empty; the row with the largest id stays, a
null id being the smallest; of repeated rows (same id, same text) one stays;
an empty table gives an empty result; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwire.llm import fuse
from beatwire.llm.rows import repeated
from beatwire.session import written

SALTS = 64
BUCKET_KEYS = 50_000  # digests a bucket, on average
# Digests that occur more than once are broadcast up to this many (32 MB of
# binary digests); beyond, the same join shuffles.
BROADCAST_DIGESTS = 1_000_000


@dataclass(frozen=True)
class Snapshot:
    """Immutable: groups (digest, bucket, keep_id, n) and filters (bucket, filter)."""

    groups: DataFrame
    filters: DataFrame
    n_buckets: int


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def digest_rows(docs: DataFrame, is_new: Column, doc_id: str = "doc_id", text: str = "text",
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, digest, salt, m): one row per id and digest, m rows of the table.

    Salts of the new batch lie above those of the old one.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) + F.when(F.col("new"), SALTS).otherwise(0)
    return (docs.select(F.col(doc_id).alias("doc_id"), is_new.alias("new"),
                        digest(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
            .groupBy("doc_id", "digest", salt.cast("int").alias("salt"))
            .agg(F.count("*").alias("m")))


def digest_groups(rows: DataFrame) -> DataFrame:
    """(new, digest, keep_id, n, salts): groups of either batch, each on its own."""
    by_salt = rows.groupBy("digest", "salt").agg(F.max("doc_id").alias("keep_id"),
                                                 F.sum("m").alias("n"))
    return (by_salt.groupBy((F.col("salt") >= SALTS).alias("new"), "digest")
            .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"),
                 F.collect_set("salt").alias("salts")))


def _keyed(groups: DataFrame, n_buckets: int) -> DataFrame:
    return groups.withColumns({
        "key": F.xxhash64("digest"),
        "bucket": F.pmod(F.xxhash64("digest", F.lit("bucket")), F.lit(n_buckets)).cast("int")})


def build_snapshot(groups: DataFrame, n_buckets: int) -> Snapshot:
    """Buckets and filters of a batch of groups (digest, keep_id, n), kept as tables."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "filter": [fuse.build(keys)]})

    keyed = _keyed(groups, n_buckets)
    filters = (keyed.select("bucket", "key").groupBy("bucket")
               .applyInPandas(build, "bucket int, filter binary"))
    return Snapshot(groups, written(filters, "fuse-filters"), n_buckets)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Groups of a new batch that the snapshot's filters do not exclude."""
    def ask(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if batch.empty or filters.empty:
            return batch[["digest"]].head(0)
        keys = batch["key"].to_numpy(np.int64).view(np.uint64)
        return batch.loc[fuse.contains(filters["filter"].iloc[0], keys), ["digest"]]

    slim = _keyed(groups, snapshot.n_buckets).select("digest", "key", "bucket")
    positive = (slim.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket"))
                .applyInPandas(ask, "digest binary"))
    return groups.join(positive, "digest", "left_semi")


def exact_dedup(docs: DataFrame, is_new: Column, doc_id: str = "doc_id", text: str = "text",
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept, m, copy): one row per row of ``docs``.

    ``is_new`` splits the rows into the snapshot and the batch that is screened
    against it; the result does not depend on the split.
    """
    rows = written(digest_rows(docs, is_new, doc_id, text, digest), "digests")
    groups = written(digest_groups(rows), "digest-groups")
    n_buckets = max(1, math.ceil(groups.count() / BUCKET_KEYS))
    old, new = groups.where("not new"), groups.where("new")

    # what the batch shares with the snapshot, by filter and exact bucket
    hits = screen(new, build_snapshot(old, n_buckets)).alias("a")
    shared = hits.join(old.alias("b"), "digest").select(
        "digest", F.greatest("a.keep_id", "b.keep_id").alias("both_id"),
        (F.col("a.n") + F.col("b.n")).alias("both_n"))
    classes = written(groups.join(shared, "digest", "left").select(
        "digest", "salts", F.coalesce("both_id", "keep_id").alias("keep_id"),
        F.coalesce("both_n", "n").alias("group_size")), "digest-classes")

    # byte check: group whole texts wherever a digest occurs more than once
    doubtful = classes.where("group_size > 1").select("digest").distinct()
    if doubtful.count() <= BROADCAST_DIGESTS:
        doubtful = F.broadcast(doubtful)
    texts = (docs.select(F.col(doc_id).alias("doc_id"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))
             .withColumn("digest", digest(F.col("text"))).join(doubtful, "digest", "left_semi"))
    variants = written(texts.groupBy("digest", F.sha2("text", 512).alias("strong"), "text")
                       .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
                       .drop("text"), "byte-check")
    collided = written(variants.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1")
                       .select("digest"), "collided")

    answer = ["doc_id", "digest", "keep_id", "group_size", "m"]
    places = classes.select("digest", F.explode("salts").alias("salt"), "keep_id", "group_size")
    out = rows.join(places, ["digest", "salt"]).select(*answer)
    if not collided.isEmpty():
        # different texts under one digest: their rows follow the text instead
        by_text = (texts.join(collided, "digest", "left_semi")
                   .groupBy("doc_id", "digest", F.sha2("text", 512).alias("strong"))
                   .agg(F.count("*").alias("m")).join(variants, ["digest", "strong"]))
        out = out.join(collided, "digest", "left_anti").unionByName(by_text.select(*answer))
    return repeated(out, "m").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0))


def by_halves(doc_id: str = "doc_id") -> Column:
    """Split a table into snapshot and new batch where no arrival order is known."""
    return F.pmod(F.xxhash64(F.col(doc_id)), F.lit(2)) == 1


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, all columns kept."""
    judged = exact_dedup(docs, by_halves(doc_id), doc_id, text)
    odd = written(judged.where("copy = 0 and (not kept or m > 1)")
                  .select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"),
                          "kept"), "dropped")
    if odd.count() <= BROADCAST_DIGESTS:
        odd = F.broadcast(odd)
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"),
                       sha256(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    alone = rows.join(odd, same, "left_anti")
    again = (rows.join(odd.where("kept"), same, "left_semi")
             .dropDuplicates(["id", "digest"]))
    return alone.unionByName(again).select("row.*")
