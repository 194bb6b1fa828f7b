"""Mixing sources to target weights by a splitting tree, native Spark only.

1. Sizes are words. Sources share all words by weight; a target stops at three
   times its source's size, and what is over goes to the others by weight.
2. Within its source a document has a place in a fixed permutation, the 64 bits
   of a hash. The leading bits cut a source into blocks of some 128 documents.
   A source is taken in whole rounds and then block by block until its quota of
   words is reached; in the last block documents are taken, longest first, as
   long as they fit.
3. What is taken of a block in one round is a ticket. A splitting tree deals
   the tickets to output shards: at every node the left half's number of
   tickets of each source is a draw from the multivariate hypergeometric
   distribution, one source after another: of ``n`` tickets left, ``k`` of this
   source, ``d`` go left. Totals are exact at every node.
4. A shard gets a run of consecutive tickets of each source. Blocks are numbered
   by the permutation, so runs are disjoint random sets of blocks. In the shard
   rows are ordered by a hash of their own.

Everything is a function of seed, id, source and size: reruns agree. Sums over
blocks and ranks of sources are built up in groups of 1,024, so no task holds a
whole source, or all sources.

Defined cases: null text has size 0 and null source is a source of its own, the
last; documents of size 0 are never taken; rows with the same id, source and
size are taken alike and come back as often as they came; a source of size 0
has target 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatwire.llm.rows import repeated
from beatwire.session import written

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
MOST_ROUNDS = 3
SHARDS_LOG2 = 4
SEED = 42
BLOCK_DOCS = 128
FAN_BITS = 6  # branches of a node of the tree over sources: 64
WORD = "[^\\x20\\x09-\\x0D]+"
FIRST = Window.unboundedPreceding


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the hash of the keys."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys), 11)
    return bits.cast("double") / F.lit(float(2**53))


def _prefix_sums(cells: DataFrame, at: str, value: str, bits: int, group: Sequence[str]) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the smaller ``at`` of the group.

    ``at`` counts from 0 and has so many bits; 10 bits are summed at a time.
    """
    up, base = f"{at}_up", f"{at}_base"
    cells = cells.withColumn(up, F.shiftright(F.col(at), 10))
    order = Window.partitionBy(*group, up).orderBy(at).rowsBetween(FIRST, -1)
    inside = F.coalesce(F.sum(value).over(order), F.lit(0).cast("long"))
    if bits <= 10:
        return cells.withColumn("before", inside).drop(up)
    above = cells.groupBy(*group, up).agg(F.sum(value).alias("sum"))
    above = _prefix_sums(above, up, "sum", bits - 10, group)
    above = above.select(*group, up, F.col("before").alias(base))
    return (cells.join(above, [*group, up]).withColumn("before", inside + F.col(base))
            .drop(up, base))


def rank_sources(sources: DataFrame) -> DataFrame:
    """Adds ``no``, the rank of the source by code point, null last, from 0.

    Sources are sorted in ranges; the place within a range plus the rows of
    earlier ranges is the rank. Only the ranges are counted in one place.
    """
    ranged = written(sources.orderBy(F.col("source").asc_nulls_last())
                     .withColumn("id", F.monotonically_increasing_id()), "ranged-sources")
    ranged = ranged.withColumns({"range": F.shiftright("id", 33),
                                 "place": F.col("id").bitwiseAND(F.lit(2**33 - 1))}).drop("id")
    ranges = ranged.groupBy(F.col("range").alias("r")).agg(F.count("*").alias("n"))
    ranges = ranges.withColumn("first", F.coalesce(F.sum("n").over(
        Window.orderBy("r").rowsBetween(FIRST, -1)), F.lit(0).cast("long"))).drop("n")
    return (ranged.join(ranges, ranged["range"] == ranges["r"])
            .withColumn("no", F.col("place") + F.col("first")).drop("range", "place", "r", "first"))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to (no, source, source_size, ...): shares by weight, capped and reshared.

    One pass over the sources a time until no target is above its cap; the
    driver sees the common level (words a unit of weight) only.
    """
    of = F.array(*map(F.lit, weights))
    sources = sources.withColumns({
        "weight": F.element_at(of, (F.pmod("no", F.lit(len(weights))) + 1).cast("int")),
        "cap": F.col("source_size") * MOST_ROUNDS})
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        over = F.col("cap") <= F.col("weight") * F.lit(level)
        fixed, free = sources.agg(F.sum(F.when(over, F.col("cap"))),
                                  F.sum(F.when(~over, F.col("weight")))).first()
        grown = (total - (fixed or 0)) / free if free else level
        if grown <= level:
            break
        level = grown
    return sources.withColumn("target", F.least(F.col("cap").cast("double"),
                                                F.col("weight") * F.lit(level))).drop("weight", "cap")


def hypergeometric(n: Column, k: Column, d: Column, u: Column) -> Column:
    """How many of ``k`` marked among ``n`` are in a draw of ``d``, for a uniform ``u``.

    By inversion over twelve standard deviations to either side of the mean;
    beyond lies less than 1e-30 of the distribution.
    """
    n_, k_, d_ = n.cast("double"), k.cast("double"), d.cast("double")
    low = F.greatest(F.lit(0).cast("long"), d + k - n)
    high = F.least(k, d)
    mean = F.when(n > 0, k_ * d_ / n_).otherwise(0.0)
    var = F.when(n > 1, mean * (1 - k_ / n_) * (n_ - d_) / (n_ - 1)).otherwise(0.0)
    reach = 12 * F.sqrt(F.greatest(var, F.lit(0.0))) + 12
    first = F.greatest(low, F.floor(mean - reach))
    last = F.least(high, F.ceil(mean + reach))

    def ratio(x):  # weight of x + 1 over that of x
        return ((k_ - x) * (d_ - x)) / ((x + 1) * (n_ - k_ - d_ + x + 1))

    zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
    steps = F.sequence(first, last)
    whole = F.aggregate(steps, zero, lambda a, x: F.struct(
        (a["w"] * ratio(x)).alias("w"), (a["s"] + a["w"]).alias("s")), lambda a: a["s"])
    # the bar is part of the state, so that it is computed once
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), first.alias("x"),
                     (u * whole).alias("bar"))
    drawn = F.aggregate(steps, start, lambda a, x: F.struct(
        (a["w"] * ratio(x)).alias("w"), (a["s"] + a["w"]).alias("s"),
        F.when(a["s"] + a["w"] <= a["bar"], x + 1).otherwise(a["x"]).alias("x"),
        a["bar"].alias("bar")), lambda a: a["x"])
    return F.least(drawn, last)


def _left_halves(groups: DataFrame, fork: int, level: int, seed: int) -> DataFrame:
    """(shard, part, n, left): draws for the parts of every group (shard, kids, of, of_left).

    One part after another: ``n`` of the tickets that are left are its own, and
    so many of the places that are left on the left side go to them.
    """
    start = F.struct(F.col("of").alias("rest"), F.col("of_left").alias("places"),
                     F.array().cast("array<struct<part:bigint,n:bigint,left:bigint>>").alias("out"))

    def deal(a: Column, kid: Column) -> Column:
        u = _uniform(F.lit(seed), F.lit(fork), F.lit(level), F.col("shard"), kid["part"])
        drawn = hypergeometric(a["rest"], kid["n"], a["places"], u)
        return F.struct((a["rest"] - kid["n"]).alias("rest"), (a["places"] - drawn).alias("places"),
                        F.concat(a["out"], F.array(F.struct(
                            kid["part"].alias("part"), kid["n"].alias("n"),
                            drawn.alias("left")))).alias("out"))

    dealt = F.aggregate("kids", start, deal, lambda a: a["out"])
    return groups.select("shard", F.inline(dealt))


def split_tickets(quotas: DataFrame, n_sources: int, depth: int = SHARDS_LOG2,
                  seed: int = SEED) -> DataFrame:
    """(shard, no, n): tickets (no, n) of every source dealt to 2^depth shards.

    Shards get equal totals, but for one ticket a split. Sources form a tree of
    64 branches a node; ``part`` is a node, single sources at the last level.
    A draw over 64 branches happens in one row, whatever the number of sources.
    """
    levels = max(1, math.ceil(math.log2(max(2, n_sources)) / FAN_BITS))
    state = quotas.select(F.lit(0).alias("shard"), "no", "n")
    for fork in range(depth):
        state = written(state, "ticket-tree")
        above = None
        for level in range(1, levels + 1):
            part = F.shiftright("no", FAN_BITS * (levels - level))
            kids = state.groupBy("shard", part.alias("part")).agg(F.sum("n").alias("n"))
            groups = kids.groupBy("shard", F.shiftright("part", FAN_BITS).alias("up")).agg(
                F.sort_array(F.collect_list(F.struct("part", "n"))).alias("kids"),  # 64 at most
                F.sum("n").alias("of"))
            if above is None:
                odd = F.when(_uniform(F.lit(seed), F.lit(fork), F.col("shard")) < 0.5,
                             F.pmod("of", F.lit(2))).otherwise(F.lit(0))
                groups = groups.withColumn("of_left", F.expr("of div 2") + odd)
            else:
                groups = groups.join(above, ["shard", "up"])
            dealt = _left_halves(groups, fork, level, seed)
            above = dealt.select("shard", F.col("part").alias("up"), F.col("left").alias("of_left"))
        halves = F.explode(F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("n")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), (F.col("n") - F.col("left")).alias("n"))))
        state = (dealt.select(F.col("part").alias("no"), halves.alias("h"))
                 .select("h.shard", "no", "h.n").where("n > 0"))
    return state


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, depth: int = SHARDS_LOG2,
        seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
        source: str = "source") -> DataFrame:
    """(doc_id, source, size, m, source_size, target, rounds, shards), one row per id, source
    and size; ``m`` rows of the table have them.

    ``rounds`` says how often the mix takes the document, ``shards`` names the
    output shard of each time. Several small steps are kept in the shared folder.
    """
    keys = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                               words_in(F.col(text)).alias("size"))
                   .groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "sizes")
    sources = targets(written(rank_sources(keys.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"),
        F.count("*").alias("n_keys"))), "ranked-sources"), weights)
    # bits of the block number: some 128 documents a block
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_keys") / BLOCK_DOCS))).cast("int")
    sources = written(sources.withColumn("bits", bits).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).cast("long")).withColumn(
        "rest", F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")),
        "sources")
    widest, n_sources = sources.agg(F.max("bits"), F.count("*")).first()

    place = F.xxhash64("doc_id", "size", F.lit(seed))  # its leading bits are the block
    named = sources.withColumnRenamed("source", "of")
    rows = (keys.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
            .withColumn("place", place)
            .withColumn("block", F.expr("CASE WHEN bits = 0 THEN 0L "
                                        "ELSE shiftrightunsigned(place, 64 - bits) END")))
    rows = written(rows.drop("place"), "placed")

    blocks = rows.groupBy("no", "block").agg(F.sum(F.col("size") * F.col("m")).alias("words"),
                                             F.first("rest").alias("rest"),
                                             F.first("whole").alias("whole"))
    blocks = written(_prefix_sums(blocks, "block", "words", widest or 0, ["no"]).withColumn(
        "room", F.col("rest") - F.col("before")), "blocks")

    # the block in which the quota ends: documents that fit, longest first
    edge = blocks.where("room > 0 and room < words").select("no", "block", "room")
    listed = (rows.join(edge, ["no", "block"]).groupBy("no", "block", "room")
              .agg(F.sort_array(F.collect_list(F.struct(
                  (F.col("size") * F.col("m")).alias("words"), "doc_id", "size")), asc=False)
                  .alias("docs")))
    state = F.struct(F.col("room").alias("room"),
                     F.slice("docs", 1, 0).alias("taken"))
    fitting = F.aggregate("docs", state, lambda a, x: F.when(
        (x["words"] <= a["room"]) & (x["words"] > 0),
        F.struct((a["room"] - x["words"]).alias("room"),
                 F.concat(a["taken"], F.array(x)).alias("taken"))).otherwise(a),
        lambda a: a["taken"])
    fitted = (listed.select("no", F.explode(fitting).alias("x"))
              .select(F.col("no").alias("f_no"), F.col("x.doc_id").alias("f_id"),
                      F.col("x.size").alias("f_size")))

    # tickets: round after round over the blocks of a source, dealt to the shards
    rounds_of = F.col("whole") + (F.col("room") > 0).cast("long")
    ranked = _prefix_sums(blocks.select("no", "block", rounds_of.alias("rounds"),
                                        F.lit(1).cast("long").alias("one")),
                          "block", "one", widest or 0, ["no"])
    quotas = ranked.groupBy("no").agg(F.sum("rounds").alias("n"), F.count("*").alias("n_blocks"))
    dealt = written(split_tickets(quotas.where("n > 0"), n_sources, depth, seed), "dealt")
    runs = (_prefix_sums(dealt, "shard", "n", depth, ["no"]).groupBy("no")
            .agg(F.sort_array(F.collect_list(F.struct(  # at most one entry a shard
                (F.col("before") + F.col("n")).alias("after"), "shard"))).alias("runs")))
    numbered = (ranked.where("rounds > 0").join(quotas, "no").join(runs, "no").select(
        "no", "block", F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1),
            lambda k: F.element_at(F.filter(
                "runs", lambda r: r["after"] > k * F.col("n_blocks") + F.col("before")), 1)["shard"])
        .alias("shards")))

    same = ((F.col("no") == F.col("f_no")) & F.col("doc_id").eqNullSafe(F.col("f_id"))
            & (F.col("size") == F.col("f_size")))
    out = (rows.join(blocks.select("no", "block", "room", "words"), ["no", "block"])
           .join(numbered, ["no", "block"], "left").join(fitted, same, "left"))
    more = ((F.col("room") >= F.col("words")) & (F.col("room") > 0)) | F.col("f_no").isNotNull()
    rounds = F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(0)
    return (out.withColumn("rounds", rounds)
            .withColumn("shards", F.slice(F.coalesce("shards", F.array().cast("array<int>")),
                                          1, F.col("rounds").cast("int")))
            .select("doc_id", "source", "size", "m", "source_size", "target", "rounds", "shards"))


def mix_report(docs: DataFrame, **names) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards), one row per row of ``docs``."""
    mixed = repeated(mix(docs, **names), "m")
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("rounds")).alias("taken"), "shards")


def take_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             **options) -> DataFrame:
    """The rows of the mix, each as often as it is taken, all columns kept.

    Rows leave in the order of their shard and, in it, of a hash: one file or
    task is a shuffled piece of a shard.
    """
    mixed = mix(docs, doc_id=doc_id, text=text, source=source, **options).where("rounds > 0")
    mixed = mixed.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
                         F.col("size").alias("__size"), "shards")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"),
                       F.col(source).alias("of"), words_in(F.col(text)).alias("size"))
    same = (F.col("id").eqNullSafe(F.col("__id")) & F.col("of").eqNullSafe(F.col("__source"))
            & (F.col("size") == F.col("__size")))
    copies = rows.join(mixed, same).select("row", "id", F.posexplode("shards").alias("k", "shard"))
    seed = options.get("seed", SEED)
    return (copies.repartition(F.col("shard"), F.pmod(F.xxhash64("id"), F.lit(64)))
            .sortWithinPartitions("shard", F.xxhash64("id", "k", F.lit(seed))).select("row.*"))
