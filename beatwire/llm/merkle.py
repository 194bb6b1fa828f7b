"""Merkle manifest of a dataset, rolled up as nested structs.

Every row is a leaf. Leaves of a group ascend by id; while several nodes remain,
every eight in a row become their digest. What remains of a group is its
subroot; subroots, in the order of their groups, give the root the same way.

The place of a leaf, written with digits of base eight, names its path. Leaves
are dealt out by blocks of 512 places. Within a block the lowest digit is
grouped away first: the nodes that differ in it become one row that nests them
as child structs; then the next digit, until a block is one row. The rows of
the blocks are the nodes of the next round, so a tree of any size is rolled up
without a row or group of more than 512. Proofs come out the other way: three
times ``explode`` of the nested children, each adding the digests left and right
of the child. Only between rounds the path above a block meets it, one row to
one row.

Defined cases: a null field is ``-``, an empty one ``0:``; texts of any length
are digested whole; null ids come first and are never tampered with; rows of one
id are ordered by their digest, and equal rows are leaves of their own; a null
group comes before all others; a single leaf is its subroot, a single subroot
the root; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwire.llm.ranks import matched, ranked
from beatwire.session import written

FAN_BITS, FAN = 3, 8
DEPTH = 3  # digits of a block
BLOCK = FAN ** DEPTH
BROADCAST_PATHS = 20_000  # paths of blocks, some kilobytes each

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def framed(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[framed(v) for v in values]))


def lowered(c: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def roll_up(nodes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Nodes (*key, place, n_nodes, hash, item) to blocks (*key, n_nodes, block, hash, kids).

    ``n_nodes`` counts the nodes of a key in this round; a level is only there
    while several nodes remain of them.
    """
    digits = [f"d{level}" for level in range(DEPTH)]
    here = nodes.select(
        *key, "n_nodes", F.shiftright("place", FAN_BITS * DEPTH).alias("block"),
        *[F.shiftright("place", FAN_BITS * i).bitwiseAND(F.lit(FAN - 1)).cast("int").alias(d)
          for i, d in enumerate(digits)], "hash", F.col("item").alias("inner"))
    here = here.repartition(*key, "block")  # at most 512 rows of a key and block
    for level, digit in enumerate(digits):
        left = [*key, "n_nodes", "block", *digits[level + 1:]]
        kids = F.sort_array(F.collect_list(F.struct(digit, "hash", "inner")))
        joined = F.array_join(F.col("inner")["hash"], "")
        here = (here.groupBy(*left).agg(kids.alias("inner"))
                .select(*left, F.when(F.col("n_nodes") > FAN ** level, digest(joined))
                        .otherwise(F.col("inner")[0]["hash"]).alias("hash"), "inner"))
    return here.withColumnRenamed("inner", "kids")


def emit(blocks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Blocks with the ``path`` above them to (*key, item, path) of every node.

    A path lists, from the node up, the digests left and right of it in its run.
    """
    here = blocks.select(*key, "n_nodes", "path", F.col("kids").alias("inner"))
    for level in reversed(range(DEPTH)):
        hashes = F.col("inner")["hash"]

        def split(kid: Column, i: Column) -> Column:
            left = F.array_join(F.slice(hashes, F.lit(1), i), "")
            right = F.array_join(F.slice(hashes, i + 2, F.size(hashes)), "")
            return F.struct(kid["inner"].alias("inner"), left.alias("left"), right.alias("right"))

        step = F.array(F.struct(F.col("k.left").alias("left"), F.col("k.right").alias("right")))
        here = (here.withColumn("k", F.explode(F.transform("inner", split)))
                .select(*key, "n_nodes",
                        F.when(F.col("n_nodes") > FAN ** level, F.concat(step, "path"))
                        .otherwise(F.col("path")).alias("path"), F.col("k.inner").alias("inner")))
    return here.select(*key, F.col("inner").alias("item"), "path")


class Forest:
    """One tree for every key, rolled up in rounds of blocks.

    ``nodes`` has the key, ``place`` from 0, ``hash`` and ``item``, any struct.
    """

    def __init__(self, nodes: DataFrame, key: Sequence[str]):
        self.key = list(key)
        sizes = nodes.groupBy(*self.key).agg(F.count("*").alias("n_nodes"))
        sizes = written(sizes, "tree-sizes")
        here = matched(nodes, sizes, self.key, BROADCAST_PATHS)
        left = (sizes.agg(F.max("n_nodes")).first()[0]) or 0
        self.rounds = [written(roll_up(here, self.key), "merkle-blocks")]
        while left > BLOCK:
            left = -(-left // BLOCK)
            last = self.rounds[-1]
            above = last.select(*self.key, F.col("block").alias("place"),
                                F.expr(f"(n_nodes + {BLOCK - 1}) div {BLOCK}").alias("n_nodes"),
                                "hash", F.struct("block").alias("item"))
            self.rounds.append(written(roll_up(above, self.key), "merkle-blocks"))

    def roots(self) -> DataFrame:
        """(*key, hash): what remains of every tree."""
        return self.rounds[-1].select(*self.key, "hash")

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """(*key, item, path, *others) of every leaf; ``above`` has the key, the
        ``path`` over its root and other columns, one row a key."""
        if above is None:
            above = self.roots().select(*self.key, F.expr(
                "cast(array() as array<struct<left: string, right: string>>)").alias("path"))
        others = [c for c in above.columns if c not in (*self.key, "path")]
        if others:
            above = above.select(*self.key, "path", F.struct(*others).alias("others"))
        else:
            above = above.select(*self.key, "path", F.lit(True).alias("others"))
        above = above.withColumn("block", F.lit(0).cast("long"))
        for n, blocks in enumerate(reversed(self.rounds)):
            met = matched(blocks.drop("hash"), above, [*self.key, "block"], BROADCAST_PATHS)
            out = emit(met, [*self.key, "others"])
            if n + 1 < len(self.rounds):
                above = written(out.select(*self.key, "path", "others",
                                           F.col("item.block").alias("block")), "paths")
        kept = out.select(*self.key, "item", "path", "others")
        return kept.select(*self.key, "item", "path", "others.*") if others else kept.drop("others")


def folded(path: Column, start: Column) -> Column:
    """The root that a digest and the siblings on its path give."""
    return F.aggregate(path, start, lambda acc, p: digest(F.concat(p["left"], acc, p["right"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on a path, from the leaf up, left to right."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id",
             group: str = "lang", altered: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, group, leaf, altered_leaf, subroot, root, path) of every row.

    ``altered`` gives other values of some fields, for the leaf they would have
    (null where it is the same).
    """
    altered = altered or {}
    leaf = leaf_digest([F.col(f) for f in fields])
    other = leaf_digest([altered.get(f, F.col(f)) for f in fields]) if altered else F.lit(None)
    changed = F.lit(False)
    for f, c in altered.items():
        changed = changed | ~c.eqNullSafe(F.col(f))
    leaves = written(docs.select(
        F.col(doc_id).alias("id"), F.col(group).alias("grp"), leaf.alias("hash"),
        F.when(changed, other).cast("string").alias("other")), "leaves")
    placed = ranked(leaves, ["id", "hash"], within=["grp"])
    placed = written(placed.select("grp", "place", "hash", F.struct("id", "hash", "other")
                                   .alias("item")), "places")
    trees = Forest(placed, ["grp"])
    subroots = written(trees.roots(), "subroots")
    tops = ranked(subroots, ["grp"]).select(
        F.lit(0).alias("all"), "place", "hash", F.struct("grp", "hash").alias("item"))
    crown = Forest(tops, ["all"])
    root = crown.roots().select("all", F.col("hash").alias("root"))  # one row
    empty = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    paths = crown.proofs(root.select("all", empty.alias("path"), "root"))
    above = written(paths.select(F.col("item.grp").alias("grp"), "path",
                                 F.col("item.hash").alias("subroot"), "root"), "subroot-paths")
    return trees.proofs(above).select(
        F.col("item.id").alias("doc_id"), F.col("grp").alias("group"),
        F.col("item.hash").alias("leaf"), F.col("item.other").alias("altered_leaf"),
        "subroot", "root", "path")


def verified_manifest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The manifest, and whether each row still folds to the root after tampering.

    Rows whose id has a checksum divisible by three get their text lower-cased.
    """
    hit = F.crc32(F.col(doc_id).cast("string")) % 3 == 0
    rows = manifest(docs, altered={text: F.when(hit, lowered(F.col(text))).otherwise(F.col(text))},
                    doc_id=doc_id)
    again = folded(F.col("path"), F.coalesce("altered_leaf", "leaf"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
