"""Near-duplicates: MinHash with banding, verification and components.

A text is the set of its distinct 5-word shingles. Equal sets are one class,
named by its smallest id; all further work is on classes.

1. 192 universal hash minima a class, in 48 bands of 4. Two sets of similarity
   0.75 miss each other in every band with a chance of 1.2e-8.
2. Members of a bucket are paired with the bucket's smallest member, not with
   each other. Pairs pass a signature check (8 bits a minimum, at least 55%
   equal; six standard deviations below 0.75) and are then confirmed on the
   full sets.
3. Confirmed links give components. A bucket whose members all lie in one
   component is done. Members of the others are searched for further links by
   an exact join: shingles are ordered by how many of these sets have them,
   rarest first; two similar sets share a shingle in a short prefix of either,
   at a place that still leaves enough shingles to share. Shingles of one set
   only join with nothing, so a text with many words of its own drops out. Sets
   meet components, not their members, and a component of more than ``FEW``
   members is compared block by block; pairs within a group are never listed.

Hot groups: classes are built by (set, salt) before they are built by set, and
results go back to the rows by (set, salt). Buckets are aggregated before the
shuffle, and joins with them can be split by adaptive execution.

Defined cases: null and empty texts have an empty set and no links; a text
with fewer than five words is one shingle; a row without an id is linked with
nothing and named null; repeated rows lie in one component; rows that share an
id but not the text are documents of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatwire.llm.components import connected_components
from beatwire.session import written

WORDS = 5
BANDS, ROWS = 48, 4
HASHES = BANDS * ROWS
SEED = 20240229
SALTS = 64
# Share of equal 8-bit minima below which a pair cannot reach 0.75 (six sigma).
SCREEN = 0.55
THRESHOLD = (75, 100)  # intersection over union, in whole numbers
BLOCK = 1 << 17  # shingles of either side that a task compares at a time (1 MB)
FEW = 8  # members of a component up to which pairs are listed
BROADCAST_IDS = 1_000_000  # ids (8 MB) that are broadcast; beyond, the join shuffles
REMEMBERED = 100_000  # word hashes a worker keeps; emptied when full
LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_WORD_HASH: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _word_hashes(words: Sequence[bytes]) -> np.ndarray:
    if len(_WORD_HASH) > REMEMBERED:
        _WORD_HASH.clear()
    known = _WORD_HASH
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.array([known[w] for w in words], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        whole = b"\x00".join([b"%d" % len(words), *words])
        return np.array([xxhash.xxh3_64_intdigest(whole)], np.uint64)
    h = _word_hashes(words)
    n = len(h) - WORDS + 1
    out = np.zeros(n, np.uint64)
    for k in range(WORDS):
        out = _mix(out * np.uint64(31) + h[k:n + k] + np.uint64(k + 1))
    return np.unique(out)


_RNG = np.random.default_rng(SEED)
_A = (_RNG.integers(0, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) + np.uint64(1)
_B = _RNG.integers(0, 2**64, HASHES, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of (a x + b mod 2^64) / 2^32 under every hash."""
    out = np.full(HASHES, 2**32 - 1, np.uint64)
    for start in range(0, len(shingles), 512):
        part = shingles[start:start + 512]
        values = _A[:, None] * part[None, :]
        values += _B[:, None]
        np.minimum(out, values.min(axis=1) >> np.uint64(32), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, different for different bands."""
    rows = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


SIGNED = "n long, same binary, sig binary, keys array<long>"


def _sign(text: str | None) -> tuple:
    s = shingle_set(text)
    if not len(s):
        return 0, None, None, None
    low = minima(s)
    return (len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
            low.astype(np.uint8).tobytes(), band_keys(low))


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, salt, n, same, sig, keys): set size, set digest, signature, band keys."""
    @F.pandas_udf(SIGNED)
    def sign(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_sign(t) for t in texts], columns=["n", "same", "sig", "keys"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), sign(F.col(text)).alias("s"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    return rows.select("doc_id", salt.alias("salt"), "s.*")


def _classes(signed: DataFrame) -> DataFrame:
    """(same, rep, salts): classes of equal sets."""
    by_salt = (signed.where("same is not null and doc_id is not null")
               .groupBy("same", "salt").agg(F.min("doc_id").alias("rep")))
    return by_salt.groupBy("same").agg(F.min("rep").alias("rep"),
                                       F.collect_set("salt").alias("salts"))


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    least = int(SCREEN * HASHES)
    return pd.Series([(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum() >= least
                      for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64),
                                         assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _set_array(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).view(np.int64) for t in texts], dtype=object)


@F.pandas_udf(T.BinaryType())
def _set_bytes(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).tobytes() for t in texts], dtype=object)


class _Verifier:
    """Exact similarity of pairs of class representatives."""

    def __init__(self, docs: DataFrame, reps: DataFrame, doc_id: str, text: str):
        self.texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        self.sigs = reps.select(F.col("rep").alias("id"), "sig")

    def similarities(self, pairs: DataFrame) -> DataFrame:
        """(a, b, j) of the pairs that pass the signature check."""
        a, b = (self.sigs.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"))
                for x in "ab")
        near = written(pairs.join(b, "b").join(a, "a").where(_alike("sig_a", "sig_b"))
                       .select("a", "b").distinct(), "screened")
        ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        if near.count() <= BROADCAST_IDS // 2:
            ids = F.broadcast(ids)
        sets = written(self.texts.join(ids, "id", "left_semi")
                       .select("id", _set_bytes("text").alias("set")).distinct(), "sets")
        a, b = (sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
        both = (near.join(b, "b").join(a, "a")
                .select("a", "b", (F.length("set_a") / 8).cast("long").alias("n_a"),
                        (F.length("set_b") / 8).cast("long").alias("n_b"),
                        _common("set_a", "set_b").alias("c")))
        union = F.col("n_a") + F.col("n_b") - F.col("c")
        return written(both.select(
            "a", "b", (F.col("c") / union).alias("j"),
            (THRESHOLD[1] * F.col("c") >= THRESHOLD[0] * union).alias("link")), "similarities")


def _open_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, component, s, n): shingles of the wanted texts, kept as a table."""
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return written(texts.join(wanted, "id").select("id", "component", _set_array("text").alias("s"))
                   .distinct().withColumn("n", F.size("s")), "open-sets")


def _prefixes(sets: DataFrame) -> DataFrame:
    """(x, id, component, n, at): shingles of the prefix that a similar set must share.

    ``at`` counts the rarer shingles of the set, those of no other set included.
    """
    items = sets.select("id", "component", "n", F.explode("s").alias("x"))
    shared = items.groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
    # at most one set's shingles in a row
    rare = (items.join(shared, "x").groupBy("id", "component", "n")
            .agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("rare")))
    share, whole = THRESHOLD
    length = F.col("n") - F.ceil(F.col("n") * share / whole).cast("int") + 1
    own = F.col("n") - F.size("rare")
    return (rare.withColumn("own", own).where(length > own)
            .select("id", "component", "n", "own",
                    F.posexplode(F.slice("rare", F.lit(1), length - own)).alias("k", "r"))
            .select(F.col("r.x").alias("x"), "id", "component", "n",
                    (F.col("k") + F.col("own")).alias("at")))


def _missing(prefixes: DataFrame) -> DataFrame:
    """(id, n, target): sets, and other components that may hold a set like them.

    A pair need share more than ``share / (share + whole)`` of both sizes, and
    can share at most what follows its first common shingle in either order.
    Of a component only the bounds of its members are looked at.
    """
    share, whole = THRESHOLD
    parts = prefixes.groupBy("x", "component").agg(
        F.count("*").alias("c"), F.min("n").alias("least_n"), F.max("n").alias("most_n"),
        F.max(F.col("n") - F.col("at")).alias("left"))
    heads = (parts.groupBy("x")
             .agg(F.max_by("component", F.struct("c", "component")).alias("major"),
                  F.count("*").alias("several")).where("several > 1").select("x", "major"))
    minor = prefixes.join(heads, "x").where("component <> major").alias("p")
    return (minor.join(parts.alias("q"), "x")
            .where("p.component <> q.component and (q.component = p.major "
                   "or p.component < q.component) "
                   f"and {whole} * q.most_n >= {share} * p.n and {whole} * p.n >= {share} * q.least_n "
                   f"and {share + whole} * least(p.n - p.at, q.left) >= {share} * (p.n + q.least_n)")
            .select("p.id", "p.n", F.col("q.component").alias("target")).distinct())


def _block_links(queries: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    """For every query set one of the target sets it is linked with, if there is any."""
    found = []
    if len(queries) and len(targets):
        sizes = np.array([len(s) for s in targets["s"]])
        tokens, owners = np.concatenate(targets["s"].tolist()), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], owners[order]
        share, whole = THRESHOLD
        for key, s in zip(queries["id"], queries["s"]):
            first, last = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
            many = last - first
            at = np.repeat(last - many.cumsum(), many) + np.arange(many.sum())
            common = np.bincount(owners[at], minlength=len(sizes))
            linked = np.flatnonzero(whole * common >= share * (len(s) + sizes - common))
            if len(linked):
                found.append((key, targets["id"].iloc[linked[0]]))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _links_in_blocks(sets: DataFrame, missing: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links (a, b) of sets with large components, exact; no pair is listed.

    Members of a component and the sets that ask for it are cut into blocks of
    so many shingles; a task compares one block of either, and reports a link a
    set at most. ``sizes`` has (component, shingles).
    """
    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / BLOCK).cast("int")

    asked = missing.join(sizes.withColumnRenamed("component", "target"), "target")
    counts = asked.groupBy("target", "shingles").agg(F.sum("n").alias("asking"))
    block = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    members = (sets.withColumnRenamed("component", "target").join(counts, "target")
               .select("target", "id", "s", block("shingles").alias("y"), "asking")
               .select("target", "id", "s", "y", every("asking").alias("x")))
    queries = (missing.drop("n").join(counts, "target").join(sets.select("id", "s"), "id")
               .select("target", "id", "s", block("asking").alias("x"), "shingles")
               .select("target", "id", "s", "x", every("shingles").alias("y")))
    keys = ["target", "x", "y"]
    # both sides hold columns of the same tables: name one side's anew
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]).toDF(
        *queries.columns)
    return (queries.groupBy(*keys).cogroup(members.groupBy(*keys))
            .applyInPandas(_block_links, "a long, b long"))


def _more_links(verifier: _Verifier, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components: by pairs with small ones, in blocks with large ones."""
    missing = written(_missing(_prefixes(sets)), "missing")
    sizes = written(sets.groupBy("component").agg(
        F.count("*").alias("size"), F.sum("n").alias("shingles")), "open-sizes")
    few = sizes.where(F.col("size") <= FEW).select(F.col("component").alias("target"))
    members = sets.select(F.col("component").alias("target"), F.col("id").alias("other"))
    pairs = (missing.join(few, "target").join(members, "target")
             .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
             .distinct())
    by_pairs = verifier.similarities(pairs).where("link").select("a", "b")
    large = sizes.where(F.col("size") > FEW).select("component", "shingles")
    return by_pairs.unionByName(written(_links_in_blocks(sets, missing, large), "block-links"))


def _open_members(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, component) of the members of buckets of more than one component."""
    named = (buckets.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
             .withColumn("component", F.coalesce("component", "rep")))
    # of two members both were compared: one of them is the hub
    mixed = (named.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"),
                                      F.count("*").alias("n"))
             .where("c1 <> c2 and n > 2").select("key"))
    return named.join(mixed, "key", "left_semi").select(F.col("rep").alias("id"),
                                                        "component").distinct()


def link_classes(docs: DataFrame, reps: DataFrame, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(node, component) of all classes that have a link.

    ``reps`` has (rep, sig, keys). Pairs inside a component that is found
    already are not all looked at.
    """
    verifier = _Verifier(docs, reps, doc_id, text)
    bands = reps.select("rep", F.explode("keys").alias("key"))
    shared = (bands.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"))
              .where("hub < last").select("key", "hub"))
    buckets = written(bands.join(shared, "key"), "buckets")
    stars = (buckets.where("rep > hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
             .distinct())
    comps = written(connected_components(verifier.similarities(stars).where("link")), "components")
    members = written(_open_members(buckets, comps), "open-members")
    more = _more_links(verifier, _open_sets(docs, members, doc_id, text))
    if more.isEmpty():
        return comps
    # the components are the nodes of the second round
    named = members.withColumnRenamed("component", "c")
    a, b = (named.select(F.col("id").alias(x), F.col("c").alias(f"c_{x}")) for x in "ab")
    joined = connected_components(more.join(a, "a").join(b, "b")
                                  .select(F.col("c_a").alias("a"), F.col("c_b").alias("b")))
    alone = joined.select("node", F.col("node").alias("component"))
    return (comps.unionByName(alone).distinct()
            .join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")),
                  "component", "left")
            .select("node", F.coalesce("to", "component").alias("component")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    signed = written(signatures(docs, doc_id, text), "signatures")
    classes = written(_classes(signed), "classes")
    reps = written(signed.join(classes.select("same", F.col("rep").alias("doc_id")),
                               ["same", "doc_id"])
                   .dropDuplicates(["same", "doc_id"])
                   .select(F.col("doc_id").alias("rep"), "sig", "keys"), "representatives")
    comps = link_classes(docs, reps, doc_id, text)
    named = (classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
             .withColumn("component", F.coalesce("component", "rep")))
    places = named.select("same", F.explode("salts").alias("salt"), "component")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (signed.select("doc_id", "salt", "n", "same").join(places, ["same", "salt"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """One document of every component, all columns kept; ids must be unique."""
    gone = (near_duplicates(docs, doc_id, text).where("not kept")
            .select(F.col("doc_id").alias("__gone")).distinct())
    gone = written(gone, "near-copies")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")
