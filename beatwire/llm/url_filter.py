"""URL rules matched by hashed host suffixes and path prefixes.

A rule (host, path, verdict) fits its host and all subdomains where the path of
the URL starts with the rule's. Every URL is expanded into the expressions
"host suffix ? path prefix", only in the numbers of labels and characters that
occur among the rules. Expressions and rules meet in an equi-join on the first
32 bits of their SHA-256; the full digest confirms. The longest rule wins, then
the one with the longer host, then block.

How many expressions a URL has depends on how many lengths the rules have, not
on how many rules there are. The rules are an ordinary side of the join: Spark
broadcasts them if they are small and shuffles otherwise.

Defined cases: a null URL, or one without "://", has an empty host and path and
no rule; repeated rows come back as often as they came; null ids are kept;
rules with a null or empty host are ignored; equal rules with different
verdicts block; an empty table gives an empty result, no rules give the
default; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwire.llm.rows import repeated

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX_HEX = 8  # 32 bits
DEFAULT = "allow"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where there is no "://"."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return (lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("?"), path)  # no host and no path holds this character


def hashed_rules(rules: DataFrame) -> DataFrame:
    """(prefix, entries): the rules of every hash prefix, one for each host and path."""
    host = lower_ascii(F.col("host"))
    path = F.coalesce("path", F.lit(""))
    entry = F.struct("digest", "rank_length", "host_length", "blocks", "rule", "verdict")
    return (rules.where("host is not null and host <> ''")
            .select(host.alias("host"), path.alias("path"), "verdict")
            .groupBy("host", "path").agg(F.max((F.col("verdict") == "block").cast("int"))
                                         .alias("blocks"))
            .select(F.sha2(expression(F.col("host"), F.col("path")), 256).alias("digest"),
                    (F.length("host") + F.length("path")).alias("rank_length"),
                    F.length("host").alias("host_length"), "blocks",
                    F.concat("host", "path").alias("rule"),
                    F.when(F.col("blocks") == 1, "block").otherwise("allow").alias("verdict"))
            .groupBy(F.substring("digest", 1, PREFIX_HEX).alias("prefix"))
            .agg(F.collect_list(entry).alias("entries")))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Digests of all host suffixes of so many labels with path prefixes of such lengths."""
    parts = F.split(host, r"\.")
    hosts = F.transform(F.filter(F.array(*map(F.lit, labels)), lambda k: k <= F.size(parts)),
                        lambda k: F.array_join(F.slice(parts, -k, k), "."))
    paths = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)),
                        lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(hosts, lambda h: F.transform(
        paths, lambda p: F.sha2(expression(h, p), 256))))


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
                default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages``."""
    # distinct lengths: bounded by the longest rule, however many rules there are
    shape = rules.where("host is not null and host <> ''").agg(
        F.collect_set(F.size(F.split("host", r"\."))),
        F.collect_set(F.length(F.coalesce("path", F.lit(""))))).first()
    labels, lengths = sorted(shape[0]) or [1], sorted(shape[1]) or [0]
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    # rows are counted at their first expression, or where they have none
    asked = rows.select("page_id", "host", "path", F.posexplode_outer(
        expressions(F.col("host"), F.col("path"), labels, lengths)).alias("pos", "digest"))
    met = (asked.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
           .join(hashed_rules(rules), "prefix", "left"))
    confirmed = F.array_max(F.transform(
        F.filter("entries", lambda e: e["digest"] == F.col("digest")),
        lambda e: F.struct(e["rank_length"], e["host_length"], e["blocks"], e["rule"],
                           e["verdict"])))
    best = (met.select("page_id", "host", "path", "pos", confirmed.alias("hit"))
            .groupBy("page_id", "host", "path")
            .agg(F.max("hit").alias("hit"),
                 F.count(F.when(F.coalesce("pos", F.lit(0)) == 0, 1)).alias("m")))
    return repeated(best, "m").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
