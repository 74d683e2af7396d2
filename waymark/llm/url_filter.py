"""URL rules: a blocked Bloom filter of listed canonical URLs, then an exact hash join of the possible hits."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY = 20
PROBES = 5
MAX_BLOCKS = 1 << 20  # 8 MB: the bound of what is broadcast


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Canonical host (A-Z lower-cased) and path of a URL; both are empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    cut = F.coalesce(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit(""))
    slash = F.instr(cut, "/")
    host = F.when(slash > 0, F.substr(cut, F.lit(1), slash - 1)).otherwise(cut)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.when(slash > 0, F.substr(cut, slash)).otherwise(F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(key, 20), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """The bits the key sets in its block, a word of 64 bits."""
    second = F.xxhash64(key, F.lit(7))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
            for k in range(PROBES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the filter of the column `key`. At most `blocks` rows, whatever the number of keys."""
    return (keys.select(_block(F.col("key"), blocks).alias("block"), _mask(F.col("key")).alias("bits"))
            .groupBy("block").agg(F.bit_or("bits").alias("bits")))


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow",
                broadcast_rules: int = 100_000) -> DataFrame:
    """(key, host, path, rule, verdict, maybe): the longest rule (host, path, verdict) that fits each URL.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path. Candidates of a URL are its host
    suffixes with its path's prefixes of the lengths that occur among the rules; those the filter passes meet the rules in an
    exact join. `maybe` counts what the filter passed. Of two rules with the same host and path the block wins. Null and
    malformed URLs have empty host and path, and the default verdict; repeated and null keys keep one row each; no rules:
    everything gets the default. Other columns of pages are not read. The filter is broadcast (its blocks are bounded), the
    rules only while they are fewer than `broadcast_rules`.
    """
    rules = (rules.select(F.lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    listed = rules.select("verdict", F.concat("host", "path").alias("rule"), _key(F.col("host"), F.col("path")).alias("key"),
                          F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    facts = rules.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    blocks = min(MAX_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, facts["n"] * BITS_A_KEY / 64)))))
    bloom = blocked_bloom(listed, blocks)

    host, path = host_and_path(F.col(url))
    canon = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(key), host.alias("host"), path.alias("path"))
    labels = F.split(F.col("host"), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(n) for n in facts["lengths"]]).cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    # each URL's candidates are few (labels x distinct rule lengths); the distinct (host, path) pairs are judged once
    distinct = canon.where("host <> ''").select("host", "path").distinct()
    tried = (distinct.select("host", "path", F.explode(suffixes).alias("h"), prefixes.alias("ps"))
             .select("host", "path", "h", F.explode("ps").alias("p"))
             .withColumn("key", _key(F.col("h"), F.col("p"))))
    tried = tried.withColumn("block", _block(F.col("key"), blocks))
    tried = tried.withColumn("mask", _mask(F.col("key")))
    passed = tried.join(F.broadcast(bloom), "block").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("host", "path", "h", "p", "key")
    table = F.broadcast(listed) if facts["n"] <= broadcast_rules else listed
    exact = passed.join(table, "key", "left").withColumn("true", (F.col("h") == F.col("rule_host")) & (F.col("p") == F.col("rule_path")))
    best = (exact.groupBy("host", "path").agg(
        F.count("*").alias("maybe"),
        F.max(F.when(F.col("true"), F.struct(F.length("rule").alias("n"), F.length("h").alias("m"), F.col("rule"), F.col("verdict"))))
        .alias("best")))
    salted = canon.withColumn("_salt", F.pmod(F.col("_row"), F.lit(16)))
    copies = best.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>")))
    return (salted.join(copies, ["host", "path", "_salt"], "left")
            .select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
                    F.coalesce("maybe", F.lit(0)).alias("maybe")))
