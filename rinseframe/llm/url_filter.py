"""URL rules through a blocked Bloom filter and an exact hash join, in DataFrame functions.

A rule is a canonical URL (lower-case host, path) with a verdict. It fits its host and all
subdomains where the URL's path starts with the rule's; the longest rule wins. The filter
holds every listed host and every listed URL: 256-bit blocks, four bits of one block to a
key, a table of at most ``MOST_BLOCKS`` rows, so it can go to every task. A URL's host
suffixes that the filter lets through meet the listed hosts, then the path prefixes of the
lengths listed there that it lets through meet the rules; these joins are exact and take
false positives out. With more rules than the filter is made for more keys pass, and the
result is the same. Each distinct URL is looked up once.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no
rule; a rule with a null or empty host fits nothing, a null path is empty; of rules with
equal host and path the smallest verdict counts; an empty table stays empty; input columns
named like an added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinseframe.llm.frames import Scratch, fresh, without

#: 256 bits and a number each: 10 MB at most
MOST_BLOCKS = 1 << 18
#: keys to a block, where the limit allows: 16 bits to a key
KEYS_IN_BLOCK = 16
WORDS = [f"word_{i}" for i in range(4)]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bit_of(key: Column, word: int) -> Column:
    """One bit of a block's word, from other bits of the key than its block."""
    place = F.shiftright(F.xxhash64(key, F.lit("bits")), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def filter_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The blocked Bloom filter of a ``key`` column: (block, four words)."""
    bits = keys.select(block_of(F.col("key"), blocks).alias("block"), *[bit_of(F.col("key"), i).alias(w) for i, w in enumerate(WORDS)])
    return bits.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def passing(df: DataFrame, key: Column, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be in the filter. The filter's size is bounded, so every task gets it."""
    hit = F.col("block") == block_of(key, blocks)
    for i, w in enumerate(WORDS):
        hit = hit & (F.col(w).bitwiseAND(bit_of(key, i)) == bit_of(key, i))
    return df.join(F.broadcast(bloom), hit, "left_semi")


def host_key(host: str) -> Column:
    return F.xxhash64(F.lit("host"), F.col(host))


def rule_key(host: str, path: str) -> Column:
    return F.xxhash64(F.lit("rule"), F.col(host), F.col(path))


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for the (host, path) rows that a rule fits.

    ``urls`` has distinct rows; ``rules`` has rule_host, rule_path and verdict.
    """
    scratch = Scratch(urls.sparkSession)
    listed = rules.where("rule_host <> ''").withColumn("rule_path", F.coalesce("rule_path", F.lit("")))
    listed = scratch.stored(listed.groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict")), "rules")
    hosts = listed.groupBy("rule_host").agg(F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"))
    hosts = scratch.stored(hosts, "hosts")
    keys = listed.select(rule_key("rule_host", "rule_path").alias("key")).union(hosts.select(host_key("rule_host").alias("key")))
    blocks = max(1, min(MOST_BLOCKS, -(-2 * listed.count() // KEYS_IN_BLOCK)))
    bloom = scratch.stored(filter_blocks(keys, blocks), "bloom")
    depths = [r[0] for r in hosts.select(F.size(F.split("rule_host", "\\.")).alias("depth")).distinct().collect()]

    labels = F.split("host", "\\.")
    deep = F.size(labels)
    suffixes = [F.when(deep >= d, F.array_join(F.slice(labels, deep - d + 1, F.lit(d)), ".")) for d in sorted(depths)]
    tails = urls.select("host", "path", F.explode(F.array_compact(F.array(*suffixes)) if suffixes else F.array().cast("array<string>")).alias("rule_host"))
    near = passing(tails, host_key("rule_host"), bloom, blocks).join(hosts, "rule_host")
    longest = F.length("path")
    heads = near.select("host", "path", "rule_host", F.explode(F.filter("lengths", lambda n: n <= longest)).alias("length"))
    heads = heads.withColumn("rule_path", F.expr("left(path, length)")).drop("length")
    hits = passing(heads, rule_key("rule_host", "rule_path"), bloom, blocks).join(listed, ["rule_host", "rule_path"])
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule_host", "rule_path", "verdict"), rank).alias("best"))
    return best.select("host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), "best.verdict")


def judge_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (host and path, or null) and ``verdict``; unlisted URLs get ``otherwise``."""
    df = without(df, "host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(f"`{url_col}`"))
    parted = df.withColumns({"host": host, "path": path})
    names = {c: fresh(parted, f"best_{c}") for c in ("host", "path")}
    best = best_rules(parted.where("host <> ''").select("host", "path").distinct(), rules)
    best = best.withColumnsRenamed(names)
    same = (F.col("host") == F.col(names["host"])) & (F.col("path") == F.col(names["path"]))
    columns = [*df.columns, "host", "path", "rule"]
    judged = parted.join(best, same, "left")
    return judged.select(*[F.col(f"`{c}`") for c in columns], F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
