"""URL rules behind a blocked Bloom filter.

A rule is a canonical URL part (host, path): it fits its host and all subdomains
where the path starts with the rule's; the longest rule wins. The keys that a URL
could be listed under are its host's endings and its path's beginnings, of the
lengths that occur in the list. A blocked Bloom filter (512-bit blocks, so one key
touches one block) passes the listed keys and a few others on to an exact join
with the rules, which removes the false positives.

The filter never outgrows MAX_WORDS: a longer list only makes it pass more keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.textstats import free_name
from alertloom.storage import fits, materialise

BLOCK_WORDS = 8  # 64-bit words of a block
KEY_BITS = 7  # bits that a key sets in its block
BITS_PER_KEY = 16
MAX_WORDS = 1 << 22  # 32 MB

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hashes(host: Column, path: Column) -> tuple[Column, Column]:
    return F.xxhash64(host, path), F.xxhash64(path, host)


class BlockedBloom:
    """A Bloom filter whose keys each set bits of one block only."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def blocks_for(keys: int) -> int:
        words = max(BLOCK_WORDS, -(-keys * BITS_PER_KEY // 64))
        return min(1 << (words - 1).bit_length(), MAX_WORDS) // BLOCK_WORDS

    @classmethod
    def of(cls, keys: DataFrame, first: Column, second: Column, count: int) -> BlockedBloom:
        """Words are combined on the executors; the driver gets one row per word set."""
        blocks = cls.blocks_for(count)
        bits = F.explode(F.array(*[F.shiftrightunsigned("b", 9 * k).bitwiseAND(F.lit(511)) for k in range(KEY_BITS)]))
        rows = keys.select(F.pmod(first, F.lit(blocks)).alias("block"), second.alias("b")).select("block", bits.alias("bit"))
        rows = rows.select((F.col("block") * BLOCK_WORDS + F.floor(F.col("bit") / 64)).alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("mask"))
        words = np.zeros(blocks * BLOCK_WORDS, np.int64)
        for row in rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
            words[row["word"]] = row["mask"]
        return cls(words)

    def passes(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        block = np.mod(first, len(self.words) // BLOCK_WORDS) * BLOCK_WORDS
        number, out = second.view(np.uint64), np.ones(len(first), bool)
        for k in range(KEY_BITS):
            bit = (number >> np.uint64(9 * k)).astype(np.int64) & 511
            out &= (self.words[block + (bit >> 6)] >> (bit & 63)) & 1 == 1
        return out


def possible_keys(urls: DataFrame, labels: int, lengths: list[int]) -> DataFrame:
    """(url, key_host, key_path): each host ending of up to `labels` labels with each path beginning of a listed length."""
    count = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    ends = urls.withColumn("j", F.explode(F.sequence(F.lit(1), F.least(count, F.lit(labels)))))
    ends = ends.withColumn("key_host", F.expr("substring_index(host, '.', -j)"))
    fit = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    return ends.withColumn("n", F.explode(fit)).select("url", "key_host", F.expr("left(path, n)").alias("key_path"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; columns of those names are replaced.

    rules: host, path, verdict (allow or block). A rule that is listed twice blocks
    if any of its rows does; rules with a null part are void; equally long rules go
    by their text. A URL that no rule fits gets `default` and a null rule, as do
    null URLs and those without ://. Repeated rows and ids are judged each.
    """
    listed = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    listed = listed.select(F.col("host").alias("key_host"), F.col("path").alias("key_path"), F.col("verdict").alias("listed_verdict"))
    dots = F.length("key_host") - F.length(F.replace("key_host", F.lit("."), F.lit("")))
    sizes = listed.agg(F.count(F.lit(1)).alias("n"), F.max(dots).alias("dots"), F.collect_set(F.length("key_path")).alias("lengths")).first()
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    if not sizes["n"]:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    bloom = pages.sparkSession.sparkContext.broadcast(BlockedBloom.of(listed, *_hashes(F.col("key_host"), F.col("key_path")), sizes["n"]).words)

    @F.pandas_udf("boolean")
    def may_be_listed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        bloom_filter = BlockedBloom(bloom.value)
        for first, second in parts:
            yield pd.Series(bloom_filter.passes(first.to_numpy(np.int64), second.to_numpy(np.int64)))

    # Equal URLs are looked up once, so a URL on many rows is no hot key here.
    urls = pages.select(F.col(url_col).alias("url")).where(F.col("url").contains("://")).distinct()
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    keys = possible_keys(urls, sizes["dots"] + 1, sorted(sizes["lengths"]))
    hits = keys.where(may_be_listed(*_hashes(F.col("key_host"), F.col("key_path"))))
    exact = hits.join(F.broadcast(listed) if fits(listed) else listed, ["key_host", "key_path"])
    rule = F.concat("key_host", "key_path")
    best = exact.groupBy("url").agg(F.max(F.struct(F.length(rule), rule.alias("rule"), F.col("listed_verdict").alias("verdict"))).alias("best"))
    key = free_name("judged_url", out.columns)
    judged = materialise(best.select(F.col("url").alias(key), "best.rule", "best.verdict"), "judged-urls")
    joined = out.join(judged, out[url_col] == judged[key], "left").drop(key)
    return joined.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
