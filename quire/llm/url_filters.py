"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table: a block is four 64-bit words, and each listed URL sets two bits in each word of the
one block its hash picks. Blocks are built by bit_or, which tasks pre-aggregate. Pages look up their block
and only possible hits go on to the exact hash join with the list, which removes the false positives. A
filter of up to FILTER_BYTES, counted before, is broadcast: then no page is shuffled but the possible hits.
A larger one meets the pages in a shuffled join by block.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, UPPER, written

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
WORDS = 4
#: Bytes of a filter that is still broadcast: a list of some 30 million URLs.
FILTER_BYTES = 1 << 26


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www. or m., path without the last slash or .html; no scheme, query or fragment."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""))


def rule_verdict(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits; null if none does."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    return reduce(lambda rest, r: F.when(fits(r[1], r[2]), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))).otherwise(rest), reversed(longest), F.lit(None).cast("struct<rule:string,verdict:string>"))


def _bits(key: Column) -> list[Column]:
    """For each word of the block two bits of a second hash."""
    h = F.xxhash64(F.lit(7), key)
    one = F.lit(1).cast("long")
    at = lambda k: F.pmod(F.shiftrightunsigned(h, 6 * k), F.lit(64)).cast("int")
    return [F.call_function("shiftleft", one, at(2 * w)).bitwiseOR(F.call_function("shiftleft", one, at(2 * w + 1))) for w in range(WORDS)]


def maybe_listed(rows: DataFrame, listed: DataFrame, bits_per_key: int = 16, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """rows (key) with maybe: whether the filter of listed (key, distinct) lets the key pass; a null key never does."""
    blocks = max(1, -(-listed.count() * bits_per_key // (64 * WORDS)))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks))
    bloom = listed.groupBy(block.alias("_block")).agg(*[F.bit_or(b).alias(f"_w{w}") for w, b in enumerate(_bits(F.col("key")))])
    bloom = F.broadcast(bloom) if blocks * 8 * (WORDS + 1) <= filter_bytes else bloom  # size checked
    spread = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))  # rows that look nothing up, over many tasks
    hit = reduce(lambda a, b: a & b, [F.col(f"_w{w}").bitwiseAND(b) == b for w, b in enumerate(_bits(F.col("key")))])
    found = rows.withColumn("_block", F.when(F.col("key").isNull(), spread).otherwise(block)).join(bloom, "_block", "left")
    return found.withColumn("maybe", F.col("key").isNotNull() & F.coalesce(hit, F.lit(False))).drop("_block", *[f"_w{w}" for w in range(WORDS)])


def url_verdicts(pages: DataFrame, listed: DataFrame, rules=RULES, bits_per_key: int = 16, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """A row for each row of pages (page_id, url): page_id, host, path, rule, verdict, listed.

    The longest rule that fits decides; without one a page is blocked if its canonical URL is listed and allowed
    otherwise. A null url, or one without ://, has an empty host and path, fits no rule and is in no list.
    Repeated rows are judged alike; an empty list blocks nothing, nulls in it count for nothing.
    """
    listed = written(listed.filter("key IS NOT NULL").select("key").distinct(), "listed")
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("_rule", rule_verdict(F.col("host"), F.col("path"), rules))
    p = p.withColumn("key", F.when((F.col("host") != "") & F.col("_rule").isNull(), canonical(F.col("host"), F.col("path"))))
    p = maybe_listed(p, listed, bits_per_key, filter_bytes)
    exact = listed.select(F.col("key").alias("_listed"))
    hits = p.filter("maybe").join(exact, F.col("key") == F.col("_listed"), "left").withColumn("listed", F.col("_listed").isNotNull())
    p = p.filter("NOT maybe").withColumn("listed", F.lit(False)).unionByName(hits.drop("_listed"))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return p.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "listed")
