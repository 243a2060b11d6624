"""URL filters: a blocked Bloom filter of what is listed passes possible hits to an exact join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import saved

#: A block has four words of 63 usable bits; a listed key sets one bit in each.
WORDS, WORD_BITS = 4, 63
#: Keys that share a block, on average. With two bits a key and word taken, about one key in 10,000 passes wrongly.
KEYS_PER_BLOCK = 8
#: Filters of up to so many blocks (40 bytes each) are broadcast; larger ones are joined by block.
MOST_BROADCAST_BLOCKS = 1_500_000
#: Lists of up to so many entries are broadcast to the exact join.
MOST_BROADCAST_KEYS = 500_000


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; empty without it."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; empty without "://"."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*(/[^?#]*)?", 1)


def canonical(host: Column, path: Column) -> Column:
    """Key of a page: host without a leading "www.", path without a trailing "/"."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.lit("|"), F.rtrim(path, F.lit("/")))


def _bits(key: Column, blocks: int) -> list[Column]:
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    block = F.pmod(h, F.lit(blocks)).alias("block")
    return [block, *[F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(g, 15 * i), F.lit(WORD_BITS)).cast("int")).alias(f"m{i}") for i in range(WORDS)]]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, w0..w3) of the blocked Bloom filter of keys (key), built by one aggregation."""
    bits = keys.select(*_bits(F.col("key"), blocks))
    return bits.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def possible(candidates: DataFrame, bloom: DataFrame, blocks: int, broadcast: bool) -> DataFrame:
    """The rows of candidates whose `key` may be listed."""
    names = candidates.columns
    asked = candidates.select("*", *_bits(F.col("key"), blocks))
    hit = None
    for i in range(WORDS):
        one = F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) != 0
        hit = one if hit is None else hit & one
    return asked.join(F.broadcast(bloom) if broadcast else bloom, "block").where(hit).select(*names)


def url_verdicts(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block).

    rules: (host, path, verdict). A rule fits its host and all subdomains where the path starts with the rule's; the
    longest rule wins (host and path together; of equal ones the last in order of text). A null or empty rule path fits
    all paths. Without a rule, a page is blocked if its canonical URL is in listed (key), see canonical(), else allowed.

    Both lists share a filter: a page asks for its canonical URL, and for the suffix of its host and the beginning of
    its path in each pair of numbers of labels and characters that rules have. What passes the filter is joined exactly,
    which removes false positives.

    A null URL and one without "://" have an empty host and path, fit no rule and are looked up as such. Verdicts follow
    from host and path alone, so that repeated pages and repeated or null ids are judged each by itself. Empty lists
    allow all; an empty table gives an empty result; other columns are ignored.
    """
    rule_rows = (
        rules.select(F.lower("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .where("rule_host is not null")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
    )
    rule_keys = rule_rows.select(
        F.concat(F.lit("r|"), "rule_host", F.lit("|"), "rule_path").alias("key"),
        F.concat("rule_host", "rule_path").alias("rule"),
        "rule_verdict",
        (F.length("rule_host") + F.length("rule_path")).alias("weight"),
    )
    page_keys = listed.select(F.concat(F.lit("u|"), "key").alias("key")).where("key is not null").distinct()
    page_rows = page_keys.select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("rule_verdict"), F.lit(-1).alias("weight"))
    known = saved(rule_keys.unionByName(page_rows), "listed")
    size = known.count()
    blocks = max(1, math.ceil(size / KEYS_PER_BLOCK))
    bloom = saved(bloom_filter(known, blocks), "bloom")

    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    own = F.concat(F.lit("u|"), canonical(F.col("host"), F.col("path")))
    asks = F.concat(F.array(own), _rule_asks(rule_rows))
    candidates = base.select("host", "path", F.explode(F.array_distinct(asks)).alias("key"))
    maybe = possible(candidates, bloom, blocks, blocks <= MOST_BROADCAST_BLOCKS)
    exact = maybe.join(F.broadcast(known) if size <= MOST_BROADCAST_KEYS else known, "key")
    won = exact.groupBy("host", "path").agg(F.max(F.struct("weight", "rule", "rule_verdict")).alias("won"))
    judged = base.join(won, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.rule_verdict", F.lit("allow")).alias("verdict"))


def _rule_asks(rule_rows: DataFrame) -> Column:
    """The rules' keys that could fit a page's host and path: one for each number of labels and length of path that some
    rule has. The driver gets those pairs of numbers, no more than rules differ in them."""
    shape = F.size(F.split("rule_host", r"\.")).cast("long") * (1 << 32) + F.length("rule_path")
    shapes = [r[0] for r in rule_rows.select(shape.alias("shape")).distinct().orderBy("shape").collect()]
    if not shapes:
        return F.array().cast("array<string>")
    labels = F.split("host", r"\.")
    known = F.split(F.lit(",".join(map(str, shapes))), ",").cast("array<bigint>")
    n_labels, n_path = lambda x: F.shiftright(x, 32).cast("int"), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    fitting = F.filter(known, lambda x: (n_labels(x) <= F.size(labels)) & (n_path(x) <= F.length("path")))

    def key(x: Column) -> Column:
        suffix = F.array_join(F.slice(labels, F.size(labels) - n_labels(x) + 1, n_labels(x)), ".")
        return F.concat(F.lit("r|"), suffix, F.lit("|"), F.col("path").substr(F.lit(1), n_path(x)))

    return F.transform(fitting, key)
