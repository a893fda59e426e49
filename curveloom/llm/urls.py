"""URL filters: host and path rules, and a blocked Bloom filter before an exact join with a list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveloom.llm.common import HOT_PARTS, stored

#: Rules as (host, path, verdict).
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
#: Site names whose pages make up the list of the registered query.
LISTED_SITES = ("casino-win", "ads-track", "free-bets", "spam-farm", "cheap-pills", "adult-x")
#: Bits of the filter for each listed URL; a block is eight words of 64 bits, one bit set in each.
BITS_PER_URL, WORDS = 16, 8
#: A filter of at most so many blocks (72 bytes each) is broadcast, a larger one is joined by block.
BROADCAST_BLOCKS = 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"\A[^/?#]*", 0))
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    path = F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1))
    return F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One text for the addresses of a page: no scheme, port, query or fragment, no ``www.`` or ``m.``
    before the host, no ``.html`` and no ``/`` at the end of the path."""
    site = F.regexp_replace(F.regexp_replace(host, r":[0-9]*\z", ""), r"\A(?:www|m)\.", "")
    return F.concat(site, F.regexp_replace(F.regexp_replace(path, r"\.html\z", ""), r"/+\z", ""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null without one. A rule fits its host and all
    subdomains if the path starts with the rule's."""
    chosen = None
    for name, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(prefix))
        result = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, result) if chosen is None else chosen.when(fits, result)
    return chosen if chosen is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    """The bit of ``key`` in a word of its block, from six bits of a second hash."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit(1), key), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_blocks(listed: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """The filter of ``n`` distinct keys as rows (block, word_0 .. word_7), and its number of blocks.

    Bits of a block are combined before and after the shuffle; blocks without a bit have no row.
    """
    blocks = max(1, -(-n * BITS_PER_URL // (64 * WORDS)))
    return listed.groupBy(_block(F.col(key), blocks).alias("block")).agg(
        *[F.bit_or(_bit(F.col(key), w)).alias(f"word_{w}") for w in range(WORDS)]
    ), blocks


def possible_hits(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """Rows whose key the filter of ``listed`` (distinct, stored) holds: all true hits and a few others."""
    n = listed.count()
    bits, blocks = bloom_blocks(listed, key, n)
    bits = bits.withColumnRenamed("block", "__block")
    if blocks <= BROADCAST_BLOCKS:
        bits = F.broadcast(bits)
    condition = _block(F.col(key), blocks) == F.col("__block")
    for w in range(WORDS):
        condition = condition & (F.col(f"word_{w}").bitwiseAND(_bit(F.col(key), w)) != 0)
    return rows.join(bits, condition, "left_semi")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page.

    ``listed`` has a column ``canonical``; repeated and null entries in it do not matter. A page whose
    URL a rule fits has the rule's verdict; others are blocked if their canonical URL is listed, else
    allowed. Null URLs and URLs without ``://`` have an empty host and path, and are never listed.
    Repeated rows are judged alike.

    Distinct possible hits are joined exactly with the list; the confirmed URLs meet the pages again,
    those with a large share of the pages by broadcast (fewer than ``HOT_PARTS`` can be), the others by a shuffle.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = parts.select("*", canonical(F.col("host"), F.col("path")).alias("canonical"))
    known = stored(listed.where("canonical is not null and canonical <> ''").select("canonical").distinct())
    maybe = possible_hits(rows, "canonical", known).groupBy("canonical").agg(F.count(F.lit(1)).alias("n_pages"))
    hits = stored(maybe.join(known, "canonical", "left_semi"))
    total = hits.agg(F.sum("n_pages")).first()[0] or 0
    is_hot = F.col("n_pages") * F.lit(HOT_PARTS) > F.lit(total)
    mark = lambda df, name: df.select(F.col("canonical").alias(f"__{name}"))
    hot, cold = mark(hits.where(is_hot), "hot"), mark(hits.where(~is_hot), "cold")
    marked = rows.join(F.broadcast(hot), F.col("canonical") == F.col("__hot"), "left")
    # Keys settled by the broadcast take no part in the shuffle's join key, nor do empty ones.
    open_key = F.when(F.col("__hot").isNull() & (F.col("canonical") != ""), F.col("canonical"))
    met = marked.withColumn("__open", F.coalesce(open_key, F.concat(F.lit("\0"), F.col("page_id").cast("string")),
                                                 F.lit("\0"))).join(
        cold, F.col("__open") == F.col("__cold"), "left")
    return met.select(
        "page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("__rule"),
        (F.col("__hot").isNotNull() | F.col("__cold").isNotNull()).alias("listed"),
    ).select(
        "page_id", "host", "path", F.col("__rule")["rule"].alias("rule"),
        F.coalesce(F.col("__rule")["verdict"], F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )


def listed_pages(pages: DataFrame, sites: Sequence[str] = LISTED_SITES) -> DataFrame:
    """Canonical URLs of the pages of some sites: the list of the registered query."""
    host = host_of(F.col("url"))
    site = F.element_at(F.split(host, r"\."), -3)
    return pages.where(F.size(F.split(host, r"\.")) >= 3).where(site.isin(*sites)).select(
        canonical(host, path_of(F.col("url"))).alias("canonical"))
