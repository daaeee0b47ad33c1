"""URL filters: rules on hosts and paths, then a blocked Bloom filter (operator 10).

All of it is DataFrame functions.  Listed canonical URLs are hashed into a
Bloom filter of 64-bit blocks, one block and four bits for each URL; the blocks
form a table of a bounded number of rows, so the join that probes them may be
broadcast.  Pages that pass, and only these, go on to an exact join on the canonical
URL, which removes the false positives; a list too long for the filter passes more
pages, and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS, MOST_BLOCKS = 1 << 12, 1 << 17  # a filter grows with the list between these, 4 listed URLs to a block of 64 bits
BITS = 4
# The rules of the query, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Canonical URLs that are listed by default: whole hosts end in a slash.
LISTED = [
    "casino-win.example.com/", "casino-win.example.net/", "casino-win.example.org/",
    "cheap-pills.example.com/", "cheap-pills.example.net/", "cheap-pills.example.org/",
    "free-bets.example.com/", "free-bets.example.net/", "free-bets.example.org/",
    "spam-farm.example.com/", "spam-farm.example.net/", "spam-farm.example.org/",
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://``, A-Z in lower case; empty without one."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_host(host: Column) -> Column:
    """The host without a leading ``www.``, ``m.`` or ``blog.``, port or user."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(bare, r"^(www|m|blog)\.", "")


def canonical_url(url: Column) -> Column:
    """Canonical host and path: no scheme, query or fragment, no slash at the end of a page's path."""
    path = F.regexp_replace(path_of(url), r"(\.html?)?/*$", "")
    return F.concat(canonical_host(host_of(url)), F.when(path == "", F.lit("/")).otherwise(path))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """The bits of a key in its block, from another hash."""
    other = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for k in range(BITS):
        six = F.pmod(F.shiftrightunsigned(other, 6 * k), F.lit(64)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), six))
    return out


def bloom_blocks(listed: DataFrame, key: str = "key", blocks: int = BLOCKS) -> DataFrame:
    """The filter as ``block, bits``: at most ``blocks`` rows, whatever is listed."""
    k = F.col(key)
    return listed.where(k.isNotNull()).groupBy(_block(k, blocks).alias("block")).agg(F.bit_or(_mask(k)).alias("bits"))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rhost, rpath in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == rhost) | host.endswith("." + rhost)) & path.startswith(rpath)
        out = F.when(fits, F.struct(F.lit(rhost + rpath).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, blocks: int | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every URL: ``page_id, host, path, rule, verdict, listed``.

    Where a rule fits, its verdict holds.  Elsewhere a page is blocked if its
    canonical URL or its whole host is listed, and allowed otherwise.  Null URLs
    and URLs without ``://`` have an empty host and path, fit no rule and are
    allowed.  Repeated rows are judged alike, null ids are passed on, other
    columns are left out; an empty table gives an empty result, and an empty list blocks
    nothing.  ``listed`` is a table of canonical URLs in a column ``key``; nulls and
    repeats in it don't matter.  ``blocks``: of the filter, by default by the list's size.
    """
    spark = pages.sparkSession
    if listed is None:
        listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    url = F.col(url_col)
    judged = pages.select(
        F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical_url(url).alias("page_key"), F.concat(canonical_host(host_of(url)), F.lit("/")).alias("host_key")
    ).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    blocks = blocks or min(MOST_BLOCKS, max(BLOCKS, listed.count() // 4))
    bloom = F.broadcast(bloom_blocks(listed, "key", blocks))
    for name in ("page", "host"):
        side = bloom.select(F.col("block").alias(f"{name}_block"), F.col("bits").alias(f"{name}_bits"))
        key = F.col(f"{name}_key")
        hit = F.coalesce(F.col(f"{name}_bits").bitwiseAND(_mask(key)) == _mask(key), F.lit(False))
        judged = judged.withColumn(f"{name}_block", _block(key, blocks)).join(side, f"{name}_block", "left").withColumn(f"{name}_hit", hit).drop(f"{name}_block", f"{name}_bits")
    possible = F.col("page_hit") | F.col("host_hit")
    clear = judged.where(~possible).withColumn("page_listed", F.lit(False)).withColumn("host_listed", F.lit(False))
    passed = judged.where(possible)
    for name in ("page", "host"):
        exact = listed.where("key is not null").select(F.col("key").alias(f"{name}_key"), F.lit(True).alias(f"{name}_listed")).distinct()
        passed = passed.join(exact, f"{name}_key", "left")
    judged = clear.unionByName(passed)
    on_list = F.coalesce(F.col("page_listed"), F.lit(False)) | F.coalesce(F.col("host_listed"), F.lit(False))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(on_list, "block").otherwise("allow")).alias("verdict"),
        on_list.alias("listed"),
    )
