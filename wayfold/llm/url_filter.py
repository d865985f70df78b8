"""URL filter: prefix rules, then a blocked Bloom filter of listed canonical URLs and an exact join.

A listed URL sets four bits in one block of 256 bits (four 64-bit words). The filter is a table of
(block, four words) with 16 bits or more for each listed URL; it is broadcast only up to
`broadcast_blocks` blocks (32 bytes each) and joined on the block by a shuffle beyond that. Only
pages that may be listed go on to the exact hash join with the list, which removes false positives.

Nulls: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed.
Rows that repeat a page_id are judged one by one. An empty list blocks nothing. Extra columns of
either input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (verdict, host, path), the rules of the contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BITS_PER_URL = 16
BROADCAST_BLOCKS = 1 << 18
WORDS = ("w0", "w1", "w2", "w3")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Without scheme, `www.`, query, fragment and final slashes; null where there is no host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, "^www\\.", ""), F.regexp_replace(path, "/+$", "")))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, h, p = rule
    return ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))


def rule_and_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):
        rule, verdict = (F.when(_fits(host, path, r), F.lit(x)).otherwise(y) for x, y in ((r[1] + r[2], rule), (r[0], verdict)))
    return rule, verdict


def _bits(canon: Column) -> list[Column]:
    """For each word of the block, the number with one bit set."""
    h = F.xxhash64(canon, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(4)]


def _block(canon: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(canon), F.lit(blocks)).cast("int")


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter's non-empty blocks. listed: one column, canon."""
    named = listed.select(_block(F.col("canon"), blocks).alias("block"), *[b.alias(w) for b, w in zip(_bits(F.col("canon")), WORDS, strict=True)])
    return named.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, bits_per_url: int = BITS_PER_URL, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict, maybe_listed of every page. listed: its first column holds URLs."""
    host, path = host_and_path(F.col(listed.columns[0]))
    canon = listed.select(canonical(host, path).alias("canon")).where("canon IS NOT NULL").distinct()
    blocks, need = 1, canon.count() * bits_per_url
    while blocks * 256 < need:
        blocks *= 2
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    parts = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), canonical(F.col("host"), F.col("path")).alias("canon"))
    filt = bloom(canon, blocks)
    filt = F.broadcast(filt) if blocks <= broadcast_blocks else filt
    tested = parts.withColumn("block", _block(F.coalesce("canon", F.lit("")), blocks)).join(filt, "block", "left")
    maybe = F.lit(True)
    for b, w in zip(_bits(F.col("canon")), WORDS, strict=True):
        maybe = maybe & (F.col(w).bitwiseAND(b) != 0)
    tested = tested.select("page_id", "host", "path", "rule", "ruled", "canon", F.coalesce(maybe, F.lit(False)).alias("maybe_listed"))
    sure = F.col("ruled").isNotNull() | ~F.col("maybe_listed")
    out = ("page_id", "host", "path", "rule", "verdict", "maybe_listed")
    done = tested.where(sure).withColumn("verdict", F.coalesce("ruled", F.lit("allow"))).select(*out)
    checked = tested.where(~sure).join(canon.withColumn("hit", F.lit(True)), "canon", "left")
    return done.unionByName(checked.withColumn("verdict", F.when(F.col("hit"), "block").otherwise("allow")).select(*out))


#: The query's list: the URLs of all pages on hosts with one of these labels.
LISTED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_HOST = rf"(^|[.])({'|'.join(LISTED)})([.]|$)"


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = host_and_path(F.col("url"))
    listed = pages.where(host.rlike(LISTED_HOST)).select("url")
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


SQL = f"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), cut AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules AS (
  SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) AS r(verdict, h, p)
), canon AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/+$', '') END AS c FROM cut
), listed AS (SELECT DISTINCT c FROM canon WHERE regexp_matches(host, '{LISTED_HOST}')),
longest AS (
  SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS ruled
  FROM cut, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id, host, path
)
SELECT canon.page_id, canon.host, canon.path, rule,
  coalesce(ruled, CASE WHEN listed.c IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM canon LEFT JOIN longest USING (page_id) LEFT JOIN listed ON canon.c = listed.c
"""
