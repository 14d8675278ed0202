"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join, with DataFrame functions only.

A block has eight 64-bit words and every URL sets one bit of each word, so one row of the filter answers a probe.
The filter is a table of blocks dealt by hash; it is joined, not broadcast, so that the list may have any length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read, spread, stage

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Hosts with such a label are listed by the query.
LISTED_LABELS = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track")
BITS_PER_URL = 16
WORDS = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and where ``://`` is missing."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.``, and path without slashes at its end; scheme, query and fragment do not count."""
    return F.concat(F.regexp_replace(host, "^(www|m)\\.", ""), F.regexp_replace(path, "/+$", ""))


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("canon"), F.lit(blocks))


def _bit(k: int) -> Column:
    """Which bit of word ``k``: six bits of a second hash."""
    return F.expr(f"cast(shiftrightunsigned(xxhash64(canon, 'bit'), {6 * k}) & 63 as int)")


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 ... w7) of ``listed`` (canon)."""
    bits = listed.select(_block(blocks).alias("block"), *[_bit(k).alias(f"b{k}") for k in range(WORDS)])
    return bits.groupBy("block").agg(*[F.expr(f"bit_or(shiftleft(1L, b{k}))").alias(f"w{k}") for k in range(WORDS)])


def listed_hits(canons: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct ``canon`` of ``canons`` that are in ``listed`` (canon): the filter first, then the exact join."""
    listed = stage(listed.where("canon <> ''").distinct(), "listed")
    blocks = max(1, -(-listed.count() * BITS_PER_URL // (64 * WORDS)))
    probes = canons.where("canon <> ''").distinct().select("canon", _block(blocks).alias("block"), *[_bit(k).alias(f"b{k}") for k in range(WORDS)])
    held = probes.join(bloom_blocks(listed, blocks), "block")
    possible = held.where(" and ".join(f"(shiftright(w{k}, b{k}) & 1) = 1" for k in range(WORDS))).select("canon")
    return possible.join(listed.hint("shuffle_hash"), "canon", "left_semi")


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    The longest rule that fits decides; other URLs are blocked when ``listed`` (url) holds the same canonical URL.
    A null or malformed url has empty host and path, fits no rule, and is allowed. Repeated rows are judged each.
    An empty table gives no rows, an empty list blocks nothing.
    """
    host, path = split_url(F.col("url"))
    pages = spread(pages, ["page_id", "url"]).select("page_id", host.alias("host"), path.alias("path"))
    pages = pages.withColumn("canon", canonical(F.col("host"), F.col("path")))
    fits = [(F.when(_fits(F.col("host"), F.col("path"), h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    pages = pages.withColumn("fit", F.coalesce(*fits))
    lh, lp = split_url(F.col("url"))
    open_page = F.col("fit").isNull() & (F.col("canon") != "")
    undecided = pages.where(open_page)
    hits = listed_hits(undecided.select("canon"), spread(listed, ["url"]).select(canonical(lh, lp).alias("canon")))
    looked_up = undecided.join(hits.withColumn("hit", F.lit("block")), "canon", "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("hit", F.lit("allow")).alias("verdict"))
    # pages that a rule decides, and those without a URL, take no part in the join
    return looked_up.unionByName(pages.where(~open_page).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit("allow")).alias("verdict")))


def listed_pages(pages: DataFrame) -> DataFrame:
    """(url) of the pages whose host has one of LISTED_LABELS: the list of the registered query."""
    host, _ = split_url(F.col("url"))
    return spread(pages, ["url"]).where(F.arrays_overlap(F.split(host, "\\."), F.array(*[F.lit(x) for x in LISTED_LABELS])))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge(pages, listed_pages(pages))


OP1_SQL = """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
c AS (SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') AS canon, '.' || host AS h FROM p),
l AS (SELECT DISTINCT canon FROM c WHERE canon <> '' AND list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills', 'casino-win', 'free-bets', 'adult-x', 'ads-track'])),
f AS (SELECT *, CASE
    WHEN h LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN h LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN h LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN h LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN h LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""
