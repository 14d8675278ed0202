"""Every operator as a query over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import feedxml as X
from ..functions import ids as I
from ..functions import text as T
from ..functions import times as TM
from ..functions import urls as U
from ..operators import dedupe as DD
from ..operators import discovery as DC
from ..operators import normalize as N
from ..operators import postings as PO
from ..operators import ranking as RK
from ..operators import summaries as S
from ..operators import views as V
from ..sources import documents as D
from ..sources import registry as R
from . import binding as B
from .binding import iso_sql, with_ctes
from .pipeline import run_metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEARCH = "the with"


def _query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _simple(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _query(name, sql)(build)


def _joined(column: str):
    return F.array_join(column, ",").alias(column)


def _docs(s, d):
    return B.table(s, d, "documents")


def _pages(s, d):
    return B.table(s, d, "pages")


# ---------------------------------------------------------------- registry and documents

_simple("registry_scan", lambda s, d: B.registry(s, d), with_ctes("reg", "SELECT * FROM reg"))
_simple("enabled_feeds", lambda s, d: R.enabled(B.registry(s, d)).select("id", "pos"), with_ctes("reg", "SELECT id, pos FROM reg WHERE enabled"))
_simple(
    "registry_violations",
    lambda s, d: R.violations(B.registry(s, d).withColumn("language", F.when(F.col("pos") % 6 == 0, F.lit("  ")).otherwise(F.col("language"))).withColumn("enabled", F.when(F.col("pos") % 4 != 0, F.col("enabled")))),
    with_ctes("reg", "SELECT pos, 'language' AS field FROM reg WHERE pos % 6 = 0 UNION ALL SELECT pos, 'enabled' FROM reg WHERE pos % 4 = 0"),
)
_simple(
    "duplicate_feed_urls",
    lambda s, d: R.repeated_feed_urls(B.registry(s, d).withColumn("feed_url", F.concat(F.lit("https://feeds.example.net/"), (F.col("pos") % 20).cast("string")))),
    with_ctes("reg", "SELECT 'https://feeds.example.net/' || pos % 20 AS feed_url, count(*) AS n FROM reg GROUP BY 1 HAVING count(*) > 1"),
)
_X = lambda start, value, end: f"coalesce('{start}' || replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '{end}', '')"
_RSS = [
    """'<?xml version="1.0"?><RSS version="2.0"><channel><title>all</title><item>'""", _X("<title>  ", "title", " </title>"), _X("<link>", "url", "</link>"), _X("<guid>", "item", "</guid>"), _X("<pubDate>Mon, ", "strftime(pub, '%-d %b %Y %H:%M:%S')", " +0000</pubDate>"),
    _X("<author>", "author", "</author>"), _X('<media:content url="', "image", '" medium="image"/>'), _X("<description>", "text", "</description>"), "'</item><item><title></title><link>https://example.com/none</link></item></channel></RSS>'",
]
_ATOM = [
    """'<feed xmlns="http://www.w3.org/2005/Atom"><title>all</title><entry>'""", _X('<title type="text">', "title", "</title>"), """'<link rel="self" href="https://example.com/self"/>'""", _X("<link href=''", "url", "''/>"), _X("<id>", "item", "</id>"),
    _X("<updated>", "strftime(pub, '%Y-%m-%dT%H:%M:%SZ')", "</updated>"), _X("<author><name>", "author", "</name></author>"), _X("<enclosure url=''", "image", "''></enclosure>"), _X("<summary>", "text", "</summary>"), "'</entry><entry><title/></entry></feed>'",
]
_simple(
    "doc_source",
    lambda s, d: B.documents(s, d).select("feed_id", "doc_ord", F.length("xml").cast("long").alias("chars"), F.sha2("xml", 256).alias("xml_sha256")),
    with_ctes("raw", f"SELECT feed_id, item_ord AS doc_ord, length(xml)::BIGINT AS chars, sha256(xml) AS xml_sha256 FROM (SELECT *, CASE WHEN doc_ord % 2 = 0 THEN {' || '.join(_RSS)} ELSE {' || '.join(_ATOM)} END AS xml FROM raw)"),
)
_simple("format_dispatch", lambda s, d: B.documents(s, d).select("doc_ord", X.document_kind(F.col("xml")).alias("kind")), with_ctes("raw", "SELECT item_ord AS doc_ord, CASE WHEN doc_ord % 2 = 0 THEN 'rss' ELSE 'atom' END AS kind FROM raw"))
_simple(
    "doc_registry_join",
    lambda s, d: N.strict_registry_join(B.documents(s, d).select("feed_id", "doc_ord"), B.registry(s, d)).drop("category_id"),
    with_ctes("reg raw", "SELECT feed_id, item_ord AS doc_ord, name AS source_name, category, language, site_url FROM raw JOIN reg ON reg.id = feed_id"),
)
_simple(
    "orphan_documents",
    lambda s, d: D.orphans(B.documents(s, d).select("feed_id", "doc_ord"), R.enabled(B.registry(s, d))),
    with_ctes("reg raw", "SELECT feed_id, item_ord AS doc_ord FROM raw WHERE feed_id NOT IN (SELECT id FROM reg WHERE enabled)"),
)
_simple(
    "doc_union",
    lambda s, d: B.documents(s, d).select("feed_id", "doc_ord").unionByName(B.registry(s, d).select(F.col("id").alias("feed_id"), F.col("pos").alias("doc_ord"))).groupBy("feed_id").agg(F.count(F.lit(1)).alias("n")),
    with_ctes("reg raw", "SELECT feed_id, count(*) AS n FROM (SELECT feed_id FROM raw UNION ALL SELECT id FROM reg) GROUP BY 1"),
)


def _outcomes(s, d):
    """What fetch_all() gives by a fetcher that needs no network: every third feed fails, and some pages are empty."""

    def page(url: str) -> str:
        n = int("".join(c for c in url.rsplit("/", 1)[1] if c.isdigit()))
        if n % 3 == 0:
            raise OSError(f"HTTP 50{n % 5}")
        return "" if n % 7 == 1 else f"<rss>{n}</rss>"

    return D.fetch_all(B.registry(s, d), page)


_simple("fetch_outcomes", _outcomes, with_ctes("reg", "SELECT pos AS doc_ord, id AS feed_id, feed_url, CASE WHEN NOT (pos % 3 = 0 OR pos % 7 = 1) THEN '<rss>' || pos || '</rss>' END AS xml, CASE WHEN pos % 3 = 0 THEN 'HTTP 50' || pos % 5 WHEN pos % 7 = 1 THEN 'empty document' END AS error FROM reg WHERE enabled"))
_simple(
    "update_metrics",
    lambda s, d: D.update_metrics(_outcomes(s, d)),
    with_ctes("reg", "SELECT count(*) AS attempted_feeds, count(*) FILTER (NOT (pos % 3 = 0 OR pos % 7 = 1)) AS fetched_documents, count(*) FILTER (pos % 3 = 0 OR pos % 7 = 1) AS failed_feeds, string_agg(id, ', ' ORDER BY pos) FILTER (pos % 3 = 0 OR pos % 7 = 1) AS failed_ids FROM reg WHERE enabled"),
)
_simple("failed_ids", lambda s, d: D.update_metrics(_outcomes(s, d)).select("failed_ids"), with_ctes("reg", "SELECT string_agg(id, ', ' ORDER BY pos) FILTER (pos % 3 = 0 OR pos % 7 = 1) AS failed_ids FROM reg WHERE enabled"))
_simple("publish_gate", lambda s, d: D.publish_gate(D.update_metrics(_outcomes(s, d))), "SELECT true AS publish, '' AS reason")
_GATES = (("none fetched", "error IS NOT NULL"), ("none enabled", "false"), ("some", "true"))
_simple(
    "publish_gate_refusals",
    lambda s, d: functools.reduce(DataFrame.unionByName, [D.publish_gate(D.update_metrics(_outcomes(s, d).where(rows))).select(F.lit(name).alias("name"), "publish", "reason") for name, rows in _GATES]),
    "SELECT 'none fetched' AS name, false AS publish, 'no document was fetched' AS reason UNION ALL SELECT 'none enabled', false, 'no enabled feeds' UNION ALL SELECT 'some', true, ''",
)

# ---------------------------------------------------------------- XML

_BLOCK = "item_ord"
_simple("split_items", lambda s, d: N.split_items(B.documents(s, d)).select("doc_ord", F.col("item_ord").cast("long").alias("item_ord"), (F.length("block") > 60).alias("full")), with_ctes("raw", "SELECT item_ord AS doc_ord, i AS item_ord, i = 0 AS \"full\" FROM raw, (SELECT unnest([0, 1])::BIGINT AS i)"))
_SHOWN = "nullif(regexp_replace(trim(regexp_replace({}, '\\s+', ' ', 'g')), '\\s+([.,!?;:])', '\\1', 'g'), '')"
_PARTS = f"item_ord AS doc_ord, {_SHOWN.format('title')} AS title, url, {_SHOWN.format('text')} AS summary, {iso_sql('pub')} AS published_at, author, image AS image_url, item AS source_item_id"


def _parsed(s, d, kind):
    rows = N.split_items(B.documents(s, d)).where(F.col("kind") == kind)
    return N.parsed_items(rows).where("title is not null and url is not null").select("doc_ord", "title", "url", "summary", TM.iso(F.col("published_at")).alias("published_at"), "author", "image_url", "source_item_id")


_simple("rss_normalize", lambda s, d: _parsed(s, d, "rss"), with_ctes("raw", f"SELECT {_PARTS} FROM raw WHERE doc_ord % 2 = 0 AND {_SHOWN.format('title')} IS NOT NULL"))
_simple("atom_normalize", lambda s, d: _parsed(s, d, "atom"), with_ctes("raw", f"SELECT {_PARTS} FROM raw WHERE doc_ord % 2 = 1 AND {_SHOWN.format('title')} IS NOT NULL"))
_simple(
    "drop_incomplete",
    lambda s, d: N.canonical_articles(B.documents(s, d), B.registry(s, d)).groupBy("feed_id").agg(F.count(F.lit(1)).alias("n")),
    with_ctes("raw", f"SELECT feed_id, count(*) AS n FROM raw WHERE {_SHOWN.format('title')} IS NOT NULL GROUP BY 1"),
)
_simple(
    "canonical_articles",
    lambda s, d: N.canonical_articles(B.documents(s, d), B.registry(s, d)).select("doc_ord", "feed_id", "source_name", "category", "language", "normalized_url", "dedupe_key", _joined("tags"), _joined("seen_in_feeds"), TM.iso(F.col("fetched_at")).alias("fetched_at")),
    with_ctes("reg art", f"SELECT item_ord AS doc_ord, feed_id, name AS source_name, category, language, nurl AS normalized_url, key AS dedupe_key, '' AS tags, feed_id AS seen_in_feeds, {iso_sql('fetched')} AS fetched_at FROM art JOIN reg ON reg.id = feed_id WHERE {_SHOWN.format('title')} IS NOT NULL"),
)
_simple("extract_tag_text", lambda s, d: N.split_items(B.documents(s, d)).where("item_ord = 0").select("doc_ord", X.first_text(F.col("block"), ["description", "summary"]).alias("shown")), with_ctes("raw", f"SELECT item_ord AS doc_ord, {_SHOWN.format('text')} AS shown FROM raw"))
_simple("extract_raw_text", lambda s, d: N.split_items(B.documents(s, d)).where("item_ord = 0").select("doc_ord", X.first_raw(F.col("block"), ["guid", "id"]).alias("item")), with_ctes("raw", "SELECT item_ord AS doc_ord, item FROM raw"))
_simple("atom_link", lambda s, d: N.split_items(B.documents(s, d)).where("kind = 'atom' and item_ord = 0").select("doc_ord", X.atom_link(F.col("block")).alias("url")), with_ctes("raw", "SELECT item_ord AS doc_ord, url FROM raw WHERE doc_ord % 2 = 1"))
_simple("image_url", lambda s, d: N.split_items(B.documents(s, d)).where("item_ord = 0").select("doc_ord", X.image_url(F.col("block")).alias("image_url")), with_ctes("raw", "SELECT item_ord AS doc_ord, image AS image_url FROM raw"))
_simple(
    "xml_attrs",
    lambda s, d: _pages(s, d).select("page_id", F.posexplode(X.attributes(F.concat(F.lit('a="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("\" b='"), F.col("page_id").cast("string"), F.lit("' c=bare")))).alias("pos", "p")).select("page_id", F.col("pos").cast("long").alias("pos"), F.col("p.k").alias("k"), F.col("p.v").alias("v")),
    "SELECT page_id, 0::BIGINT AS pos, 'a' AS k, url AS v FROM pages UNION ALL SELECT page_id, 1, 'b', page_id::VARCHAR FROM pages",
)

# ---------------------------------------------------------------- scalars

_DECODE = "replace(replace(replace(replace(replace(replace(regexp_replace({}, '(?s)<!\\[CDATA\\[(.*?)\\]\\]>', '\\1', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"
_STRIP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?i)<br\\s*/?>|</p>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_NORM = "trim(regexp_replace({}, '[\\s\\x{{0B}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g'))"
_simple("decode_entities", lambda s, d: _pages(s, d).select("page_id", F.sha2(T.decode_entities(F.col("html")), 256).alias("h")), f"SELECT page_id, sha256({_DECODE.format('html')}) AS h FROM pages")
_simple(
    "decode_numbers",
    lambda s, d: _docs(s, d).select("doc_id", T.decode_entities(F.concat(F.lit("<"), F.lit("&#"), (F.col("doc_id") * 977 % 1_200_000 + 1).cast("string"), F.lit(";&#x"), F.hex(F.col("doc_id") * 31 + 1), F.lit(";>"))).alias("shown")),
    """WITH n AS (SELECT doc_id, doc_id * 977 % 1200000 + 1 AS a, doc_id * 31 + 1 AS b FROM documents)
SELECT doc_id, '<' || CASE WHEN a > 1114111 OR a BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(a::INT) END || CASE WHEN b > 1114111 OR b BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(b::INT) END || '>' AS shown FROM n""",
)
_simple("strip_tags", lambda s, d: _pages(s, d).select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("h")), f"SELECT page_id, sha256({_STRIP.format('html')}) AS h FROM pages")
_simple("norm_ws", lambda s, d: _docs(s, d).select("doc_id", F.sha2(T.norm_space(F.col("text")), 256).alias("h")), f"SELECT doc_id, sha256({_NORM.format('text')}) AS h FROM documents")
_simple(
    "display_text",
    lambda s, d: _pages(s, d).select("page_id", T.display_text(F.col("html")).alias("shown")),
    f"SELECT page_id, nullif(regexp_replace({_NORM.format(_STRIP.format(_DECODE.format('html')))}, '\\s+([.,!?;:])', '\\1', 'g'), '') AS shown FROM pages",
)
_simple(
    "parse_pubdate",
    lambda s, d: B.items(s, d).select("item_ord", TM.iso(TM.parse_date(F.when(F.col("item_ord") % 4 == 0, F.concat(F.lit("Tue, "), F.date_format("published_at", "dd MMM yyyy HH:mm:ss"), F.lit(" +0900"))).when(F.col("item_ord") % 4 == 1, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("item_ord") % 4 == 2, F.concat(F.date_format("published_at", "d MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("no date"))).alias("parsed")),
    with_ctes("raw", f"SELECT item_ord, CASE WHEN item_ord % 4 = 0 THEN {iso_sql('pub - INTERVAL 9 HOUR')} WHEN item_ord % 4 = 3 THEN NULL ELSE {iso_sql('pub')} END AS parsed FROM raw"),
)
_simple("iso_format", lambda s, d: B.table(s, d, "events").select("event_id", TM.iso(F.col("ts").cast("timestamp")).alias("iso")), f"SELECT event_id, {iso_sql('ts')} AS iso FROM events")
_simple("date_label", lambda s, d: B.table(s, d, "events").select("event_id", TM.date_label(F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp")), "Asia/Tokyo").alias("label")), "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN strftime(ts + INTERVAL 9 HOUR, '%Y/%m/%d %-H:%M') ELSE '公開日時不明' END AS label FROM events")
_QUERY = "regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1)"
_simple(
    "url_normalize",
    lambda s, d: _pages(s, d).select("page_id", U.normalize_url(F.col("url")).alias("normalized")),
    f"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS base, list_sort(list_filter(string_split({_QUERY}, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)(=|$)'))) AS q FROM pages)
SELECT page_id, CASE WHEN base = '' THEN NULL ELSE base || CASE WHEN regexp_matches(base, '^[a-z]+://[^/]+$') THEN '/' ELSE '' END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS normalized FROM p""",
)
_simple(
    "url_params",
    lambda s, d: _pages(s, d).select("page_id", F.posexplode(U.query_pairs(F.regexp_extract(F.regexp_replace("url", "#.*$", ""), "\\?(.*)$", 1))).alias("pos", "p")).select("page_id", F.col("pos").cast("long").alias("pos"), F.col("p.k").alias("k"), F.col("p.v").alias("v")),
    f"SELECT page_id, pos::BIGINT AS pos, split_part(x, '=', 1) AS k, split_part(x, '=', 2) AS v FROM (SELECT page_id, unnest(q) AS x, unnest(range(len(q))) AS pos FROM (SELECT page_id, list_filter(string_split({_QUERY}, '&'), lambda x: x <> '') AS q FROM pages))",
)
_simple(
    "strip_tracking",
    lambda s, d: _pages(s, d).select("page_id", U.encode_pairs(U.strip_tracking(U.query_pairs(F.regexp_extract(F.regexp_replace("url", "#.*$", ""), "\\?(.*)$", 1)))).alias("query")),
    f"SELECT page_id, array_to_string(list_filter(string_split({_QUERY}, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)(=|$)')), '&') AS query FROM pages",
)
_simple("query_param", lambda s, d: _pages(s, d).select("page_id", U.query_param(F.concat(F.lit("?"), F.regexp_extract(F.regexp_replace("url", "#.*$", ""), "\\?(.*)$", 1)), "page").alias("page")), "SELECT page_id, regexp_extract(regexp_replace(url, '#.*$', ''), '[?&]page=([^&]*)', 1) AS page FROM pages")
_simple("hash_id", lambda s, d: _docs(s, d).select("doc_id", I.hash_id(F.col("text")).alias("h")), "SELECT doc_id, substr(sha256(text), 1, 24) AS h FROM documents")
_simple("title_key", lambda s, d: B.items(s, d).select("item_ord", I.title_key(F.col("title")).alias("k")), with_ctes("raw", "SELECT item_ord, lower(title) AS k FROM raw"))
_simple("article_id", lambda s, d: B.articles(s, d).select("item_ord", "id"), with_ctes("art", "SELECT item_ord, id FROM art"))
_simple("dedupe_key", lambda s, d: B.articles(s, d).select("item_ord", "dedupe_key"), with_ctes("art", "SELECT item_ord, key AS dedupe_key FROM art"))
_simple("richness", lambda s, d: B.items(s, d).select("item_ord", I.richness(F.col("published_at"), F.col("author"), F.col("image_url"), F.col("summary"), F.col("tags")).cast("long").alias("score")), with_ctes("raw", f"SELECT item_ord, {B._score('raw')}::BIGINT AS score FROM raw"))
_simple("slugify", lambda s, d: B.table(s, d, "part").select("p_partkey", T.slugify(F.concat("p_type", F.lit(" / "), "p_name")).alias("slug")), "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type || ' / ' || p_name), '[\\s/_.]+', '-', 'g'), '[^a-z0-9-]', '', 'g') AS slug FROM part")
_simple("tag_key", lambda s, d: B.table(s, d, "part").select("p_partkey", T.compare_key(F.concat(F.lit(" "), "p_type", F.lit("  "), "p_brand")).alias("k")), "SELECT p_partkey, lower(trim(regexp_replace(p_type || '  ' || p_brand, '\\s+', ' ', 'g'))) AS k FROM part")
_simple("count_label", lambda s, d: B.table(s, d, "customer").select("c_custkey", T.count_label(F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey"))).alias("label")), "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey::VARCHAR ELSE '0' END AS label FROM customer")
_simple("hrefs", lambda s, d: B.table(s, d, "part").select("p_partkey", U.page_href("sources", F.concat("p_brand", F.lit(" & "), "p_type")).alias("href")), "SELECT p_partkey, './sources/?id=' || replace(replace(replace(p_brand || ' & ' || p_type, '#', '%23'), '&', '%26'), ' ', '%20') AS href FROM part")
_simple("escape_html", lambda s, d: _pages(s, d).select("page_id", F.sha2(T.escape_html(F.col("html")), 256).alias("h")), "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS h FROM pages")
_simple("safe_links", lambda s, d: _pages(s, d).select("page_id", U.safe_link(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("javascript:"), "url")).otherwise(F.col("url"))).alias("link")), "SELECT page_id, CASE WHEN page_id % 5 <> 0 AND regexp_matches(url, '^https?://') THEN url END AS link FROM pages")
_simple("sort_at", lambda s, d: B.items(s, d).select("item_ord", TM.iso(S.sort_at(F.col("published_at"), F.col("fetched_at"))).alias("sort_at")), with_ctes("raw", f"SELECT item_ord, {iso_sql('coalesce(pub, fetched)')} AS sort_at FROM raw"))
_simple("array_merge", lambda s, d: B.items(s, d).select("item_ord", F.array_join(DD.merged_array(F.concat("tags", F.array(F.lit(""), F.lit("x"))), F.array("lang", F.lit("x"), F.lit("y"))), ",").alias("tags")), with_ctes("raw", "SELECT item_ord, CASE WHEN item_ord % 4 = 0 THEN lang || ',x,y' ELSE 'x,' || lang || ',y' END AS tags FROM raw"))

# ---------------------------------------------------------------- dedupe

_DEDUPED = ["dedupe_key", "merged", "doc_ord", "item_ord", "id", "feed_id", "title", "summary", "author", "image_url", "source_item_id"]
_WHOLE = "sha256(summary) AS summary, length(summary) AS summary_length"


def _hashed(rows):
    return rows.withColumn("summary_length", F.length("summary").cast("long")).withColumn("summary", F.sha2("summary", 256))


_simple(
    "dedupe",
    lambda s, d: _hashed(B.deduped(s, d).select(*_DEDUPED, TM.iso(F.col("published_at")).alias("published_at"), TM.iso(F.col("fetched_at")).alias("fetched_at"), _joined("tags"), _joined("seen_in_feeds"))),
    with_ctes("ded", f"SELECT key AS dedupe_key, merged, doc_ord, item_ord, id, feed_id, title, {_WHOLE}, author, image AS image_url, item AS source_item_id, {iso_sql('pub')} AS published_at, {iso_sql('fetched')} AS fetched_at, array_to_string(tags, ',') AS tags, array_to_string(seen, ',') AS seen_in_feeds FROM ded"),
)
_simple("dedupe_groups", lambda s, d: B.articles(s, d).where("dedupe_key is not null").groupBy("dedupe_key").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("groups")), with_ctes("art", "SELECT n, count(*) AS groups FROM (SELECT count(*) AS n FROM art WHERE key IS NOT NULL GROUP BY key) GROUP BY 1"))
_simple("dedupe_first_seen", lambda s, d: DD.first_seen(B.articles(s, d)), with_ctes("art", "SELECT key AS dedupe_key, (min({'d': doc_ord, 'i': item_ord})).d AS doc_ord, (min({'d': doc_ord, 'i': item_ord})).i AS item_ord FROM art WHERE key IS NOT NULL GROUP BY key"))
_simple(
    "run_metrics",
    lambda s, d: run_metrics(B.registry(s, d), B.articles(s, d), B.deduped(s, d)),
    with_ctes("reg ded", "SELECT (SELECT count(*) FROM reg) AS total_feeds, (SELECT count(*) FROM reg WHERE enabled) AS enabled_feeds, (SELECT count(*) FROM art) AS normalized_articles, (SELECT count(*) FROM ded) AS deduped_articles, (SELECT count(*) FROM art) - (SELECT count(*) FROM ded) AS duplicates_collapsed"),
)

# ---------------------------------------------------------------- summaries

_simple("public_articles", lambda s, d: _hashed(B.public(s, d)), with_ctes("pub", f"SELECT * EXCLUDE summary, {_WHOLE} FROM pub"))
_simple("category_summary", lambda s, d: S.category_summary(B.public(s, d)), with_ctes("cat", "SELECT * FROM cat"))
_simple("source_summary", lambda s, d: S.source_summary(B.public(s, d), B.registry(s, d)), with_ctes("src", "SELECT * FROM src"))
_simple("meta", lambda s, d: S.meta(B.public(s, d), B.GENERATED_AT), with_ctes("pub", f"SELECT '{B.GENERATED_AT}' AS generated_at, count(*) AS article_count, count(DISTINCT source_id) AS source_count, count(DISTINCT category_id) AS category_count FROM pub"))
_simple(
    "slug_collisions",
    lambda s, d: S.category_collisions(B.registry(s, d).select(F.when(F.col("pos") % 2 == 0, F.replace("category", F.lit(" "), F.lit("_"))).otherwise(F.col("category")).alias("category"))).select("category_id", _joined("labels")),
    with_ctes("reg", "SELECT replace(replace(lower(c), ' ', '-'), '_', '-') AS category_id, string_agg(DISTINCT c, ',' ORDER BY c) AS labels FROM (SELECT CASE WHEN pos % 2 = 0 THEN replace(category, ' ', '_') ELSE category END AS c FROM reg) GROUP BY 1 HAVING count(DISTINCT c) > 1"),
)
_simple("category_label_lookup", lambda s, d: B.public(s, d).select("id", "source_id", "category_id").join(S.category_summary(B.public(s, d)).where("article_count % 2 = 0").select("category_id", "label"), "category_id", "left").select("id", "source_id", F.coalesce("label", "category_id").alias("label")), with_ctes("cat", "SELECT id, source_id, coalesce(label, pub.category_id) AS label FROM pub LEFT JOIN (SELECT * FROM cat WHERE article_count % 2 = 0) c ON c.category_id = pub.category_id"))
_simple("articles_ranked", lambda s, d: RK.ranked(B.public(s, d).select("id", "title", "sort_ms"), *S.article_order()).select("id", "rank"), with_ctes("pub", "SELECT id, row_number() OVER (ORDER BY sort_ms DESC, title COLLATE en, id COLLATE en, id) AS rank FROM pub"))
_simple("categories_ranked", lambda s, d: RK.ranked_few(S.category_summary(B.public(s, d)), F.desc("latest_sort_at"), F.collate("label", "en")).select("category_id", "rank"), with_ctes("cat", "SELECT category_id, row_number() OVER (ORDER BY latest_sort_at DESC, label COLLATE en) AS rank FROM cat"))
_simple("sources_ranked", lambda s, d: RK.ranked_few(S.source_summary(B.public(s, d), B.registry(s, d)), F.desc("latest_sort_at"), F.collate("id", "en")).select("id", "rank"), with_ctes("src", "SELECT id, row_number() OVER (ORDER BY latest_sort_at DESC, id COLLATE en) AS rank FROM src"))


def _flagship(s, d):
    """Latest article of each category, over deduped articles."""
    newest = F.max_by(F.struct("id", "title"), F.struct("sort_ms", "id"))
    return B.public(s, d).groupBy("category_id").agg(F.count(F.lit(1)).alias("article_count"), F.max("sort_at").alias("latest_sort_at"), newest.alias("n")).select("category_id", "article_count", "latest_sort_at", F.col("n.id").alias("id"), F.col("n.title").alias("title"))


_simple("latest_by_category", _flagship, with_ctes("pub", "SELECT category_id, count(*) AS article_count, max(sort_at) AS latest_sort_at, arg_max(id, {'m': sort_ms, 'i': id}) AS id, arg_max(title, {'m': sort_ms, 'i': id}) AS title FROM pub GROUP BY 1"))

# ---------------------------------------------------------------- views

_VIEW = """SELECT id, title, CASE WHEN url LIKE 'https://%' THEN replace(url, 'Example.com:443', 'example.com') END AS url, source_name, category_label, strftime(strptime(coalesce(published_at, sort_at), '%Y-%m-%dT%H:%M:%S.%gZ'), '%Y/%m/%d %-H:%M') AS published_at_label,
  coalesce(nullif(summary, ''), '要約はありません。') AS summary, coalesce(summary, '') <> '' AS has_summary, image_url, url LIKE 'https://%' AS can_open_external, CASE WHEN url LIKE 'https://%' THEN '元記事で続きを読む' ELSE '元記事リンクを確認できません。' END AS link_text FROM pub"""
_simple("article_view", lambda s, d: _hashed(V.article_view(B.public(s, d))), with_ctes("pub", f"SELECT * EXCLUDE summary, {_WHOLE} FROM ({_VIEW})"))
_simple("category_nav", lambda s, d: V.category_nav(S.category_summary(B.public(s, d)), "asia"), with_ctes("cat", "SELECT category_id AS id, label, article_count || '件' AS count_label, './categories/?id=' || category_id AS href, category_id = 'asia' AS is_selected FROM cat"))
_simple("source_nav", lambda s, d: V.source_nav(S.source_summary(B.public(s, d), B.registry(s, d)), "src3", None), with_ctes("src", "SELECT id, name, article_count || '件' AS count_label, category_label || ' / ' || language AS meta_label, './?id=' || id AS href, id = 'src3' AS is_selected FROM src"))
_simple("home_stats", lambda s, d: V.home_stats(S.meta(B.public(s, d), B.GENERATED_AT)), with_ctes("pub", "SELECT 0::BIGINT AS ord, '記事数' AS label, count(*)::VARCHAR AS value FROM pub UNION ALL SELECT 1, '媒体数', count(DISTINCT source_id)::VARCHAR FROM pub UNION ALL SELECT 2, 'カテゴリ数', count(DISTINCT category_id)::VARCHAR FROM pub"))
_simple("category_page", lambda s, d: V.page_of(B.public(s, d), "category_id", "asia").select("id", "sort_at"), with_ctes("pub", "SELECT id, sort_at FROM pub WHERE category_id = 'asia'"))
_simple("source_page", lambda s, d: V.page_of(B.public(s, d), "source_id", "src3").select("id", "sort_at"), with_ctes("pub", "SELECT id, sort_at FROM pub WHERE source_id = 'src3'"))
_simple(
    "page_state",
    lambda s, d: V.page_state(B.registry(s, d).select(F.when(F.col("pos") == 0, "").when(F.col("pos") == 1, "nobody").otherwise(F.col("id")).alias("wanted")), B.registry(s, d), B.public(s, d), "source_id"),
    with_ctes("pub", "SELECT CASE WHEN pos = 0 THEN '' WHEN pos = 1 THEN 'nobody' ELSE reg.id END AS wanted, CASE WHEN pos = 0 THEN 'missing' WHEN pos = 1 THEN 'unknown' WHEN n IS NULL THEN 'empty' ELSE 'ready' END AS state, CASE WHEN pos > 1 THEN coalesce(n, 0) ELSE 0 END AS articles FROM reg LEFT JOIN (SELECT source_id, count(*) AS n FROM pub GROUP BY 1) ON source_id = reg.id"),
)
_E = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_CARD = f"""SELECT id, '<article><h3>' || {_E("title")} || '</h3><p>' || {_E("source_name")} || ' / ' || {_E("category_label")} || '</p><p>' || {_E("coalesce(nullif(summary, ''), '要約はありません。')")} || '</p>' ||
  CASE WHEN url LIKE 'https://%' THEN '<a href="' || {_E("replace(url, 'Example.com:443', 'example.com')")} || '" target="_blank" rel="noopener noreferrer">元記事で続きを読む</a>' ELSE '<span>元記事リンクを確認できません。</span>' END || '</article>' AS html FROM pub"""
_simple("render_card_html", lambda s, d: V.card_html(V.article_view(B.public(s, d))).select("id", F.sha2("html", 256).alias("html")), with_ctes("pub", f"SELECT id, sha256(html) AS html FROM ({_CARD})"))

# ---------------------------------------------------------------- shelves, tags, search

_simple("shelf_registry", lambda s, d: B.shelves(s, d), with_ctes("shelf", "SELECT * FROM shelf"))
_simple(
    "shelf_id_violations",
    lambda s, d: DC.shelf_violations(B.shelves(s, d).select("id").unionByName(B.table(s, d, "region").select(F.col("r_name").alias("id"))).unionByName(B.table(s, d, "region").select(F.when(F.col("r_regionkey") < 2, "tags").otherwise("search").alias("id")))),
    with_ctes("shelf", "SELECT r_name AS id, 'not kebab-case' AS reason FROM region UNION ALL SELECT unnest(['tags', 'search']), 'reserved' UNION ALL SELECT unnest(['tags', 'search']), 'repeated'"),
)
_simple("shelf_fk_violations", lambda s, d: DC.shelf_key_violations(B.shelved_registry(s, d), B.shelves(s, d)), with_ctes("sreg", "SELECT id AS source_id, 'nowhere' AS shelf_id FROM sreg WHERE pos % 7 = 0"))
_simple("tag_explode", lambda s, d: DC.exploded_tags(B.tagged(s, d)).groupBy("tag_id", "origin").agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.col("origin").cast("long")), with_ctes("tags", "SELECT tag_id, origin::BIGINT AS origin, count(*) AS n FROM tags GROUP BY ALL"))
_simple("tag_summary", lambda s, d: DC.tag_summary(DC.exploded_tags(B.tagged(s, d))), with_ctes("tags", "SELECT tag_id, arg_min(label, {'o': origin, 'l': label}) AS label, count(DISTINCT id) AS article_count, count(DISTINCT source_id) AS source_count, max(sort_at) AS latest_sort_at FROM tags GROUP BY 1"))
_simple("tags_ranked", lambda s, d: RK.ranked(DC.tag_summary(DC.exploded_tags(B.tagged(s, d))), F.desc("article_count"), F.desc("latest_sort_at"), F.asc("label")).select("tag_id", "rank"), with_ctes("tags", "SELECT tag_id, row_number() OVER (ORDER BY n DESC, l DESC, label) AS rank FROM (SELECT tag_id, arg_min(label, {'o': origin, 'l': label}) AS label, count(DISTINCT id) AS n, max(sort_at) AS l FROM tags GROUP BY 1)"))
_simple("tag_page", lambda s, d: DC.tag_page(B.tagged(s, d), "t", False), with_ctes("tags", "SELECT DISTINCT id, sort_at FROM tags WHERE tag_id = 't'"))
_simple("tag_related_shelves", lambda s, d: DC.tag_shelves(DC.exploded_tags(B.tagged(s, d)), B.shelves(s, d)), with_ctes("tags shelf", "SELECT tag_id, string_agg(shelf.id, ',' ORDER BY shelf_ord) AS shelf_ids FROM (SELECT DISTINCT tag_id, unnest(shelf_ids) AS s FROM tags) JOIN shelf ON shelf.id = s GROUP BY 1"))
_simple("shelf_page", lambda s, d: B.tagged(s, d).where(F.array_contains("shelf_ids", "europe")).select("id", "sort_at"), with_ctes("tagd", "SELECT id, sort_at FROM tagd WHERE list_contains(shelf_ids, 'europe')"))
_simple(
    "shelf_summary",
    lambda s, d: DC.shelf_summary(B.tagged(s, d), B.shelves(s, d)),
    with_ctes("tagd shelf", """SELECT * FROM (WITH x AS (SELECT unnest(shelf_ids) AS s, * FROM tagd), c AS (SELECT s, count(DISTINCT id) AS a, count(DISTINCT source_id) AS b, max(sort_at) AS l FROM x GROUP BY 1),
t AS (SELECT s, tag, row_number() OVER (PARTITION BY s ORDER BY count(*) DESC, tag) AS p FROM (SELECT s, unnest(list_concat(source_tags, entry_tags)) AS tag FROM x) GROUP BY s, tag), g AS (SELECT s, string_agg(tag, ',' ORDER BY p) AS tags FROM t WHERE p <= 3 GROUP BY 1)
SELECT shelf.id, title, shelf_ord, coalesce(a, 0) AS article_count, coalesce(b, 0) AS source_count, l AS latest_sort_at, coalesce(tags, '') AS sample_tags FROM shelf LEFT JOIN c ON c.s = shelf.id LEFT JOIN g ON g.s = shelf.id)"""),
)
_simple(
    "shelf_featured",
    lambda s, d: DC.featured(B.tagged(s, d)),
    with_ctes("tagd", "SELECT s AS shelf_id, p AS place, id FROM (SELECT s, id, row_number() OVER (PARTITION BY s ORDER BY (coalesce(summary, '') <> '')::INT + (coalesce(image_url, '') <> '')::INT + 1 DESC, sort_at DESC, id) AS p FROM (SELECT unnest(shelf_ids) AS s, * FROM tagd)) WHERE p <= 6"),
)
_simple("visible_tags", lambda s, d: B.tagged(s, d).select("id", "source_id", F.array_join(DC.visible_tags(F.col("entry_tags"), F.col("source_tags")), ",").alias("tags")), with_ctes("tagd", "SELECT id, source_id, array_to_string(list_concat(entry_tags, source_tags)[1:3], ',') AS tags FROM tagd"))
_simple(
    "source_profile",
    lambda s, d: S.source_summary(B.public(s, d), B.registry(s, d)).join(B.shelved_registry(s, d).select(F.col("id"), _joined("shelf_ids"), _joined("source_tags")), "id").select("id", "name", "site_url", "language", "shelf_ids", "source_tags", "article_count", "latest_sort_at"),
    with_ctes("src sreg", "SELECT src.id, src.name, src.site_url, src.language, array_to_string(shelf_ids, ',') AS shelf_ids, array_to_string(source_tags, ',') AS source_tags, article_count, latest_sort_at FROM src JOIN sreg USING (id)"),
)
_simple("meta_v2", lambda s, d: S.meta(B.public(s, d), B.GENERATED_AT).drop("category_count").join(B.shelves(s, d).agg(F.count(F.lit(1)).alias("shelf_count"))).join(DC.exploded_tags(B.tagged(s, d)).agg(F.count_distinct("tag_id").alias("tag_count"))), with_ctes("tags shelf", f"SELECT '{B.GENERATED_AT}' AS generated_at, (SELECT count(*) FROM pub) AS article_count, (SELECT count(DISTINCT source_id) FROM pub) AS source_count, (SELECT count(*) FROM shelf) AS shelf_count, (SELECT count(DISTINCT tag_id) FROM tags) AS tag_count"))
_simple("search_index", lambda s, d: DC.search_index(B.tagged(s, d)), with_ctes("idx", "SELECT * FROM idx"))
_TERMS = """WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\\s+', ' ', 'g')), ' ') AS w FROM documents),
t AS (SELECT doc_id, t, min(p) AS p FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM w) WHERE t <> '' GROUP BY 1, 2),
g AS (SELECT doc_id, count(*) AS n, string_agg(t, '|' ORDER BY p) AS s FROM t GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_terms, sha256(coalesce(s, '')) AS terms_sha256 FROM documents d LEFT JOIN g USING (doc_id)"""


def _terms(s, d):
    """Number and SHA-256 of the terms of whole texts."""
    rows = _docs(s, d).select("doc_id", DC.terms_of(F.coalesce("text", F.lit(""))).alias("terms"))
    return rows.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.sha2(F.array_join("terms", "|"), 256).alias("terms_sha256"))


_simple("search_terms", _terms, _TERMS)
_HIT = " AND ".join(f"contains(search_text, '{t}')" for t in SEARCH.split())
_POINTS = " + ".join(f"CASE WHEN contains({p}_text, '{t}') THEN {DC.WEIGHTS[p]} ELSE 0 END" for t in SEARCH.split() for p in ("title", "source", "tag"))
_POINTS += f" + CASE WHEN title_text = '{SEARCH}' THEN 100 WHEN contains(title_text, '{SEARCH}') THEN 40 ELSE 0 END"
_simple("search_match", lambda s, d: DC.search(DC.search_index(B.tagged(s, d)), SEARCH).select("id", "sort_at"), with_ctes("idx", f"SELECT id, sort_at FROM idx WHERE {_HIT}"))
_simple("search_score", lambda s, d: DC.search(DC.search_index(B.tagged(s, d)), SEARCH).select("id", "sort_at", "score"), with_ctes("idx", f"SELECT id, sort_at, ({_POINTS})::BIGINT AS score FROM idx WHERE {_HIT}"))
_simple(
    "search_results",
    lambda s, d: DC.search_results(B.tagged(s, d), SEARCH),
    with_ctes("idx", f"SELECT i.id, title, score, rank FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, sort_at DESC, id) AS rank FROM (SELECT id, sort_at, ({_POINTS})::BIGINT AS score FROM idx WHERE {_HIT})) i JOIN pub ON pub.id = i.id"),
)
def _indexed(s, d):
    """What search_match finds, by way of the postings."""
    index = DC.search_index(B.tagged(s, d))
    postings = PO.build(index)
    return PO.indexed_search(index, postings, PO.sizes(postings), SEARCH).select("id", "sort_at")


_simple("search_indexed", _indexed, with_ctes("idx", f"SELECT id, sort_at FROM idx WHERE {_HIT}"))
_simple(
    "trigram_sizes",
    lambda s, d: PO.sizes(PO.build(DC.search_index(B.tagged(s, d)))).select("gram", "n"),
    with_ctes("idx", "SELECT gram, count(*) AS n FROM (SELECT DISTINCT place, unnest(list_transform(range(1, len(search_text) - 1), lambda i: substr(search_text, i, 3))) AS gram FROM (SELECT row_number() OVER () AS place, search_text FROM idx)) GROUP BY gram"),
)
_simple("search_state", lambda s, d: DC.search_state(DC.search_index(B.tagged(s, d)), ["", SEARCH, "no such words"]), with_ctes("idx", f"SELECT '' AS query, 'helper' AS state, 0::BIGINT AS hits UNION ALL SELECT '{SEARCH}', CASE WHEN count(*) > 0 THEN 'ready' ELSE 'no-result' END, count(*) FROM idx WHERE {_HIT} UNION ALL SELECT 'no such words', 'no-result', 0"))
