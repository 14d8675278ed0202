"""The test tables seen as a registry, feed documents, articles, shelves and tags, in Spark and in SQL.

nation and region make the registry; each row of documents is an article, and also a feed document of two entries, RSS
for even sources and Atom for odd ones; regions are shelves. Every row counts, and summaries and feed documents carry whole
texts; a title, as these tables have none, is the first 80 characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import dedupe
from ..operators.normalize import strict_registry_join, with_identity
from ..operators.summaries import public_articles

GENERATED_AT = "2024-06-02T00:00:00.000Z"
PUBLISHED_FROM, FETCHED_FROM = 1704067200, 1717200000
LANGUAGES = ("en", "fr", "de", "es")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    feed = F.concat(F.lit("src"), key.cast("string"))
    return joined.select(
        feed.alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("category"), F.concat(F.lit("https://feeds.example.net/"), feed, F.lit(".xml")).alias("feed_url"),
        F.concat(F.lit("https://"), feed, F.lit(".example.net/")).alias("site_url"), F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (key % 4 + 1).cast("int")).alias("language"),
        (key % 5 != 4).alias("enabled"), key.cast("long").alias("pos"),
    )


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    link = F.concat(F.lit("https://Example.com:443/a/"), F.substring(F.sha2(text, 256), 1, 12), F.lit("/?utm_source="), F.col("source"), F.lit("&b=2&a=1#f"))
    name = lambda prefix, n=i, suffix="": F.concat(F.lit(prefix), n.cast("string"), F.lit(suffix))
    return table(spark, sf_dir, "documents").select(
        F.substring("source", 4, 10).cast("long").alias("doc_ord"), i.alias("item_ord"), F.col("source").alias("feed_id"), _one_line(F.substring(text, 1, 80)).alias("title"),
        F.when(i % 11 == 0, name("item ")).otherwise(link).alias("url"), F.when(i % 7 != 0, text).alias("summary"),
        F.when(i % 3 != 0, F.timestamp_seconds(F.lit(PUBLISHED_FROM) + i * 60)).alias("published_at"), F.when(i % 2 == 0, name("author ", i % 7)).alias("author"),
        F.when(i % 5 == 0, name("https://img.example.net/", i, ".png")).alias("image_url"), F.when(i % 33 != 0, name("item-")).alias("source_item_id"),
        F.timestamp_seconds(F.lit(FETCHED_FROM + 1000) - i % 3).alias("fetched_at"), F.when(i % 4 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.array("source").alias("seen_in_feeds"), text.alias("text"), F.col("lang"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_identity(strict_registry_join(items(spark, sf_dir), registry(spark, sf_dir)))


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(articles(spark, sf_dir))


def public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return public_articles(deduped(spark, sf_dir))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed_id, xml, fetched_at, doc_ord): an entry for each article and one without a title after it."""
    part = lambda start, value, end: F.coalesce(F.concat(F.lit(start), _escaped(value), F.lit(end)), F.lit(""))
    date, image = F.col("published_at"), F.col("image_url")
    rss = F.concat(
        F.lit('<?xml version="1.0"?><RSS version="2.0"><channel><title>all</title><item><title>  '), _escaped(F.col("title")), F.lit(" </title>"), part("<link>", F.col("url"), "</link>"), part("<guid>", F.col("source_item_id"), "</guid>"),
        part("<pubDate>Mon, ", F.date_format(date, "d MMM yyyy HH:mm:ss"), " +0000</pubDate>"), part("<author>", F.col("author"), "</author>"), part('<media:content url="', image, '" medium="image"/>'),
        F.lit("<description>"), _escaped(F.col("text")), F.lit("</description></item><item><title></title><link>https://example.com/none</link></item></channel></RSS>"),
    )
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>all</title><entry><title type="text">'), _escaped(F.col("title")), F.lit('</title><link rel="self" href="https://example.com/self"/>'), part("<link href='", F.col("url"), "'/>"), part("<id>", F.col("source_item_id"), "</id>"),
        part("<updated>", F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "</updated>"), part("<author><name>", F.col("author"), "</name></author>"), part("<enclosure url='", image, "'></enclosure>"),
        F.lit("<summary>"), _escaped(F.col("text")), F.lit("</summary></entry><entry><title/></entry></feed>"),
    )
    # out of a generator, as from a file: otherwise the engine writes the document anew wherever it is read
    xml = F.explode(F.array(F.when(F.col("doc_ord") % 2 == 0, rss).otherwise(atom))).alias("xml")
    return items(spark, sf_dir).select("feed_id", xml, "fetched_at", F.col("item_ord").alias("doc_ord"))


def shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.replace(F.lower("r_name"), F.lit(" "), F.lit("-"))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("shelf_ord"), low.alias("id"), F.col("r_name").alias("title"))


def shelved_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry with shelf_ids and source_tags; every seventh names a shelf that there is not."""
    low = F.replace(F.lower("category"), F.lit(" "), F.lit("-"))
    return registry(spark, sf_dir).withColumn("shelf_ids", F.when(F.col("pos") % 7 == 0, F.array(low, F.lit("nowhere"))).otherwise(F.array(low))).withColumn("source_tags", F.array(F.initcap("category"), F.col("language")))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public articles with shelf_ids, source_tags and entry_tags (language and first word of the title)."""
    entry = shelved_registry(spark, sf_dir).select(F.col("id").alias("source_id"), "shelf_ids", "source_tags")
    first = F.regexp_extract("title", "^([A-Za-z]+)", 1)
    rows = public(spark, sf_dir).join(entry, "source_id")
    return rows.withColumn("entry_tags", F.when(first != "", F.array(F.upper(F.regexp_extract("title", "^([A-Za-z])", 1)))).otherwise(F.array().cast("array<string>")))


# ---------------------------------------------------------------- the same in SQL

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def iso_sql(ts: str) -> str:
    return _ISO.format(ts)


def _score(x: str) -> str:
    return f"(({x}.pub IS NOT NULL)::INT + (coalesce({x}.author, '') <> '')::INT + (coalesce({x}.image, '') <> '')::INT + (coalesce({x}.summary, '') <> '')::INT + (len({x}.tags) > 0)::INT)"


def _merge_sql() -> str:
    size = lambda x: f"length(coalesce({x}.summary, ''))"
    wins = f"(CASE WHEN {_score('a')} <> {_score('b')} THEN {_score('a')} > {_score('b')} WHEN {size('a')} <> {size('b')} THEN {size('a')} > {size('b')} ELSE a.fetched <= b.fetched END)"
    w = lambda f: f"(CASE WHEN {wins} THEN a.{f} ELSE b.{f} END)"
    x = lambda f: f"(CASE WHEN {wins} THEN b.{f} ELSE a.{f} END)"
    both = lambda f: f"list_filter(list_concat({w(f)}, {x(f)}), lambda v, i: list_position(list_concat({w(f)}, {x(f)}), v) = i)"
    parts = {f: f"a.{f}" for f in ("doc_ord", "item_ord")} | {f: w(f) for f in ("id", "feed_id", "title", "url")}
    parts["summary"] = f"CASE WHEN length(coalesce({x('summary')}, '')) > length(coalesce({w('summary')}, '')) THEN {x('summary')} ELSE coalesce(nullif({w('summary')}, ''), nullif({x('summary')}, '')) END"
    parts |= {"pub": f"coalesce({w('pub')}, {x('pub')})", "fetched": "least(a.fetched, b.fetched)"}
    parts |= {f: f"coalesce(nullif({w(f)}, ''), nullif({x(f)}, ''))" for f in ("author", "image", "item")}
    parts |= {f: both(f) for f in ("tags", "seen")}
    return "{" + ", ".join(f"'{k}': {v}" for k, v in parts.items()) + "}"


_FIELDS = ("doc_ord", "item_ord", "id", "feed_id", "title", "url", "summary", "pub", "fetched", "author", "image", "item", "tags", "seen")
FOLD = "replace(lower({}), 'ß', 'ss')"  # full case folding, as far as these tables need it
SLUG = "regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g')"
CTES = {
    "reg": """SELECT 'src' || n_nationkey AS id, n_name AS name, r_name AS category, 'https://feeds.example.net/src' || n_nationkey || '.xml' AS feed_url, 'https://src' || n_nationkey || '.example.net/' AS site_url,
      (['en', 'fr', 'de', 'es'])[(n_nationkey % 4 + 1)::INT] AS language, n_nationkey % 5 <> 4 AS enabled, n_nationkey::BIGINT AS pos FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "raw": """SELECT substr(source, 4)::BIGINT AS doc_ord, doc_id AS item_ord, source AS feed_id, trim(regexp_replace(substr(coalesce(text, ''), 1, 80), '\\s+', ' ', 'g')) AS title,
      CASE WHEN doc_id % 11 = 0 THEN 'item ' || doc_id ELSE 'https://Example.com:443/a/' || substr(sha256(coalesce(text, '')), 1, 12) || '/?utm_source=' || source || '&b=2&a=1#f' END AS url,
      CASE WHEN doc_id % 11 <> 0 THEN 'https://example.com/a/' || substr(sha256(coalesce(text, '')), 1, 12) || '?a=1&b=2' END AS nurl,
      CASE WHEN doc_id % 7 <> 0 THEN coalesce(text, '') END AS summary, CASE WHEN doc_id % 3 <> 0 THEN make_timestamp((1704067200 + doc_id * 60) * 1000000) END AS pub,
      CASE WHEN doc_id % 2 = 0 THEN 'author ' || doc_id % 7 END AS author, CASE WHEN doc_id % 5 = 0 THEN 'https://img.example.net/' || doc_id || '.png' END AS image,
      CASE WHEN doc_id % 33 <> 0 THEN 'item-' || doc_id END AS item, make_timestamp((1717201000 - doc_id % 3) * 1000000) AS fetched, CASE WHEN doc_id % 4 = 0 THEN [lang] ELSE []::VARCHAR[] END AS tags,
      [source] AS seen, coalesce(text, '') AS text, lang FROM documents""",
    "art": f"""SELECT *, coalesce('url:' || nurl, 'feed-item:' || feed_id || ':' || item) AS key,
      substr(sha256(coalesce('url:' || nurl, 'feed:' || feed_id || '|item:' || item, 'fallback:' || feed_id || '|' || lower(title) || '|' || coalesce({iso_sql("pub")}, ''))), 1, 24) AS id FROM raw""",
    "fold": "SELECT key, count(*)::BIGINT AS merged, list_reduce(list({" + ", ".join(f"'{f}': {f}" for f in _FIELDS) + "} ORDER BY doc_ord, item_ord), lambda a, b: " + _merge_sql() + ") AS a FROM art WHERE key IS NOT NULL GROUP BY key",
    "ded": "SELECT key, merged, " + ", ".join(f"a.{f} AS {f}" for f in _FIELDS) + " FROM fold UNION ALL SELECT key, 1 AS merged, " + ", ".join(_FIELDS) + " FROM art WHERE key IS NULL",
    "pub": f"""SELECT d.id, title, url, summary, {iso_sql("pub")} AS published_at, {iso_sql("coalesce(pub, fetched)")} AS sort_at, epoch_ms(coalesce(pub, fetched)) AS sort_ms, feed_id AS source_id, reg.name AS source_name,
      {SLUG.format("reg.category")} AS category_id, reg.category AS category_label, image AS image_url FROM ded d JOIN reg ON reg.id = d.feed_id""",
    "cat": "SELECT category_id, min(category_label) AS label, count(*) AS article_count, max(sort_at) AS latest_sort_at FROM pub GROUP BY 1",
    "src": f"SELECT reg.id, reg.name, reg.site_url, reg.language, {SLUG.format('reg.category')} AS category_id, reg.category AS category_label, n AS article_count, latest_sort_at FROM (SELECT source_id, count(*) AS n, max(sort_at) AS latest_sort_at FROM pub GROUP BY 1) JOIN reg ON reg.id = source_id",
    "shelf": "SELECT r_regionkey::BIGINT AS shelf_ord, replace(lower(r_name), ' ', '-') AS id, r_name AS title FROM region",
    "sreg": "SELECT *, CASE WHEN pos % 7 = 0 THEN [replace(lower(category), ' ', '-'), 'nowhere'] ELSE [replace(lower(category), ' ', '-')] END AS shelf_ids, [array_to_string(list_transform(string_split(lower(category), ' '), lambda w: upper(w[1]) || w[2:]), ' '), language] AS source_tags FROM reg",
    "tagd": "SELECT pub.*, shelf_ids, source_tags, CASE WHEN regexp_matches(title, '^[A-Za-z]') THEN [upper(title[1])] ELSE []::VARCHAR[] END AS entry_tags FROM pub JOIN sreg ON sreg.id = source_id",
    "tags": "SELECT id, source_id, sort_at, shelf_ids, lower(label) AS tag_id, label, origin FROM (SELECT id, source_id, sort_at, shelf_ids, unnest(source_tags) AS label, 0 AS origin FROM tagd UNION ALL SELECT id, source_id, sort_at, shelf_ids, unnest(entry_tags), 1 FROM tagd)",
    "idx": f"SELECT id, sort_at, {FOLD.format('title')} AS title_text, lower(source_name) AS source_text, lower(array_to_string(list_concat(source_tags, entry_tags), ' ')) AS tag_text, trim(regexp_replace(concat_ws(' ', {FOLD.format('title')}, lower(source_name), lower(array_to_string(list_concat(source_tags, entry_tags), ' '))), '\\s+', ' ', 'g')) AS search_text FROM tagd",
}
NEEDS = {
    "art": ["raw"], "fold": ["raw", "art"], "ded": ["raw", "art", "fold"], "pub": ["reg", "raw", "art", "fold", "ded"], "cat": ["reg", "raw", "art", "fold", "ded", "pub"], "src": ["reg", "raw", "art", "fold", "ded", "pub"], "sreg": ["reg"],
    "tagd": ["reg", "raw", "art", "fold", "ded", "pub", "sreg"], "tags": ["reg", "raw", "art", "fold", "ded", "pub", "sreg", "tagd"], "idx": ["reg", "raw", "art", "fold", "ded", "pub", "sreg", "tagd"],
}


def with_ctes(names: str, body: str) -> str:
    wanted = {x for n in names.split() for x in [*NEEDS.get(n, []), n]}
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in wanted) + "\n" + body
