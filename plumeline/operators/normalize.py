"""Feed documents to canonical articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import feedxml as X
from ..functions.ids import article_id, dedupe_key
from ..functions.text import bound, filled, slugify
from ..functions.times import iso, parse_date
from ..functions.urls import normalize_url


def split_items(documents: DataFrame) -> DataFrame:
    """(feed_id, doc_ord, fetched_at, kind, item_ord, block) of ``documents`` (feed_id, xml, fetched_at, doc_ord); blank or foreign documents stop the job."""
    kind = X.document_kind(F.col("xml"))
    docs = documents.withColumn("kind", F.when(kind.isin("rss", "atom"), kind).otherwise(F.raise_error(F.concat(F.lit("feed "), F.col("feed_id"), F.lit(": document is "), kind))))
    blocks = F.when(F.col("kind") == "rss", X.items(F.col("xml"), "item")).otherwise(X.items(F.col("xml"), "entry"))
    return docs.select("feed_id", "doc_ord", "fetched_at", "kind", F.posexplode(blocks).alias("item_ord", "block"))


#: Elements by part of an article, the first that has any text first, for each format.
RSS = {"title": ("title",), "summary": ("description", "summary", "content:encoded", "content"), "published_at": ("pubDate", "dc:date"), "author": ("author", "dc:creator"), "source_item_id": ("guid",)}
ATOM = {"title": ("title",), "summary": ("summary", "content", "description"), "published_at": ("published", "updated", "dc:date"), "source_item_id": ("id",)}


NAMES = list(dict.fromkeys(n for names in (*RSS.values(), *ATOM.values(), ("link",)) for n in names))


def parsed_items(items: DataFrame) -> DataFrame:
    """Items with title, url, summary, published_at, author, image_url and source_item_id, each format by its own rules.

    An entry is scanned once, whatever parts are asked for; the scan comes out of a generator, through which the engine
    moves no filter, as it would repeat the scan there. Parts that nobody reads are never worked out; the short ones are
    cleaned together, as every cleaning in a plan costs the driver time. Parts are lambdas, which the engine evaluates
    without generating code that grows with them.
    """
    at, is_rss, scanned = ["feed_id", "doc_ord", "item_ord", "fetched_at"], F.col("kind") == "rss", F.struct("pieces", "labels")
    rows = items.select(*at, "kind", F.inline(F.array(X.scan(F.col("block")))))
    person = bound(X.within(scanned, "author"), lambda s: F.array(F.get(X.texts_between(s, ["name"]), 0), X.whole_text(s)))
    rows = rows.select(*at, "kind", "pieces", "labels", X.texts_between(scanned, NAMES).alias("texts"), F.when(~is_rss, person).alias("person"))
    of = lambda names: F.array(*[F.get("texts", NAMES.index(n)) for n in names])
    either = lambda part: F.when(is_rss, of(RSS[part])).otherwise(of(ATOM[part]))
    short = F.array(of(["title"]), F.when(is_rss, of(RSS["author"])).otherwise(F.col("person")))
    plain = F.array(either("published_at"), either("source_item_id"), F.when(is_rss, of(["link"])))
    rows = rows.select(
        *at, "kind", "pieces", "labels", F.transform(short, lambda texts: X.first_cleaned(texts, X.display_text)).alias("short"), F.transform(plain, lambda texts: X.first_cleaned(texts, X.raw_text)).alias("plain"),
        X.first_cleaned(either("summary"), X.display_text).alias("summary"),
    )
    return rows.select(
        *at, F.get("short", 0).alias("title"), F.when(is_rss, F.get("plain", 2)).otherwise(X.picked_link(scanned)).alias("url"), "summary", bound(F.get("plain", 0), parse_date).alias("published_at"), F.get("short", 1).alias("author"),
        X.picked_image(scanned).alias("image_url"), F.get("plain", 1).alias("source_item_id"),
    )


def with_identity(articles: DataFrame) -> DataFrame:
    """Adds normalized_url, id and dedupe_key, each computed once."""
    keyed = articles.withColumn("normalized_url", normalize_url(F.col("url")))
    url, feed, item = F.col("normalized_url"), F.col("feed_id"), F.col("source_item_id")
    return keyed.withColumn("id", article_id(url, feed, item, F.col("title"), iso(F.col("published_at")))).withColumn("dedupe_key", dedupe_key(url, feed, item))


def strict_registry_join(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """``rows`` with the columns of their registry entry; a feed_id that is not registered stops the job.

    The registry is a hand-kept list, far below any broadcast threshold; Spark decides by its size. Category slugs are made
    there, a row for each feed, and not for each article.
    """
    entry = registry.select(F.col("id").alias("__id"), F.col("name").alias("source_name"), "category", slugify(F.col("category")).alias("category_id"), "language", "site_url")
    joined = rows.join(entry, F.col("feed_id") == F.col("__id"), "left")
    known = F.when(F.col("__id").isNotNull(), F.col("feed_id")).otherwise(F.raise_error(F.concat(F.lit("unknown feed: "), F.coalesce("feed_id", F.lit("null")))))
    return joined.withColumn("feed_id", known).drop("__id")


def canonical_articles(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Canonical article rows; entries without title or url are dropped as soon as they are parsed."""
    rows = parsed_items(split_items(documents)).where(filled(F.col("title")).isNotNull() & filled(F.col("url")).isNotNull())
    rows = with_identity(strict_registry_join(rows, registry))
    return rows.withColumn("tags", F.array().cast("array<string>")).withColumn("seen_in_feeds", F.array("feed_id"))
