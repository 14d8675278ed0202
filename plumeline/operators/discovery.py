"""Shelves, tags and search over public articles with shelf_ids, source_tags and entry_tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compare_key, norm_space
from .ranking import ranked

#: Ids that shelves may not have, as pages have them.
RESERVED = ("tags", "search", "sources", "categories", "assets", "data", "index")
#: What a term is worth where it is found; the whole query as title or in it counts most.
WEIGHTS = {"exact": 100, "phrase": 40, "title": 20, "source": 10, "tag": 5}
VISIBLE_TAGS, SAMPLE_TAGS, FEATURED = 3, 3, 6


def shelf_violations(shelves: DataFrame) -> DataFrame:
    """(id, reason) of shelves (id) whose id is reserved, not in kebab case, or there twice."""
    counted = shelves.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    reasons = F.array_compact(F.array(F.when(~F.regexp_like("id", F.lit("^[a-z0-9]+(?:-[a-z0-9]+)*$")), "not kebab-case"), F.when(F.col("id").isin(*RESERVED), "reserved"), F.when(F.col("n") > 1, "repeated")))
    return counted.select("id", F.explode(reasons).alias("reason"))


def shelf_key_violations(registry: DataFrame, shelves: DataFrame) -> DataFrame:
    """(source_id, shelf_id) that ``registry`` (id, shelf_ids) names and ``shelves`` (id) lacks."""
    named = registry.select(F.col("id").alias("source_id"), F.explode("shelf_ids").alias("shelf_id"))
    return named.join(shelves.select(F.col("id").alias("shelf_id")), "shelf_id", "left_anti").select("source_id", "shelf_id")


def visible_tags(entry: Column, source: Column) -> Column:
    return F.slice(F.array_distinct(F.concat(entry, source)), 1, VISIBLE_TAGS)


def exploded_tags(articles: DataFrame, compatible: bool = True) -> DataFrame:
    """(id, source_id, sort_at, tag_id, label, origin): origin 0 for a source's tag, 1 for an entry's."""
    both = F.concat(_with_origin("source_tags", 0), _with_origin("entry_tags", 1))
    rows = articles.select("id", "source_id", "sort_at", "shelf_ids", F.explode(both).alias("tag"))
    return rows.select("id", "source_id", "sort_at", "shelf_ids", compare_key(F.col("tag.label"), compatible).alias("tag_id"), norm_space(F.col("tag.label")).alias("label"), F.col("tag.origin").alias("origin")).where("tag_id <> ''")


def _with_origin(column: str, origin: int) -> Column:
    return F.transform(column, lambda t: F.struct(t.alias("label"), F.lit(origin).alias("origin")))


def tag_summary(tags: DataFrame) -> DataFrame:
    """From exploded tags: articles and sources once each, the latest date, and a source's label before an entry's."""
    return tags.groupBy("tag_id").agg(
        F.min(F.struct("origin", "label"))["label"].alias("label"), F.count_distinct("id").alias("article_count"), F.count_distinct("source_id").alias("source_count"), F.max("sort_at").alias("latest_sort_at")
    )


def tag_page(articles: DataFrame, tag_id: str, compatible: bool = True) -> DataFrame:
    """(id, sort_at) of public articles with a tag of this compare key, each once. Rows without URL and item, which the fold leaves as they are, share their id where source, title and date are the same."""
    return articles.where(F.exists(F.concat("source_tags", "entry_tags"), lambda t: compare_key(t, compatible) == tag_id)).select("id", "sort_at").distinct()


def tag_shelves(tags: DataFrame, shelves: DataFrame) -> DataFrame:
    """(tag_id, shelf_ids): shelves of the tag's articles in declared order, comma-joined; ``shelves`` (id, shelf_ord)."""
    named = tags.select("tag_id", F.explode("shelf_ids").alias("shelf_id")).distinct().join(shelves.select(F.col("id").alias("shelf_id"), "shelf_ord"), "shelf_id")
    return named.groupBy("tag_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shelf_ord", "shelf_id"))), lambda s: s["shelf_id"]), ",").alias("shelf_ids"))


def shelf_summary(articles: DataFrame, shelves: DataFrame) -> DataFrame:
    """One row for each of ``shelves`` (id, title, shelf_ord), also those without articles, with up to three frequent tags."""
    named = articles.withColumn("shelf_id", F.explode("shelf_ids"))
    counts = named.groupBy("shelf_id").agg(F.count_distinct("id").alias("article_count"), F.count_distinct("source_id").alias("source_count"), F.max("sort_at").alias("latest_sort_at"))
    tags = named.select("shelf_id", F.explode(F.concat("source_tags", "entry_tags")).alias("tag")).groupBy("shelf_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("shelf_id").orderBy(F.desc("n"), "tag"))
    sample = tags.withColumn("place", place).where(F.col("place") <= SAMPLE_TAGS).groupBy("shelf_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda s: s["tag"]), ",").alias("sample_tags"))
    joined = shelves.join(counts, shelves["id"] == counts["shelf_id"], "left").drop("shelf_id").join(sample, shelves["id"] == sample["shelf_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("id", "title", F.col("shelf_ord").cast("long").alias("shelf_ord"), zero("article_count"), zero("source_count"), "latest_sort_at", F.coalesce("sample_tags", F.lit("")).alias("sample_tags"))


def featured(articles: DataFrame, most: int = FEATURED) -> DataFrame:
    """(shelf_id, place, id): up to ``most`` of each shelf; rows with summary, image and tags first, then the newest.

    Spark keeps ``most`` rows of a shelf in each task before it deals them out, as the place is bounded.
    """
    good = (F.coalesce("summary", F.lit("")) != "").cast("int") + (F.coalesce("image_url", F.lit("")) != "").cast("int") + (F.size(F.concat("source_tags", "entry_tags")) > 0).cast("int")
    rows = articles.select(F.explode("shelf_ids").alias("shelf_id"), "id", "sort_at", good.alias("good"))
    place = F.row_number().over(Window.partitionBy("shelf_id").orderBy(F.desc("good"), F.desc("sort_at"), "id"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("shelf_id", "place", "id")


def search_index(articles: DataFrame, compatible: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """Search texts of public articles with source_tags and entry_tags; ``extra`` names columns to go along."""
    title, source = compare_key(F.col("title"), compatible), compare_key(F.col("source_name"), compatible)
    tag = compare_key(F.array_join(F.concat("source_tags", "entry_tags"), " "), compatible)
    return articles.select("id", "sort_at", title.alias("title_text"), source.alias("source_text"), tag.alias("tag_text"), norm_space(F.concat_ws(" ", title, source, tag)).alias("search_text"), *extra)


def terms_of(text: Column) -> Column:
    """The distinct terms of texts, in order of their first places."""
    return F.array_distinct(F.filter(F.split(compare_key(text), " "), lambda t: t != ""))


def terms(query: str) -> list[str]:
    import unicodedata

    return list(dict.fromkeys(" ".join(unicodedata.normalize("NFKC", query).split()).casefold().split()))


def search(index: DataFrame, query: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, sort_at, score) of rows in which every term is found somewhere; an empty query finds nothing."""
    found = terms(query)
    if not found:
        return index.where("false").select("id", "sort_at", *extra, F.lit(0).cast("long").alias("score"))
    phrase, match, score = " ".join(dict.fromkeys(found)), F.lit(True), F.lit(0)
    for term in found:
        match = match & F.col("search_text").contains(term)
        for part in ("title", "source", "tag"):
            score = score + F.when(F.col(f"{part}_text").contains(term), WEIGHTS[part]).otherwise(0)
    score = score + F.when(F.col("title_text") == phrase, WEIGHTS["exact"]).when(F.col("title_text").contains(phrase), WEIGHTS["phrase"]).otherwise(0)
    return index.where(match).select("id", "sort_at", *extra, score.cast("long").alias("score"))


def search_results(articles: DataFrame, query: str) -> DataFrame:
    """(id, title, score, rank) of the hits among public articles with shelf_ids and tags, the best first; titles come with the hits, so articles are read once."""
    index = search_index(articles, extra=("title",))
    return ranked(search(index, query, extra=("title",)), F.desc("score"), F.desc("sort_at"), F.asc("id")).select("id", "title", "score", "rank")


def search_state(index: DataFrame, queries: list[str]) -> DataFrame:
    """(query, state, hits): helper for an empty query, no-result, or ready."""
    spark, parts = index.sparkSession, None
    for q in queries:
        hits = search(index, q).agg(F.count(F.lit(1)).alias("hits"))
        row = hits.select(F.lit(q).alias("query"), F.when(F.lit(not terms(q)), "helper").when(F.col("hits") == 0, "no-result").otherwise("ready").alias("state"), "hits")
        parts = row if parts is None else parts.unionByName(row)
    return parts if parts is not None else spark.createDataFrame([], "query string, state string, hits long")
