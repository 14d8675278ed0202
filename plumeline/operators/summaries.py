"""Public listings: articles, categories, sources and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..functions.times import iso
from .dedupe import with_category_id

MICROS = 1_000_000


def sort_at(published: Column, fetched: Column) -> Column:
    return F.coalesce(published, fetched)


def category_collisions(labels: DataFrame) -> DataFrame:
    """(category_id, labels) where unlike labels (column category) share a slug."""
    slugs = labels.select("category").distinct().withColumn("category_id", slugify(F.col("category")))
    return slugs.groupBy("category_id").agg(F.array_sort(F.collect_set("category")).alias("labels")).where(F.size("labels") > 1)


def public_articles(articles: DataFrame) -> DataFrame:
    """The published columns; a category whose slug is empty stops the job."""
    articles, slug = with_category_id(articles), F.col("category_id")
    at = sort_at(F.col("published_at"), F.col("fetched_at"))
    return articles.select(
        "id", "title", "url", "summary", iso(F.col("published_at")).alias("published_at"), iso(at).alias("sort_at"), F.unix_millis(at).alias("sort_ms"), F.col("feed_id").alias("source_id"),
        "source_name", F.when(slug != "", slug).otherwise(F.raise_error(F.concat(F.lit("category without a slug: "), F.col("category")))).alias("category_id"), F.col("category").alias("category_label"), "image_url",
    )


def article_order() -> list[Column]:
    return [F.col("sort_ms").desc_nulls_last(), F.collate("title", "en").asc(), F.collate("id", "en").asc(), F.col("id").asc()]


def sorted_articles(public: DataFrame) -> DataFrame:
    return public.orderBy(*article_order())


def category_summary(public: DataFrame) -> DataFrame:
    return public.groupBy("category_id").agg(F.min("category_label").alias("label"), F.count(F.lit(1)).alias("article_count"), F.max("sort_at").alias("latest_sort_at"))


def source_summary(public: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources with articles; name and category are the registry's. An article of no registered source stops the job."""
    counts = public.groupBy("source_id").agg(F.count(F.lit(1)).alias("article_count"), F.max("sort_at").alias("latest_sort_at"))
    entry = registry.select(F.col("id").alias("__id"), "name", "site_url", "language", "category")
    joined = counts.join(entry, F.col("source_id") == F.col("__id"), "left")
    known = F.when(F.col("__id").isNotNull(), F.col("source_id")).otherwise(F.raise_error(F.concat(F.lit("unknown source: "), F.col("source_id"))))
    return joined.select(known.alias("id"), "name", "site_url", "language", slugify(F.col("category")).alias("category_id"), F.col("category").alias("category_label"), "article_count", "latest_sort_at")


def meta(public: DataFrame, generated_at: str) -> DataFrame:
    """One row of counts; distinct ids are found by partial aggregates, never gathered."""
    return public.agg(F.lit(generated_at).alias("generated_at"), F.count(F.lit(1)).alias("article_count"), F.count_distinct("source_id").alias("source_count"), F.count_distinct("category_id").alias("category_count"))
