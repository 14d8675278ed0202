"""Identities of articles: ids, dedupe keys and how complete a row is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm_space


def hash_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 24)


def title_key(title: Column) -> Column:
    return F.lower(norm_space(F.coalesce(title, F.lit(""))))


def article_id(normalized_url: Column, feed_id: Column, item_id: Column, title: Column, published_iso: Column) -> Column:
    by_item = F.concat(F.lit("feed:"), feed_id, F.lit("|item:"), item_id)
    by_title = F.concat(F.lit("fallback:"), feed_id, F.lit("|"), title_key(title), F.lit("|"), F.coalesce(published_iso, F.lit("")))
    return hash_id(F.coalesce(F.concat(F.lit("url:"), normalized_url), by_item, by_title))


def dedupe_key(normalized_url: Column, feed_id: Column, item_id: Column) -> Column:
    """Null where an article can never be told to be the same as another."""
    return F.coalesce(F.concat(F.lit("url:"), normalized_url), F.concat(F.lit("feed-item:"), feed_id, F.lit(":"), F.nullif(item_id, F.lit(""))))


def richness(published: Column, author: Column, image: Column, summary: Column, tags: Column) -> Column:
    """How many of five optional parts a row has."""
    there = [published.isNotNull(), *[F.coalesce(c, F.lit("")) != "" for c in (author, image, summary)], F.size(tags) > 0]
    total = there[0].cast("int")
    for t in there[1:]:
        total = total + t.cast("int")
    return total
