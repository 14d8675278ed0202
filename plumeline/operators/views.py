"""Rows as pages show them: article cards, navigation, home, category and source pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_label, escape_html, filled
from ..functions.times import date_label
from ..functions.urls import page_href, safe_link

#: Labels shown on pages.
NO_SUMMARY = "要約はありません。"
READ_ON = "元記事で続きを読む"
NO_LINK = "元記事リンクを確認できません。"
UNKNOWN_UPDATE = "更新時刻不明"
STATS = (("記事数", "article_count"), ("媒体数", "source_count"), ("カテゴリ数", "category_count"))


def article_view(public: DataFrame) -> DataFrame:
    url = safe_link(F.col("url"))
    return public.select(
        "id", "title", url.alias("url"), "source_name", "category_label", date_label(F.to_timestamp(F.coalesce("published_at", "sort_at"))).alias("published_at_label"),
        F.coalesce(filled(F.col("summary")), F.lit(NO_SUMMARY)).alias("summary"), filled(F.col("summary")).isNotNull().alias("has_summary"), filled(F.col("image_url")).alias("image_url"),
        url.isNotNull().alias("can_open_external"), F.when(url.isNotNull(), READ_ON).otherwise(NO_LINK).alias("link_text"),
    )


def category_nav(categories: DataFrame, selected: str | None = None, section: str | None = "categories") -> DataFrame:
    return categories.select(F.col("category_id").alias("id"), "label", F.concat(count_label(F.col("article_count")), F.lit("件")).alias("count_label"), page_href(section, F.col("category_id")).alias("href"), F.col("category_id").eqNullSafe(F.lit(selected)).alias("is_selected"))


def source_nav(sources: DataFrame, selected: str | None = None, section: str | None = "sources") -> DataFrame:
    label = F.array_join(F.filter(F.array("category_label", "language"), lambda x: F.coalesce(x, F.lit("")) != ""), " / ")
    return sources.select("id", "name", F.concat(count_label(F.col("article_count")), F.lit("件")).alias("count_label"), label.alias("meta_label"), page_href(section, F.col("id")).alias("href"), F.col("id").eqNullSafe(F.lit(selected)).alias("is_selected"))


def home_stats(meta: DataFrame) -> DataFrame:
    """(ord, label, value): the three counts of the one row of ``meta``."""
    rows = [F.struct(F.lit(i).cast("long").alias("ord"), F.lit(label).alias("label"), count_label(F.col(c)).alias("value")) for i, (label, c) in enumerate(STATS)]
    return meta.select(F.inline(F.array(*rows)))


def page_of(public: DataFrame, column: str, value: str) -> DataFrame:
    return public.where(F.col(column) == value)


def page_state(wanted: DataFrame, dimension: DataFrame, public: DataFrame, column: str) -> DataFrame:
    """(wanted, state, articles): missing, unknown, empty or ready, for ids that pages may be asked for.

    ``wanted`` (wanted) is joined with the counts of ``public`` by ``column``, and with ``dimension`` (id).
    """
    counts = public.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    known = dimension.select(F.col("id").alias("__known")).distinct()
    joined = wanted.join(known, F.col("wanted") == F.col("__known"), "left").join(counts, F.col("wanted") == F.col(column), "left")
    n = F.coalesce("n", F.lit(0))
    state = F.when(F.coalesce("wanted", F.lit("")) == "", "missing").when(F.col("__known").isNull(), "unknown").when(n == 0, "empty").otherwise("ready")
    return joined.select("wanted", state.alias("state"), F.when(F.col("__known").isNull(), 0).otherwise(n).cast("long").alias("articles"))


def card_html(view: DataFrame) -> DataFrame:
    """(id, html): a card for each article view, every value escaped."""
    e = lambda c: escape_html(F.col(c))
    link: Column = F.when(F.col("can_open_external"), F.concat(F.lit('<a href="'), e("url"), F.lit('" target="_blank" rel="noopener noreferrer">'), e("link_text"), F.lit("</a>"))).otherwise(F.concat(F.lit("<span>"), e("link_text"), F.lit("</span>")))
    return view.select("id", F.concat(F.lit("<article><h3>"), e("title"), F.lit("</h3><p>"), e("source_name"), F.lit(" / "), e("category_label"), F.lit("</p><p>"), e("summary"), F.lit("</p>"), link, F.lit("</article>")).alias("html"))
