"""Whole runs: documents to exports, feeds to exports, exports to pages, and the command line."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import summaries as S
from ..operators import views as V
from ..operators.dedupe import dedupe
from ..operators.normalize import canonical_articles
from ..sources import documents as D
from ..sources import registry as R

log = logging.getLogger("plumeline")
EXPORTS = ("articles", "categories", "sources", "meta")
CAMEL = {
    "published_at": "publishedAt", "sort_at": "sortAt", "source_id": "sourceId", "source_name": "sourceName", "category_id": "categoryId", "category_label": "categoryLabel", "image_url": "imageUrl",
    "article_count": "articleCount", "latest_sort_at": "latestSortAt", "site_url": "siteUrl", "generated_at": "generatedAt", "source_count": "sourceCount", "category_count": "categoryCount",
}


class CategoryCollision(ValueError):
    """Two labels share a slug."""


def build_exports(articles: DataFrame, registry: DataFrame, generated_at: str) -> dict[str, DataFrame]:
    """articles, categories, sources and meta of deduped ``articles``; lazy, but for the check that labels have slugs of their own."""
    datetime.fromisoformat(generated_at.replace("Z", "+00:00"))
    clash = S.category_collisions(articles.select("category").unionByName(registry.select("category"))).first()
    if clash:
        raise CategoryCollision(f"{' and '.join(clash['labels'])} share the slug {clash['category_id']}")
    public = S.public_articles(articles)
    latest = F.col("latest_sort_at").desc()
    return {
        "articles": S.sorted_articles(public).drop("sort_ms"),
        "categories": S.category_summary(public).withColumnRenamed("category_id", "id").orderBy(latest, F.collate("label", "en")),
        "sources": S.source_summary(public, registry).orderBy(latest, F.collate("id", "en")),
        "meta": S.meta(public, generated_at),
    }


def run_metrics(registry: DataFrame, normalized: DataFrame, deduped: DataFrame) -> DataFrame:
    """One row: feeds, enabled feeds, articles before and after, and how many were collapsed."""
    feeds = registry.agg(F.count(F.lit(1)).alias("total_feeds"), F.count_if("enabled").alias("enabled_feeds"))
    counts = normalized.agg(F.count(F.lit(1)).alias("normalized_articles")).join(deduped.agg(F.count(F.lit(1)).alias("deduped_articles")))  # one row each
    return feeds.join(counts).withColumn("duplicates_collapsed", F.col("normalized_articles") - F.col("deduped_articles"))


def write_exports(exports: dict[str, DataFrame], output_dir: str) -> None:
    """Four JSON files with two-space indent for a static site; write_tables() is for exports that are not small."""
    os.makedirs(output_dir, exist_ok=True)
    for name in EXPORTS:
        frame = exports[name].withColumnsRenamed({k: v for k, v in CAMEL.items() if k in exports[name].columns})
        rows = [r.asDict() for r in frame.toLocalIterator()]
        with open(os.path.join(output_dir, f"{name}.json"), "w", encoding="utf-8") as f:
            f.write(json.dumps(rows[0] if name == "meta" else rows, ensure_ascii=False, indent=2) + "\n")


def write_tables(exports: dict[str, DataFrame], path: str) -> None:
    for name in EXPORTS:
        exports[name].write.mode("overwrite").parquet(f"{path}/{name}")


def run(spark: SparkSession, registry: DataFrame, documents: DataFrame, generated_at: str, output_dir: str | None = None) -> dict:
    """Metrics of one run over given documents; without ``output_dir`` nothing is written."""
    lookup = R.last_of_each(registry)
    normalized = canonical_articles(documents, lookup)
    deduped = dedupe(normalized)
    exports = build_exports(deduped, lookup, generated_at)
    if output_dir:
        write_exports(exports, output_dir)
    found = run_metrics(registry, normalized, deduped).first().asDict() | {f"public_{k}": v for k, v in exports["meta"].first().asDict().items() if k != "generated_at"}
    log.info("run: %s", found)
    return found | {"dry_run": output_dir is None, "exports": exports}


def update(spark: SparkSession, registry: DataFrame, generated_at: str, output_dir: str | None = None, fetch: Callable[[str], str] = D.http_fetch) -> dict:
    """Fetch the enabled feeds, refuse to publish where nothing came, else run."""
    outcomes = D.fetch_all(registry, fetch).persist()
    try:
        metrics = D.update_metrics(outcomes)
        gate = D.publish_gate(metrics).first()
        if not gate["publish"]:
            raise D.PublishRefused(gate["reason"])
        found = run(spark, registry, D.documents_of(outcomes, F.lit(generated_at)), generated_at, output_dir)
        return found | metrics.first().asDict() | {"failed_fetches": [r.asDict() for r in D.failures_of(outcomes).orderBy("doc_ord").collect()]}
    finally:
        outcomes.unpersist()


def register_views(exports: dict[str, DataFrame]) -> None:
    """The exports as temporary views, each under its name, for SQL."""
    for name in EXPORTS:
        exports[name].createOrReplaceTempView(name)


def load_exports(spark: SparkSession, data_dir: str) -> tuple[str, dict[str, DataFrame]]:
    """(ready, missing-data or error, exports): all four or none."""
    from pyspark.errors import AnalysisException

    found = {}
    for name in EXPORTS:
        try:
            found[name] = spark.read.option("multiLine", True).json(f"{data_dir}/{name}.json")
        except AnalysisException as e:
            return ("missing-data" if "PATH_NOT_FOUND" in str(e) else "error"), {}
    return "ready", found


def page(exports: dict[str, DataFrame], column: str, value: str) -> DataFrame:
    """Article views of one category or source, in the exported order."""
    return V.article_view(V.page_of(exports["articles"], column, value))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plumeline", description="Build exports from feeds.")
    parser.add_argument("--feeds", default="data/feeds.json")
    parser.add_argument("--documents", help="folder of XML files; without it the enabled feeds are fetched")
    parser.add_argument("--output-dir", default="public/data")
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    target = None if args.dry_run else args.output_dir
    try:
        registry = R.read_registry(spark, args.feeds)
        if args.documents:
            documents = D.from_files(spark, args.documents)
            if documents.isEmpty():
                raise D.PublishRefused("no documents were given")
            run(spark, registry, documents, now, target)
        else:
            update(spark, registry, now, target)
    except Exception as e:  # noqa: BLE001
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
