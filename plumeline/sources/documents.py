"""Feed documents: given, read from files, or fetched; and whether what came is enough to publish."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "feed_id string, xml string, fetched_at timestamp, doc_ord long"
OUTCOMES = "doc_ord long, feed_id string, feed_url string, xml string, error string"
TIMEOUT = 30.0
HEADERS = {"Accept": "application/rss+xml, application/atom+xml, application/xml, text/xml;q=0.9, */*;q=0.8", "User-Agent": "plumeline/1.0"}


class PublishRefused(RuntimeError):
    """Too little was fetched to replace what is published."""


def from_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), SCHEMA)


def from_files(spark: SparkSession, path: str, feed_id_pattern: str = "([^/]+)\\.xml$") -> DataFrame:
    """One document for each file; the feed's id is part of the file's name, and documents are in order of their names.

    The engine holds the list of files on the driver anyway; it is sorted there, and a folder that moves keeps its order.
    """
    found = spark.read.text(path, wholetext=True)
    names = sorted(found.inputFiles(), key=lambda f: (f.rsplit("/", 1)[-1], f))
    order = spark.createDataFrame(list(enumerate(names)), "doc_ord long, file string")
    files = found.select(F.col("value").alias("xml"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("fetched_at"))
    return files.join(order, "file").select(F.regexp_extract("file", feed_id_pattern, 1).alias("feed_id"), "xml", F.col("fetched_at").cast("timestamp").alias("fetched_at"), "doc_ord")


def http_fetch(url: str, timeout: float = TIMEOUT) -> str:
    with urlopen(Request(url, headers=HEADERS), timeout=timeout) as answer:  # raises for statuses from 400 on
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


def fetch_all(registry: DataFrame, fetch: Callable[[str], str] = http_fetch) -> DataFrame:
    """OUTCOMES of the enabled feeds in order of the registry. One that fails or is blank keeps its error and stops no other.

    Feeds are fetched by tasks, a feed at a time in each, so that many feeds go to many machines.
    """
    feeds = registry.where("enabled").select("pos", "id", "feed_url")

    def run(batches):
        for batch in batches:
            rows = []
            for pos, feed, url in zip(*(batch[c] for c in ("pos", "id", "feed_url")), strict=True):
                try:
                    xml = fetch(url)
                    rows.append((pos, feed, url, xml, None) if xml and xml.strip() else (pos, feed, url, None, "empty document"))
                except Exception as e:  # noqa: BLE001  each feed's error is its outcome
                    rows.append((pos, feed, url, None, str(e) or type(e).__name__))
            import pandas as pd

            yield pd.DataFrame(rows, columns=["doc_ord", "feed_id", "feed_url", "xml", "error"])

    return feeds.mapInPandas(run, OUTCOMES)


def documents_of(outcomes: DataFrame, fetched_at) -> DataFrame:
    return outcomes.where("error is null").select("feed_id", "xml", fetched_at.cast("timestamp").alias("fetched_at"), "doc_ord")


def failures_of(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("error is not null").select("doc_ord", "feed_id", "feed_url", F.col("error").alias("message"))


def update_metrics(outcomes: DataFrame) -> DataFrame:
    """One row: attempted, fetched, failed, and the failed ids in order, joined."""
    failed = F.col("error").isNotNull()
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("doc_ord", "feed_id")))), lambda s: s["feed_id"]), ", ")
    return outcomes.agg(F.count(F.lit(1)).alias("attempted_feeds"), F.count_if(~failed).alias("fetched_documents"), F.count_if(failed).alias("failed_feeds"), ids.alias("failed_ids"))


def publish_gate(metrics: DataFrame) -> DataFrame:
    """(publish, reason) of update metrics."""
    reason = F.when(F.col("attempted_feeds") == 0, "no enabled feeds").when(F.col("fetched_documents") == 0, "no document was fetched").otherwise("")
    return metrics.select((reason == "").alias("publish"), reason.alias("reason"))


def orphans(documents: DataFrame, registry: DataFrame) -> DataFrame:
    return documents.join(registry.select(F.col("id").alias("feed_id")), "feed_id", "left_anti")
