"""Documents as a stream: each micro-batch is normalised, folded into the state table, and published anew.

The state is every canonical article seen, in buckets by the hash of the dedupe key. A batch writes anew only the buckets
that its keys fall into, as files of its own version, and then a manifest: which version holds each bucket. A manifest
appears whole, by a rename, and is what readers go by, so none sees half a batch. A batch that is run again after a
failure starts from the manifest before it and leaves what it left the first time. Versions that no kept manifest
names are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedupe import FIELDS, dedupe
from ..operators.normalize import canonical_articles
from ..sources.staging import Folder, written

DOCUMENTS = "feed_id string, xml string, fetched_at timestamp, doc_ord long"
BUCKETS = 64
KEPT = 2  # manifests whose versions stay: the last, and the one that it started from
_BATCH = 1 << 32  # documents of a batch at most: rows of later batches come after those of earlier ones


def document_stream(spark: SparkSession, path: str, schema: str = DOCUMENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def bucket_of(buckets: int) -> Column:
    """The bucket of a dedupe key; rows without one, which nothing is folded into, are dealt by their ids."""
    return F.pmod(F.when(F.col("dedupe_key").isNull(), F.xxhash64("id", "doc_ord", "item_ord")).otherwise(F.xxhash64("dedupe_key")), F.lit(buckets)).cast("int")


def _manifest(folder: Folder, batch_id: int) -> dict[int, int]:
    """Version by bucket after a batch; before the first there is nothing, but a lost manifest is no empty history."""
    if batch_id < 0:
        return {}
    text = folder.text(f"manifest-{batch_id:012d}.json")
    if text is None:
        raise FileNotFoundError(f"{folder.path} has no manifest of batch {batch_id}")
    return {int(b): v for b, v in json.loads(text).items()}


def _rows(spark: SparkSession, state_dir: str, versions: dict[int, int], schema: str) -> DataFrame:
    paths = [f"{state_dir}/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _columns(frame: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields if f.name != "bucket")


def fold_batch(spark: SparkSession, state_dir: str, batch: DataFrame, batch_id: int, registry: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """Fold a batch into the state and commit it; the new manifest. Of a key that is there already, the state's row comes first."""
    folder, columns = Folder(spark, state_dir), [*FIELDS, "dedupe_key"]
    before = _manifest(folder, batch_id - 1)
    new = canonical_articles(batch, registry).select(*columns).withColumn("doc_ord", F.col("doc_ord") + F.lit(batch_id * _BATCH)).withColumn("bucket", bucket_of(buckets))
    new = written(new, "batch")  # read twice, and folded as it was read first
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # ``buckets`` rows at most
    if touched:
        old = _rows(spark, state_dir, {b: v for b, v in before.items() if b in touched}, _columns(new))
        merged = dedupe(old.select(*columns).unionByName(new.select(*columns))).select(*columns)
        merged.withColumn("bucket", bucket_of(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{state_dir}/version={batch_id}")
    after = before | dict.fromkeys(touched, batch_id)
    folder.put(f"manifest-{batch_id:012d}.json", json.dumps(after))
    _clean(folder, batch_id)
    return after


def _clean(folder: Folder, batch_id: int) -> None:
    """Delete manifests before the last KEPT, and buckets of versions that none of these names."""
    kept = {name for name in folder.names() if name.startswith("manifest-") and int(name[9:21]) > batch_id - KEPT}
    named = {(v, int(b)) for name in kept for b, v in json.loads(folder.text(name)).items()}
    for name in folder.names():
        if name.startswith("manifest-") and name not in kept:
            folder.delete(name)
        elif name.startswith("version=") and int(name[8:]) <= batch_id:
            version = int(name[8:])
            there = [n for n in folder.names(name) if n.startswith("bucket=")]
            stale = [n for n in there if (version, int(n[7:])) not in named]
            for n in stale:
                folder.delete(f"{name}/{n}")
            if len(stale) == len(there):
                folder.delete(name)


def read_state(spark: SparkSession, state_dir: str, schema: str, batch_id: int | None = None) -> DataFrame:
    """All articles (``schema`` names their columns) after a batch, the last by default."""
    folder = Folder(spark, state_dir)
    if batch_id is None:
        batch_id = max((int(n[9:21]) for n in folder.names() if n.startswith("manifest-")), default=-1)
    return _rows(spark, state_dir, _manifest(folder, batch_id), schema)


def start(documents: DataFrame, registry: DataFrame, state_dir: str, checkpoint: str, publish: Callable[[DataFrame, int], None] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Run the stream until what is there has been read; ``publish`` gets the state after each batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fold_batch(spark, state_dir, batch, batch_id, registry, buckets)
        if publish:
            publish(read_state(spark, state_dir, SCHEMA, batch_id), batch_id)

    return documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Columns of the state.
SCHEMA = (
    "doc_ord bigint, item_ord bigint, id string, feed_id string, source_name string, category string, category_id string, language string, site_url string, title string, url string, summary string, published_at timestamp, "
    "fetched_at timestamp, author string, image_url string, tags array<string>, source_item_id string, seen_in_feeds array<string>, normalized_url string, dedupe_key string"
)
