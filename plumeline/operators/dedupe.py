"""Collapse articles with one dedupe key by an ordered fold.

The fold is neither associative nor commutative: what has absorbed others is richer than it was, and is compared as such.
So rows are dealt by key, sorted by key and arrival within their partitions, and folded as they stream by: the state is
one article, however many rows a key has. Rows alone with their key, the most part, pass as columns; only the others are
looked at one by one. Rows without a key are dealt by their places of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import slugify

#: Columns that an article keeps through the fold, the places of arrival first, as rows are sorted by them.
FIELDS = [
    "doc_ord", "item_ord", "id", "feed_id", "source_name", "category", "category_id", "language", "site_url", "title", "url", "summary", "published_at", "fetched_at", "author", "image_url", "tags", "source_item_id",
    "seen_in_feeds", "normalized_url",
]
LISTS, TIMES, FILLED = ("tags", "seen_in_feeds"), ("published_at", "fetched_at"), ("author", "image_url", "source_item_id")
_NEVER = 1 << 62


def merged_array(first: Column, second: Column) -> Column:
    """Ordered distinct union without empty strings."""
    return F.array_distinct(F.filter(F.concat(first, second), lambda x: F.coalesce(x, F.lit("")) != ""))


class Folded:
    """The article that a key's rows have made so far; times are microseconds.

    The lists are kept as the keys of dictionaries, so that a row costs what it brings and not what has gathered.
    """

    def __init__(self, row: dict) -> None:
        self.row, self.merged, self.lists = row, 1, None
        self._weigh()

    def _weigh(self) -> None:
        row = self.row
        lists = len(self.lists["tags"] if self.lists else row["tags"] or ())
        self.richness = (row["published_at"] is not None) + sum(bool(row[f]) for f in ("author", "image_url", "summary")) + (lists > 0)
        self.length = utf16_units(row["summary"])

    def add(self, row: dict) -> None:
        """The richer of both wins, else the one with the longer summary, else the one fetched earlier, else the one that was there before; it takes what it lacks from the other."""
        if self.lists is None:
            self.lists = {f: dict.fromkeys(v for v in self.row[f] or () if v) for f in LISTS}
        a, b, other = self.row, row, Folded(row)
        before = _millis(a["fetched_at"]) <= _millis(b["fetched_at"])
        mine, theirs = (self.richness, self.length), (other.richness, other.length)
        wins = mine > theirs if mine != theirs else before
        w, x = (a, b) if wins else (b, a)
        longer = other.length > self.length if wins else self.length > other.length
        new = dict(w, doc_ord=a["doc_ord"], item_ord=a["item_ord"])  # the slot of the first arrival
        new["summary"] = x["summary"] if longer else (w["summary"] or x["summary"] or None)
        new["published_at"] = x["published_at"] if w["published_at"] is None else w["published_at"]
        new["fetched_at"] = a["fetched_at"] if before else b["fetched_at"]
        for f in FILLED:
            new[f] = w[f] or x[f] or None
        for f in LISTS:
            more = dict.fromkeys(v for v in b[f] or () if v)
            if not wins:
                self.lists[f], more = more, self.lists[f]
            self.lists[f].update(more)
        self.row, self.merged = new, self.merged + 1
        self._weigh()

    def result(self) -> dict:
        return self.row | {"merged": self.merged} | ({f: list(v) for f, v in self.lists.items()} if self.lists else {})


def utf16_units(text: str | None) -> int:
    return 0 if not text else len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def _millis(micros: int | None) -> int:
    return _NEVER if micros is None else micros // 1000


def _runs(keys: pa.Array) -> np.ndarray:
    """Where another key begins; a null is a key of its own."""
    if len(keys) < 2:
        return np.zeros(len(keys), np.int64)
    same = pa.compute.fill_null(pa.compute.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(~same) + 1])


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dedupe_key, FIELDS) in order of key and arrival -> (dedupe_key, merged, FIELDS), one row for each key; the last run of a batch waits for the next."""
    held: Folded | None = None
    schema = None

    def rows(found: list[Folded]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([f.result() for f in found], schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        schema = schema or pa.schema([batch.schema[0], pa.field("merged", pa.int64()), *list(batch.schema)[1:]])
        keys, done = batch.column(0), []
        starts = _runs(keys)
        sizes = np.diff(np.append(starts, batch.num_rows))
        goes_on = held is not None and held.row["dedupe_key"] is not None and held.row["dedupe_key"] == keys[0].as_py()
        if held is not None and not goes_on:
            done.append(held)
            held = None
        alone = sizes == 1
        alone[-1] = False
        alone[0] &= not goes_on
        if alone.any():
            passed = batch.take(pa.array(starts[alone]))
            yield pa.RecordBatch.from_arrays([passed.column(0), pa.array(np.ones(passed.num_rows, np.int64)), *passed.columns[1:]], schema=schema)
        for start, size in zip(starts[~alone].tolist(), sizes[~alone].tolist(), strict=True):
            if held is not None and start:
                done.append(held)
                held = None
            for row in batch.slice(start, size).to_pylist():
                if held is None:
                    held = Folded(row)
                else:
                    held.add(row)
        if done:
            yield rows(done)
    if held is not None:
        yield rows([held])


def with_category_id(articles: DataFrame) -> DataFrame:
    """Articles that did not come by way of the registry get the slugs of their categories here."""
    return articles if "category_id" in articles.columns else articles.withColumn("category_id", slugify(F.col("category")))


def dedupe(articles: DataFrame) -> DataFrame:
    """One article for each dedupe key, with ``merged``: how many rows it stands for. A key's rows are those of one URL or item; rows without a key stay as they are."""
    articles = with_category_id(articles).select("dedupe_key", *FIELDS)
    dealt = F.when(F.col("dedupe_key").isNull(), F.xxhash64("doc_ord", "item_ord")).otherwise(F.xxhash64("dedupe_key"))
    ordered = articles.repartition(dealt).sortWithinPartitions("dedupe_key", *FIELDS)
    # times travel as microseconds, which have no zone and no bounds
    plain = ordered.withColumns({c: F.unix_micros(c) for c in TIMES})
    fields = {f.name: f.dataType for f in plain.schema.fields}
    schema = T.StructType([T.StructField("dedupe_key", T.StringType()), T.StructField("merged", T.LongType()), *[T.StructField(f, fields[f]) for f in FIELDS]])
    return plain.mapInArrow(fold, schema).withColumns({c: F.timestamp_micros(c) for c in TIMES})


def first_seen(articles: DataFrame) -> DataFrame:
    """(dedupe_key, doc_ord, item_ord) of the first arrival of each key, by a partial aggregate."""
    return articles.where("dedupe_key is not null").groupBy("dedupe_key").agg(F.min(F.struct("doc_ord", "item_ord")).alias("at")).select("dedupe_key", "at.doc_ord", "at.item_ord")
