"""Benchmark decontamination by winnowing.

A text keeps the least K-word hash of every WINDOW - K + 1 in a row, so any WINDOW words that two texts share hold a hash
that both kept. The kept hashes of the benchmark, and its windows, go to a Bloom filter of a fixed size; document hashes
that pass are extended to the windows around them, and windows that pass too are joined with the benchmark's by their
words. Items of fewer words than a window are one window of their own length, for which every run of words is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import ROW_KEY, read, row_key, spread, stage, text_hash

WINDOW = 10
GRAM = 5
BLOOM_BITS = 24  # the filter has 2 ** 24 bits, 2 MiB, whatever the size of the benchmark

_STARTS = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("words", pa.string())]))


def _winnowed(runs: np.ndarray, width: int) -> np.ndarray:
    """Positions of a row's hashes that are the least of some ``width`` in a row, ties included."""
    n = len(runs) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = runs[:n].copy()
    for j in range(1, width):
        np.minimum(least, runs[j : j + n], out=least)
    keep = np.zeros(len(runs), bool)
    for j in range(width):
        keep[j : j + n] |= runs[j : j + n] == least
    return np.flatnonzero(keep)


def _salted(hashed: np.ndarray, salt: int) -> np.ndarray:
    return K.mix(hashed + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _bits(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BLOOM_BITS) - 1)
    return (hashed & mask).astype(np.int64), ((hashed >> np.uint64(BLOOM_BITS)) & mask).astype(np.int64)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, n: int) -> str:
    return " ".join(bytes(K.LOWERED[data[a:b]]).decode("utf-8", "replace") for a, b in zip(starts[at : at + n].tolist(), ends[at : at + n].tolist(), strict=True))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) -> (item_id, n, words, hashes): the windows of each item; the kept hashes of an item ride on its first."""
    for batch in batches:
        for a, b, data, offsets in K.slices(batch.column(1)):
            starts, ends, hashed, rows = K.words(data, offsets, K.ALNUM)
            ids, ns, texts, prints = [], [], [], []
            names = batch.column(0)[a:b].to_pylist()
            for i, (x, y) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
                if y == x:
                    continue
                n = min(WINDOW, y - x)
                runs = K.grams(hashed[x:y], n)
                kept = _salted(runs, n)
                if n == WINDOW:
                    grams = K.grams(hashed[x:y], GRAM)
                    kept = np.concatenate([kept, _salted(grams[_winnowed(grams, WINDOW - GRAM + 1)], WINDOW + 1)])
                for k in range(len(runs)):
                    ids.append(names[i])
                    ns.append(n)
                    texts.append(_joined(data, starts, ends, x + k, n))
                    prints.append(kept.astype(np.int64).tolist() if not k else [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ns, pa.int32()), pa.array(texts, pa.string()), pa.array(prints, pa.list_(pa.int64()))], ["item_id", "n", "words", "prints"])


def _bloom(windows: DataFrame) -> np.ndarray:
    """The filter, a boolean for each bit: combined word by word on the executors, 2 ** BLOOM_BITS / 64 rows at most reach the driver."""
    prints = windows.select(F.explode("prints").alias("h"))
    mask = (1 << BLOOM_BITS) - 1
    bits = prints.select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", BLOOM_BITS).bitwiseAND(F.lit(mask)))).alias("bit"))
    rows = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    packed = np.zeros((1 << BLOOM_BITS) // 64, np.int64)
    packed[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return packed.view(np.uint8)


def _scanner(bloom, lengths: list[int]):
    def passes(held: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        x, y = _bits(hashed)
        ok = (held[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1
        at = np.flatnonzero(ok)
        y = y[at]
        return at[(held[y >> 3] >> (y & 7).astype(np.uint8)) & 1 == 1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bloom.value, np.uint8)
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(2)):
                starts, ends, hashed, rows = K.words(data, offsets, K.ALNUM)
                row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
                left = rows[1:][row_of] - np.arange(len(hashed))  # words from here to the row's end
                found: list[list] = [[] for _ in range(b - a)]
                for n in lengths:
                    if len(hashed) < n:
                        continue
                    if n < WINDOW:
                        at = passes(held, _salted(K.grams(hashed, n), n))
                        at = at[left[at] >= n]
                    else:
                        runs, width = K.grams(hashed, GRAM), WINDOW - GRAM + 1
                        # least of every `width` hashes; windows that cross rows only keep a few hashes more
                        kept = _winnowed(runs, width)
                        kept = kept[passes(held, _salted(runs[kept], WINDOW + 1))]
                        at = np.unique((kept[:, None] - np.arange(width)[None, :]).ravel())
                        at = at[(at >= 0) & (at < len(hashed))]
                        at = at[left[at] >= n]
                        if len(at):
                            at = at[passes(held, _salted(K.grams(hashed, n)[at], n))]
                    for k in at.tolist():
                        found[row_of[k]].append({"start": k - int(rows[row_of[k]]), "n": n, "words": _joined(data, starts, ends, k, n)})
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], batch.column(3)[a:b], pa.array(np.diff(rows), pa.int64()), pa.array(found, _STARTS)], ["rid", "doc_id", "tid", "n_words", "starts"])

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(rid, doc_id, n_words, n_hit, items) for every row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text).

    ``items``: the ids, as strings, of the items with a window in the document, in order; null ids count as empty strings.
    Null and empty texts, and texts without words, have no words and hit nothing. Rows that repeat are rows of their own;
    items that share an id count once. An empty benchmark hits nothing, an empty table gives no rows.
    """
    return _judged(docs, benchmark).drop("tid")


def _judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contamination() of ``docs``, with the hash of each text as tid."""
    spark = docs.sparkSession
    items = spread(benchmark, ["item_id", "text"]).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    windows = stage(items.mapInArrow(_item_windows, "item_id string, n int, words string, prints array<long>"), "windows")
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # WINDOW different values at most
    bloom = spark.sparkContext.broadcast(_bloom(windows).tobytes())
    docs = spread(docs, ["doc_id", "text"]).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", text_hash(F.col("text")).alias("tid"))
    scanned = stage(docs.mapInArrow(_scanner(bloom, lengths), "rid long, doc_id long, tid long, n_words long, starts array<struct<start:int,n:int,words:string>>"), "scanned")
    owners = windows.groupBy("words").agg(F.collect_set("item_id").alias("items"))
    hits = stage(scanned.where(F.size("starts") > 0).select("rid", F.inline("starts")).join(owners, "words"), "hits")
    order = Window.partitionBy("rid").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    covered = hits.select("rid", "start", (F.col("start") + F.col("n")).alias("end"), "n").withColumn("upto", F.coalesce(F.max("end").over(order), F.lit(0)))
    covered = covered.groupBy("rid").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "upto"))).cast("long").alias("n_hit"))
    named = hits.groupBy("rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return scanned.drop("starts").join(covered, "rid", "left").join(named, "rid", "left").select(
        "rid", "doc_id", "tid", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without a window of ``benchmark``. Rows are told by doc_id and text together."""
    hits = _judged(docs, benchmark).where("n_hit > 0").select(*row_key(F.col("tid"))).distinct()
    return docs.select("*", *row_key()).join(hits, ROW_KEY, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP6_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM i),
d AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM w, n WHERE len(w) >= n)),
h AS (SELECT d.doc_id, d.k, d.n, i.item_id FROM d JOIN i USING (s, n)),
c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
