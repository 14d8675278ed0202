"""Exact dedup: a static binary-fuse filter over each immutable snapshot screens the digests of a new batch.

Positives join the snapshot's exact buckets and have their bytes compared; copies inside the new batch
are grouped on their own. Keys are SHA-256 digests, so a filter's false positive only costs a join miss.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, spread, stage

KEYS_PER_BUCKET = 16_384
LEAST_BUCKETS = 64
#: Most repeated digests that are sent to every task, 8 MB of them; more are joined.
BROADCAST_KEYS = 1_000_000


# ---------------------------------------------------------------- the filter


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of each key."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _shape(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of segments for ``n`` keys."""
    length = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return length, max(1, int(np.ceil(n * factor / length)) + 1)


def _cells(hashed: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three cells of each key, one in each of three neighbouring segments."""
    first = ((hashed >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64) * length
    mask = np.uint64(length - 1)
    return np.stack([first + k * length + ((hashed >> np.uint64(9 * k)) & mask).astype(np.int64) for k in range(3)])


def _prints(hashed: np.ndarray) -> np.ndarray:
    return ((hashed ^ (hashed >> np.uint64(29)) ^ (hashed >> np.uint64(47))) & np.uint64(0xFF)).astype(np.uint8)


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, cells): a binary-fuse filter with 8-bit prints over distinct 64-bit keys.

    Peeling goes in rounds: every cell that only one key still uses gives that key up, all at once.
    """
    keys = np.unique(np.asarray(keys, np.uint64))
    length, segments = _shape(len(keys))
    size = (segments + 2) * length
    for seed in range(1, 1000):
        hashed = _mix(keys, seed)
        cells = _cells(hashed, length, segments)
        at = np.arange(len(keys), dtype=np.int64)
        count = np.bincount(cells.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for k in range(3):
            np.bitwise_xor.at(owner, cells[k], at)
        left, rounds, alive = len(keys), [], np.ones(len(keys), bool)
        while left:
            single = np.flatnonzero(count == 1)
            peeled, first = np.unique(owner[single], return_index=True)
            if not len(peeled):
                break
            rounds.append((peeled, single[first]))
            alive[peeled] = False
            left -= len(peeled)
            for k in range(3):
                np.subtract.at(count, cells[k][peeled], 1)
                np.bitwise_xor.at(owner, cells[k][peeled], peeled)
        if left:
            continue
        table, prints = np.zeros(size, np.uint8), _prints(hashed)
        for peeled, cell in reversed(rounds):
            a, b, c = (table[cells[k][peeled]] for k in range(3))
            table[cell] = prints[peeled] ^ a ^ b ^ c ^ table[cell]
        return seed, length, segments, table.tobytes()
    raise ValueError("no seed peels these keys")


def probe_fuse(keys: np.ndarray, seed: int, length: int, segments: int, table: bytes) -> np.ndarray:
    """True for every key of the filter, and for about one in 256 of the others."""
    hashed = _mix(np.asarray(keys, np.uint64), seed)
    cells, held = _cells(hashed, length, segments), np.frombuffer(table, np.uint8)
    return (held[cells[0]] ^ held[cells[1]] ^ held[cells[2]]) == _prints(hashed)


# ---------------------------------------------------------------- the operator


@dataclass
class Snapshot:
    """An immutable set of texts as it was written: its groups (digest, last, n, key, bucket), and a filter for each bucket."""

    index: DataFrame
    filters: DataFrame
    buckets: int


def _keyed(frame: DataFrame, buckets: int) -> DataFrame:
    return frame.withColumn("key", F.xxhash64("digest")).withColumn("bucket", F.pmod(F.hash("digest"), F.lit(buckets)))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))


def snapshot(rows: DataFrame) -> Snapshot:
    """The snapshot of ``rows`` (doc_id, digest): groups and filters are written once, and serve any number of batches."""
    index = stage(_grouped(rows), "snapshot")
    buckets = max(LEAST_BUCKETS, -(-index.count() // KEYS_PER_BUCKET))
    index = _keyed(index, buckets)
    return Snapshot(index, stage(snapshot_filters(index), "snapshot-filters"), buckets)


def snapshot_filters(index: DataFrame) -> DataFrame:
    """One row for each bucket of an index of (digest, key, bucket): the bucket's static filter.

    Digests are distinct and buckets are dealt by hash, so a bucket holds about KEYS_PER_BUCKET keys whatever the texts.
    """

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seed, length, segments, table = build_fuse(rows["key"].to_numpy().astype(np.uint64))
        return pd.DataFrame({"bucket": [key[0]], "seed": [seed], "length": [length], "segments": [segments], "cells": [table]})

    return index.select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket int, seed int, length int, segments int, cells binary")


def screen(batch: DataFrame, held: Snapshot) -> DataFrame:
    """``batch`` (digest, last, n) with ``maybe``: whether the snapshot's filter lets the digest through.

    A batch larger than the snapshot has several parts to a bucket, each with a copy of the filter, so that no part grows.
    """
    parts = max(1, -(-batch.count() // (held.buckets * KEYS_PER_BUCKET)))
    batch = _keyed(batch, held.buckets).withColumn("part", F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(parts)).cast("int"))
    filters = held.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def probe(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["digest", "last", "n", "key"]].copy()
        rows["maybe"] = False
        if len(rows) and len(found):
            f = found.iloc[0]
            rows["maybe"] = probe_fuse(rows["key"].to_numpy().astype(np.uint64), int(f.seed), int(f.length), int(f.segments), f.cells)
        return rows.drop(columns="key")

    return batch.groupBy("bucket", "part").cogroup(filters.groupBy("bucket", "part")).applyInPandas(probe, "digest binary, last long, n long, maybe boolean")


def _copies(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Of ``texts`` (digest, text), those of groups of two or more; others do not leave the task that reads them.

    The repeated digests are sent to every task, as eight bytes each, if there are BROADCAST_KEYS at most, else joined.
    """
    repeated = groups.where("group_size > 1").select(F.xxhash64("digest").alias("key")).distinct()
    small = repeated.count() <= BROADCAST_KEYS
    return texts.withColumn("key", F.xxhash64("digest")).join(F.broadcast(repeated) if small else repeated, "key", "left_semi").drop("key")


def exact_groups(docs: DataFrame, incoming) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest) and groups (digest, keep_id, group_size) of ``docs`` (doc_id, text).

    ``incoming``: a boolean column over doc_id that is true for rows of the new batch and false for those of the
    immutable snapshot. A null text counts as empty. Rows that repeat a doc_id and its text count as copies; a null
    doc_id never outranks another. An empty table gives no groups. Equal digests of unequal bytes stop the job.
    """
    docs = spread(docs, ["doc_id", "text"]).withColumn("text", F.coalesce("text", F.lit("")))
    digest = F.unhex(F.sha2("text", 256))
    rows = stage(docs.select("doc_id", digest.alias("digest"), F.coalesce(incoming, F.lit(True)).alias("incoming")), "digests")
    held, batch = snapshot(rows.where("not incoming")), stage(_grouped(rows.where("incoming")), "batch")
    screened = stage(screen(batch, held), "screened")
    index = held.index.select("digest", F.col("last").alias("held_last"), F.col("n").alias("held_n"))
    met = index.join(screened.where("maybe").drop("maybe"), "digest", "full").select(
        "digest", F.greatest("last", "held_last").alias("keep_id"), (F.coalesce("n", F.lit(0)) + F.coalesce("held_n", F.lit(0))).alias("group_size")
    )
    new = screened.where("not maybe").select("digest", F.col("last").alias("keep_id"), F.col("n").alias("group_size"))
    groups = stage(met.unionByName(new), "groups")

    # Bytes: each task first reduces its own copies of a text to the least and the greatest, so a hot group arrives in parts.
    copies = _copies(docs.select(digest.alias("digest"), "text"), groups)
    same = copies.groupBy("digest").agg((F.min("text") == F.max("text")).alias("same"))
    checked = groups.join(same, "digest", "left").select(
        "digest", "keep_id", F.when(F.coalesce("same", F.lit(True)), F.col("group_size")).otherwise(F.raise_error(F.lit("one digest, two texts"))).cast("long").alias("group_size")
    )
    checked = stage(checked, "checked")  # so that the join with all rows can split a hot group
    discard(batch, screened, groups)
    return rows.select("doc_id", "digest"), checked


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: half of the ids form the snapshot, the other half the new batch; every row is returned."""
    incoming = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    rows, groups = exact_groups(read(spark, sf_dir, "documents"), incoming)
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


OP10_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
