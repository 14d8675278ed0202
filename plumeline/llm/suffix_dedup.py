"""Suffix-array dedup: bytes of every 50-byte string that also starts in a document with a smaller id are removed.

Whole copies are settled by digest; of each group only the text with the least id goes on. Anchors are the 16-byte grams
whose hash is the least of some 35 in a row: two equal 50-byte strings always hold an anchor at the same place, so suffixes
are dealt to groups by the anchor around which they lie. An anchor that two documents share has a frame of 84 bytes, all the
50-byte strings around it; frames that are alike (by 128 bits of hashes) are one. The suffixes of a group's frames are
sorted deep-shallow in the JVM (SuffixGroups.java), and runs that share 50 bytes give the least id of each string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jvm
from . import kernel as K
from .common import discard, read, spread, stage

SPAN = 50
GRAM = 16
SIDE = SPAN - GRAM  # bytes of a frame on each side of the gram
FRAME = SPAN + SIDE
WIDTH = SPAN - GRAM + 1
#: Filters that keep unshared anchors out have 16 bits for each hash, and 2 ** 29 bits, 64 MiB, at most; beyond some 10 ** 8
#: shared hashes they let more through, which costs time but changes no result.
LEAST_BITS, MOST_BITS = 20, 29
#: Frames of one anchor beyond which its strings are grouped by the engine instead of being sorted in one task.
MOST_FRAMES = 20_000
LAST = (1 << 63) - 1

_SORT = "SuffixGroups.java", {
    "plumeline_least_ids": ("plumeline.SuffixGroups", "array<struct<cx:long,runs:array<struct<o:int,n:int,m:long>>>>"),
    "plumeline_suffix_order": ("plumeline.SuffixOrder", "array<int>"),
}


# ---------------------------------------------------------------- anchors


def _slide(values: np.ndarray, width: int, keep: np.ufunc) -> np.ndarray:
    """``keep`` of every ``width`` values in a row, by doubling."""
    have = 1
    while have * 2 <= width:
        values = keep(values[:-have], values[have:])
        have *= 2
    return keep(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def _words_at(data: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    return np.ndarray(shape=(len(data) - 7,), dtype=kind, buffer=data, strides=(1,))


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row and hash of each anchor of a slice of texts."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, none.astype(np.uint64)
    data = np.ascontiguousarray(data)
    eight = _words_at(data, "<u8")
    light = eight[:-8] * np.uint64(0x9E3779B97F4A7C15)
    light ^= eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    light *= np.uint64(0xD6E8FEB86659FD93)
    light = (light >> np.uint64(32)).astype(np.uint32)
    least = _slide(light, WIDTH, np.minimum)
    if not len(least):
        return none, none, none.astype(np.uint64)
    edge = np.zeros(WIDTH - 1, np.uint32)
    best = _slide(np.concatenate([edge, least, edge]), WIDTH, np.maximum)  # over the stretches that cover each gram
    at = np.flatnonzero(best == light)
    row = np.searchsorted(offsets, at, "right") - 1
    ok = (at + GRAM <= offsets[row + 1]) & (offsets[row + 1] - offsets[row] >= SPAN)
    at, row = at[ok], row[ok]
    return row, at - offsets[row], K.mix(eight[at] + K.mix(eight[at + 8] + np.uint64(0x9E3779B97F4A7C15)))


def _anchor_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, text) -> (h, d): the grams of anchors."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for a, b, data, offsets in K.slices(batch.column(1)):
            row, _, h = anchors(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(ids[a:b][row])], ["h", "d"])


def _filter(shared: DataFrame) -> tuple[int, bytes]:
    """(bits as a power of two, the filter) of the hashes ``shared`` (h), combined word by word on the executors."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * shared.count()).bit_length()))
    place = f"shiftrightunsigned(h, {64 - bits})"
    rows = shared.groupBy(F.expr(f"shiftright({place}, 6)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({place} & 63 as int)))").alias("bits")).toArrow()
    packed = np.zeros((1 << bits) // 64, np.int64)
    packed[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return bits, packed.tobytes()


def _passes(held: tuple[int, bytes], h: np.ndarray) -> np.ndarray:
    table, bit = np.frombuffer(held[1], np.uint8), (h >> np.uint64(64 - held[0])).astype(np.int64)
    return (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _hashed(rows: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each row of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    out = np.full(len(rows), salt, np.uint64)
    for word in wide.view("<u8").T:
        out = K.mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out


def _frames(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(anchors, FRAME + 2) bytes: how many bytes there are on each side, up to SIDE, and the frame, zero where there are none."""
    place = start + at
    out = np.zeros((len(at), FRAME + 2), np.uint8)
    out[:, 0], out[:, 1] = np.minimum(SIDE, at), np.minimum(SIDE, end - place - GRAM)
    where = place[:, None] + np.arange(-SIDE, SPAN)[None, :]
    there = (where >= start[:, None]) & (where < end[:, None])
    out[:, 2:] = np.where(there, data[np.clip(where, 0, max(len(data) - 1, 0))], 0)
    return out


def _survivors(grams):
    """(d, t, text) -> (h, cx, sides, d, t, at) of the anchors whose gram passes as shared; cx: the frame's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, data, offsets in K.slices(batch.column(2)):
                row, at, h = anchors(data, offsets)
                ok = _passes(grams.value, h)
                row, at, h = row[ok], at[ok], h[ok]
                frames = _frames(data, offsets[row], offsets[row + 1], at)
                sides = frames[:, 0].astype(np.int32) * 64 + frames[:, 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.astype(np.int64)), pa.array(_hashed(frames, 3).astype(np.int64)), pa.array(sides), pa.array(ids[a:b][row]), pa.array(ts[a:b][row]), pa.array(at.astype(np.int32))],
                    ["h", "cx", "sides", "d", "t", "at"],
                )

    return run


# ---------------------------------------------------------------- the operator


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, t, text, spans) -> (d, t, n_removed, n_spans, kept)."""
    for batch in batches:
        removed, spans, kept = [], [], []
        for i in range(len(batch)):
            data = np.frombuffer(batch.column(2)[i].as_buffer() or b"", np.uint8)
            marks = batch.column(3)[i].values.flatten()
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, marks[0].to_numpy(), 1)
            np.add.at(change, marks[1].to_numpy(), -1)
            gone = np.cumsum(change)[:-1] > 0
            removed.append(int(gone.sum()))
            spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
            kept.append(data[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["d", "t", "n_removed", "n_spans", "kept"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, sha256) for every row of ``docs`` (doc_id, text).

    ``kept``: the bytes left, null where nothing was removed; ``sha256``: of the bytes left, in hex. Null texts count as
    empty. A null doc_id counts as larger than any other. Rows that share a doc_id remove nothing from each other.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    jvm.register(spark, *_SORT)
    docs = spread(docs, ["doc_id", "text"]).select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("t", F.xxhash64("text"))
    rows = stage(docs.select("d", "doc_id", "t", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest")), "rows")
    least = rows.groupBy("digest").agg(F.min("d").alias("least"))
    first, rows = rows, stage(rows.join(least, "digest"), "rows")
    discard(first)
    whole = rows.where((F.col("d") == F.col("least")) & (F.col("n_bytes") >= SPAN)).select("d", "t").distinct()
    texts = stage(docs.select("d", "t", "text").join(whole.hint("shuffle_hash"), ["d", "t"], "left_semi"), "texts")

    shared = stage(texts.select("d", "text").mapInArrow(_anchor_owners, "h long, d long").groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("h"), "grams")
    grams = spark.sparkContext.broadcast(_filter(shared))
    discard(shared)
    frames = stage(texts.select("d", "t", "text").mapInArrow(_survivors(grams), "h long, cx long, sides int, d long, t long, at int"), "frames")
    # t and at are those of the same row: both are kept by the same comparisons of d
    alike = stage(frames.groupBy("h", "cx").agg(F.min("d").alias("m"), F.max("d").alias("hi"), F.min("sides").alias("sides"), F.min_by("t", "d").alias("t"), F.min_by("at", "d").alias("at")), "alike")
    sizes = stage(alike.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("m").alias("lo"), F.max("hi").alias("top")).where("lo < top").select("h", "c"), "sizes")
    left, right = F.shiftright("sides", 6), F.col("sides").bitwiseAND(F.lit(63))
    alone = alike.join(sizes.where("c = 1"), "h").where(left + right >= SIDE).select("h", "cx", F.array(F.struct((F.lit(SIDE) - left).alias("o"), (left + right - SIDE + 1).alias("n"), "m")).alias("runs"))
    alone = stage(alone, "alone")
    marks = alike.join(sizes.where("c > 1"), "h").where(left + right >= SIDE).groupBy(F.col("m").alias("d"), "t").agg(F.collect_list(F.struct("h", "c", "cx", "sides", "m", "hi", "at")).alias("marks"))
    marks = stage(marks, "marks")
    discard(alike, sizes)  # before the texts travel, which takes most of the disk
    wanted = texts.select("d", "t", F.encode("text", "UTF-8").alias("bytes")).join(marks, ["d", "t"]).dropDuplicates(["d", "t"])
    begin = lambda p: p["at"] + 1 - F.shiftright(p["sides"], 6)
    size = lambda p: F.shiftright(p["sides"], 6) + GRAM + p["sides"].bitwiseAND(F.lit(63))
    cut = lambda p: F.struct(p["h"].alias("h"), p["c"].alias("c"), F.struct(*[p[x].alias(x) for x in ("cx", "sides", "m", "hi")], F.substr("bytes", begin(p), size(p)).alias("frame")).alias("f"))
    framed = stage(wanted.select(F.explode(F.transform("marks", cut)).alias("x")).select("x.*"), "framed")
    discard(marks)
    several = framed.where(F.col("c") <= MOST_FRAMES).groupBy("h").agg(F.collect_list("f").alias("f"))
    several = several.select("h", F.inline(F.call_function("plumeline_least_ids", "f")))
    many = framed.where(F.col("c") > MOST_FRAMES).select("h", "f.*").withColumn("o", F.explode(F.sequence(F.lit(SIDE) - left, right)))
    many = many.withColumn("string", F.expr(f"substring(frame, 1 + o - {SIDE} + shiftright(sides, 6), {SPAN})"))
    many = many.join(many.groupBy("string").agg(F.min("m").alias("first")), "string").groupBy("h", "cx").agg(F.collect_list(F.struct("o", F.lit(1).alias("n"), F.col("first").alias("m"))).alias("runs"))
    solved = stage(alone.unionByName(several).unionByName(many), "solved")
    discard(alone, framed)
    cuts = frames.select("h", "cx", "d", "t", "at").join(solved, ["h", "cx"]).where(F.exists("runs", lambda r: r["m"] < F.col("d")))
    begin = lambda r: F.col("at") - SIDE + r["o"]
    cuts = cuts.select("d", "t", F.transform(F.filter("runs", lambda r: r["m"] < F.col("d")), lambda r: F.struct(begin(r).alias("a"), (begin(r) + r["n"] - 1 + SPAN).alias("b"))).alias("cuts"))
    cuts = stage(cuts.groupBy("d", "t").agg(F.flatten(F.collect_list("cuts")).alias("cuts")), "cuts")
    discard(frames, solved)
    done = texts.join(cuts, ["d", "t"]).dropDuplicates(["d", "t"]).select("d", "t", "text", "cuts").mapInArrow(_cut, "d long, t long, n_removed long, n_spans long, kept binary")
    done = stage(done.withColumn("kept_digest", F.unhex(F.sha2("kept", 256))), "cut")
    discard(texts, cuts)
    copy = (F.col("least") < F.col("d")) & (F.col("n_bytes") >= SPAN)
    nothing = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    return rows.join(done, ["d", "t"], "left").select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.lower(F.hex(F.when(copy, nothing).otherwise(F.coalesce("kept_digest", "digest")))).alias("sha256"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("sha256").alias("kept_sha256"))
