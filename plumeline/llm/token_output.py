"""Token ids of a corpus in order of doc_id, in range-coded, checksummed blocks.

The file format is a folder of Parquet files whose rows are segments: ``part`` and ``first`` (which partition of the
order, and how many ids of that partition come before), ``docs`` (doc_id, place of its first id in the segment, number of
ids) and ``coded``, the blocks of RangeCoder.java with the documents' ids strung together. Blocks decode on their own,
segments are read in parallel, and Spark's commit protocol makes a retried task replace what a lost one wrote. Tokenizing
runs in Arrow batches, coding and the digests of what is read back run in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import jvm
from . import kernel as K
from .common import new_path, read, shuffle_width, spread

END = 2
SEGMENT = 500_000  # ids after which a segment is written; a segment holds whole documents
_SLOTS = 1 << 19
_POOL = 4_000_000
_BATCH = 8192  # runs given to the library at once: what it returns is far larger than the ids

_CODER = "RangeCoder.java", {"plumeline_encode_ids": ("plumeline.EncodeIds", "binary"), "plumeline_decode_ids": ("plumeline.DecodeIds", "binary")}
_DOCS = "docs array<struct<doc_id:long,at:long,n:long>>"
SEGMENTS = f"part int, first long, {_DOCS}, coded binary"


#: Classes of ASCII bytes: 1 letters, 2 digits, 3 other signs, 4 apostrophe; 0: white space, controls and all of non-ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x27] = 4
#: By the classes of two bytes in a row: whether the vocabulary's splitting always begins a piece at the second.
_PARTS = np.zeros((5, 5), bool)
_PARTS[1, [2, 3, 4]] = _PARTS[3, [1, 2]] = _PARTS[2, [1, 3]] = True
_PARTS = _PARTS.ravel()
_SLOT = np.dtype([("a", "<u8"), ("b", "<u8"), ("length", "<i4"), ("start", "<i4"), ("n", "<i8")])


class WordEncoder:
    """Ids of whole texts, as the tokenizers library gives them, by way of a cache of runs of characters.

    The vocabulary's own splitting lower-cases, never crosses ASCII white space, and always begins a piece where a letter
    is followed by an ASCII sign or digit, or one of these but an apostrophe by a letter; so a text's ids are those of its
    runs between such places. Runs of up to 16 bytes are kept in slots and told by all their bytes, longer ones in a
    dictionary. A new run of ASCII letters goes straight to the library's model, as splitting and normalising would leave
    it as it is. Where a text may spell a special token, its slice is not cut, and case counts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.slots = np.zeros(_SLOTS, _SLOT)  # length 0: none
        self.long: dict[bytes, tuple[int, int]] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, found: list[list[int]]) -> np.ndarray:
        """(start, n) of each list in the pool, which they are added to."""
        n = np.array([len(ids) for ids in found], np.int64)
        total = int(n.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), total), np.uint32)])
        self.pool[self.used : self.used + total] = [i for ids in found for i in ids]
        start = self.used + np.cumsum(n) - n
        self.used += total
        return np.stack([start, n], 1)

    def _encoded(self, runs: list[bytes]) -> np.ndarray:
        """(start, n) in the pool of the ids of new runs, lower-cased."""
        spans, model = [np.zeros((0, 2), np.int64)], self.tokenizer.model
        for k in range(0, len(runs), _BATCH):
            batch = [r.decode("utf-8", "replace") for r in runs[k : k + _BATCH]]
            plain = [r.isascii() and r.isalpha() for r in batch]
            others = iter(self.tokenizer.encode_batch_fast([r for r, p in zip(batch, plain, strict=True) if not p], add_special_tokens=False))
            spans.append(self._add([[token.id for token in model.tokenize(r)] if p else next(others).ids for r, p in zip(batch, plain, strict=True)]))
        return np.concatenate(spans)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        found = [e.ids for k in range(0, len(rows), 64) for e in self.tokenizer.encode_batch_fast(rows[k : k + 64], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(ids) for ids in found], dtype=np.int64)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and the rows' offsets among them."""
        if bool((data == 60).any()) and b"<|" in data.tobytes():
            return self._whole(data, offsets)
        if self.used > _POOL:
            self.clear()
        kind = _CLASS[data]
        cut = np.flatnonzero(_PARTS[kind[:-1] * np.uint8(5) + kind[1:]]) + 1
        starts, ends, rows = K.spans(data, offsets, K.NOT_SPACE, cut)
        text, size = K.Bytes(data), ends - starts
        a, b = text.eight(starts, size), np.zeros(len(starts), np.uint64)
        over = np.flatnonzero(size > 8)
        b[over] = text.eight(starts[over] + 8, size[over] - 8)
        slot = (K.mix(a ^ (b * np.uint64(0x9E3779B97F4A7C15))) & np.uint64(_SLOTS - 1)).astype(np.int64)
        held = self.slots[slot]
        start, length = held["start"].astype(np.int64), held["n"]
        missing = np.flatnonzero((held["a"] != a) | (held["b"] != b) | (held["length"] != size))
        if len(missing):
            long = size[missing] > 16
            for i in missing[long].tolist():
                run = bytes(text.raw[starts[i] : ends[i]])
                if run not in self.long:
                    self.long[run] = tuple(self._encoded([run])[0].tolist())
                start[i], length[i] = self.long[run]
            missing = missing[~long]
            key = np.stack([a[missing], b[missing], size[missing].astype(np.uint64)], 1)
            order = np.lexsort(key.T)
            key = key[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]).any(1)
            at = missing[order[new]]
            spans = self._encoded([bytes(text.raw[x:y]) for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            back = spans[np.cumsum(new) - 1]
            start[missing[order]], length[missing[order]] = back[:, 0], back[:, 1]
            fresh = np.zeros(len(at), _SLOT)
            fresh["a"], fresh["b"], fresh["length"], fresh["start"], fresh["n"] = a[at], b[at], size[at], spans[:, 0], spans[:, 1]
            self.slots[slot[at]] = fresh
        ends_at = np.cumsum(length)
        total = int(ends_at[-1]) if len(ends_at) else 0
        ids = self.pool[np.repeat(start - (ends_at - length), length) + np.arange(total)]
        return ids, np.concatenate([[0], ends_at])[rows]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _segment_writer(path: str, end: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, first = _encoder(path), TaskContext.get().partitionId(), 0
        names, lengths, runs, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            docs = pa.StructArray.from_arrays([pa.concat_arrays(names), pa.array(np.cumsum(n) - n), pa.array(n)], ["doc_id", "at", "n"])
            docs = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), docs)
            ids = np.concatenate(runs).astype("<u4")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), docs, pa.array([ids.tobytes()], pa.binary())], ["part", "first", "docs", "ids"])

        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1)):
                ids, at = encoder.encode(data, offsets)
                whole = np.insert(ids, at[1:], end)
                names.append(batch.column(0)[a:b])
                lengths.append(np.diff(at) + 1)
                runs.append(whole)
                size += len(whole)
                if size >= SEGMENT:
                    yield flush()
                    first += size
                    names, lengths, runs, size = [], [], [], 0
        if size:
            yield flush()
            runs = []
        K.release()

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> str:
    """Write ``docs`` (doc_id, text) to ``path``. ``tokenizer``: the vocabulary file, at the same place on every machine.

    Each document's ids end with ``end``. Null and empty texts have that id alone. Documents are in ascending order of
    doc_id, null first; rows that share a doc_id are in order of their texts' hashes. An empty table writes no segment.
    """
    spark = docs.sparkSession
    jvm.register(spark, *_CODER)
    ordered = spread(docs, ["doc_id", "text"]).withColumn("tie", F.xxhash64("text")).repartitionByRange(shuffle_width(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    segments = ordered.select("doc_id", "text").mapInArrow(_segment_writer(tokenizer, end), f"part int, first long, {_DOCS}, ids binary")
    segments.select("part", "first", "docs", F.call_function("plumeline_encode_ids", "ids").alias("coded")).write.option("compression", "uncompressed").parquet(path)
    return path


def _placed(spark: SparkSession, path: str, read_doc: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, start, n_tokens, value) of the documents at ``path``; ``read_doc`` makes the value of a document's ids, as bytes."""
    jvm.register(spark, *_CODER)
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.groupBy("part").agg(F.sum(F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + d["n"])).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition of the writer, so its size is bounded

    def documents(ids: Column) -> Column:
        part = lambda d: F.substr(ids, (4 * d["at"] + 1).cast("int"), (4 * d["n"]).cast("int"))
        return F.transform("docs", lambda d: F.struct(d["doc_id"].alias("doc_id"), (F.col("first") + d["at"]).alias("at"), d["n"].alias("n_tokens"), read_doc(part(d)).alias("value")))

    decoded = F.get(F.transform(F.array(F.call_function("plumeline_decode_ids", "coded")), documents), 0)  # decoded once, and named in the body
    rows = segments.select("part", F.explode(decoded).alias("d")).select("part", "d.*")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "value")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of the documents written to ``path``; a damaged block stops the job."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(v.as_buffer(), "<u4").astype(np.int32) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return _placed(spark, path, lambda ids: ids).select("doc_id", "start", "value").mapInArrow(unpacked, "doc_id long, start long, ids array<int>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents written to ``path``, from the ids read back."""
    return _placed(spark, path, F.crc32).withColumnRenamed("value", "ids_crc32")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = write_tokens(read(spark, sf_dir, "documents"), new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(spark, path)
