"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures, confirmed on whole shingle sets.

A text's signature has SYMBOLS symbols of 16 bits, cut into CHUNKS chunks. By the pigeonhole principle two signatures
that differ in fewer than CHUNKS * (ERRORS + 1) symbols have a chunk with ERRORS = 1 difference at most; every chunk is
listed under each key that leaves one of its symbols out, so that such pairs always share a key. Pairs beyond that
distance that share a key are looked at too: a pair of similarity 0.75 is missed with a chance of 3e-7.

Texts with equal shingle sets form one class. In a bucket (classes that share a key) each class is held against one
class of the bucket, whichever comes first in one of two orders; pairs that pass are confirmed on the sets themselves, by
128 bits a shingle, and joined to components. Only classes of one bucket that are still in different components are then
held against each other, in tiles of a bounded size and each pair in one bucket only: pairs below the guaranteed distance,
and those that longer signatures say are close to the bound, go on to be confirmed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import NOT_WHITE, ROW_KEY, discard, read, row_key, shuffle_width, spread, stage
from .components import components

SHINGLE = 5
PERCENT = 75
CHUNK, CHUNKS = 5, 15
SYMBOLS = CHUNK * CHUNKS
#: Sets up to SMALL / 0.75 get a signature of SYMBOLS hash functions, sets from SMALL on one of SYMBOLS bins: pairs near enough share a kind.
SMALL = 512
#: Differing symbols beyond which a pair is not confirmed: six standard deviations above the mean at similarity 0.75.
FAR = 41
#: Differing symbols up to which two signatures are sure to share a key: such pairs are always confirmed.
SURE = 2 * CHUNKS - 1
#: Symbols of four bits of the longer signatures, and how many must agree: 4.5 standard deviations below the mean at similarity 0.75.
LONG = 1024
LONG_AGREE = 723
#: Bits of a class's bitmap of shingles, by which pairs that cannot be similar enough are told without their sets.
BITS = 4096
#: Orders by which buckets choose the class that the others are held against.
ORDERS = (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)
TILE = 2048
SIDE_BYTES = 16 << 20
LEAST_SIDES = 4

_rng = np.random.Generator(np.random.PCG64(20240601))
_XOR = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_LONG_XOR = _rng.integers(0, 1 << 63, LONG, dtype=np.uint64)
_LONG_MUL = _rng.integers(0, 1 << 63, LONG, dtype=np.uint64) | np.uint64(1)


# ---------------------------------------------------------------- signatures


def _direct(sets: list[np.ndarray], xor: np.ndarray = _XOR, mul: np.ndarray = _MUL) -> np.ndarray:
    """(sets, hash functions) symbols, one hash function for each."""
    out = np.zeros((len(sets), len(xor)), np.uint16)
    at = 0
    while at < len(sets):
        to, total = at, 0
        while to < len(sets) and (to == at or total + len(sets[to]) <= 1 << 14):
            total += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        bounds = np.cumsum([0, *[len(s) for s in sets[at : to - 1]]])
        for k in range(len(xor)):
            v = (flat ^ xor[k]) * mul[k]
            v ^= v >> np.uint64(32)
            out[at:to, k] = K.mix(np.minimum.reduceat(v, bounds)) & np.uint64(0xFFFF)
        at = to
    return out


_PROBES = (K.mix(np.arange(SYMBOLS * 64, dtype=np.uint64)) % np.uint64(SYMBOLS)).astype(np.int64).reshape(SYMBOLS, 64)


def _binned(one: np.ndarray) -> np.ndarray:
    """SYMBOLS symbols of a large sorted set: the least of each bin; an empty bin borrows from the bins it is dealt."""
    bins = ((one >> np.uint64(32)) * np.uint64(SYMBOLS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    least = np.zeros(SYMBOLS, np.uint64)
    full = np.zeros(SYMBOLS, bool)
    least[bins[first]] = np.minimum.reduceat(K.mix(one ^ np.uint64(0x5851F42D4C957F2D)), first)
    full[bins[first]] = True
    for k in np.flatnonzero(~full):
        donors = _PROBES[k][full[_PROBES[k]]]
        least[k] = least[donors[0] if len(donors) else np.flatnonzero(full)[0]] + np.uint64(k)
    return (K.mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in K.slices(batch.column(2)):
            _, _, hashed, rows = K.words(data, offsets, K.NOT_SPACE)
            sets = K.shingle_sets(hashed, rows, SHINGLE)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            low, high = [None] * len(sets), [None] * len(sets)
            small = [i for i, s in enumerate(sets) if 0 < len(s) <= SMALL * 100 // PERCENT]
            for i, row in zip(small, _direct([sets[i] for i in small]) if small else (), strict=True):
                low[i] = row.tobytes()
            for i, s in enumerate(sets):
                if len(s) >= SMALL:
                    high[i] = _binned(s).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], batch.column(1)[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(low, pa.binary()), pa.array(high, pa.binary())],
                ["doc_id", "tid", "n_shingles", "digest", "low", "high"],
            )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for kind in (0, 1):
            column, ids = batch.column(1 + kind), batch.column(0)
            there = column.is_valid()
            column, ids = column.filter(there), ids.filter(there)
            for at in range(0, len(column), 4096):
                part = column[at : at + 4096]
                sig = np.frombuffer(b"".join(part.to_pylist()), np.uint16).reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
                n = len(sig)
                keys = np.empty((n, CHUNKS, CHUNK), np.uint64)
                for j in range(CHUNK):
                    packed = np.zeros((n, CHUNKS), np.uint64)
                    for i in (i for i in range(CHUNK) if i != j):
                        packed = (packed << np.uint64(16)) | sig[:, :, i]
                    slots = (SYMBOLS * kind + CHUNK * np.arange(CHUNKS) + j).astype(np.uint64)  # kept in a key's last byte
                    keys[:, :, j] = (K.mix(packed + K.mix(slots + np.uint64(1))) & np.uint64(0xFFFFFFFFFFFFFF00)) | slots
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).astype(np.int64)), pa.array(np.repeat(ids[at : at + 4096].to_numpy(), SYMBOLS))], ["key", "cid"])
    K.release()


# ---------------------------------------------------------------- pairs


def _distance(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Differing symbols of signatures row by row; SYMBOLS + 1 where one is missing."""
    out = np.full(len(a), SYMBOLS + 1)
    both = np.flatnonzero(a.is_valid().to_numpy(False) & b.is_valid().to_numpy(False))
    if len(both):
        x, y = (np.frombuffer(b"".join(c.take(pa.array(both)).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in (a, b))
        out[both] = (x != y).sum(1)
    return out


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, low_a, high_a, low_b, high_b, n) -> (a, b) of the pairs up to FAR, or SURE where all their buckets have more than two classes and are looked at again."""
    for batch in batches:
        d = np.minimum(_distance(batch.column(2), batch.column(4)), _distance(batch.column(3), batch.column(5)))
        keep = pa.array(d <= np.where(batch.column(6).to_numpy() == 2, FAR, SURE))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def _signatures(column: pa.Array, symbols: int = SYMBOLS, kind: type = np.uint16) -> tuple[np.ndarray, np.ndarray]:
    """(rows, symbols), zero where there is no signature, and whether there is one."""
    there = column.is_valid().to_numpy(False)
    out = np.zeros((len(column), symbols), kind)
    if there.any():
        out[there] = np.frombuffer(b"".join(column.filter(pa.array(there)).to_pylist()), kind).reshape(-1, symbols)
    return out, there


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, tile, tiles, home, cid, component, size, low, high, long, bits) in order of key and tile -> (a, b, agree) of unlike components.

    Rows of a group are compared at distance 1, 2, ... of their places, all groups of a batch at once. In a tile that
    two homes share, only pairs of unlike homes count, as each home has a tile of its own. A pair counts in the first
    of the buckets that it shares. A bit that one bitmap has alone is a shingle of that set alone at least, which bounds
    what two sets can share: a pair left out by that bound is surely not similar enough.
    """

    def pairs(rows: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
        key, tile, tiles, home, cid, comp, size = (rows.column(i).to_numpy(False) for i in range(7))
        kinds = [_signatures(rows.column(i).combine_chunks() if isinstance(rows, pa.Table) else rows.column(i)) for i in (7, 8)]
        longs, _ = _signatures(rows.column(9).combine_chunks() if isinstance(rows, pa.Table) else rows.column(9), LONG // 2, np.uint8)
        bits, _ = _signatures(rows.column(10).combine_chunks() if isinstance(rows, pa.Table) else rows.column(10), BITS // 64, np.uint64)
        slot = key & 255
        cut = np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]), [True]])
        bounds = np.flatnonzero(cut)
        until = np.repeat(bounds[1:], np.diff(bounds))  # where the group of a row ends
        shared = tile // tiles != tile % tiles
        at = np.arange(len(key))
        step = 1
        while True:
            at = at[at + step < until[at]]
            if not len(at):
                return
            i, j = at, at + step
            ok = (comp[i] != comp[j]) & (100 * np.minimum(size[i], size[j]) >= PERCENT * np.maximum(size[i], size[j])) & (~shared[i] | (home[i] != home[j]))
            i, j = i[ok], j[ok]
            for k in range(0, len(i), 1 << 15):
                x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                other = longs[x] ^ longs[y]
                agree = ((other & 15) == 0).sum(1) + (other < 16).sum(1)
                near = agree >= LONG_AGREE
                for sig, there in kinds:
                    near |= there[x] & there[y] & ((sig[x] != sig[y]).sum(1) <= SURE)
                x, y, agree = x[near], y[near], agree[near]
                only_x, only_y = (np.bitwise_count(bits[p] & ~bits[q]).sum(1, dtype=np.int64) for p, q in ((x, y), (y, x)))
                most = np.minimum(size[x] - only_x, size[y] - only_y)
                can = 100 * most >= PERCENT * (size[x] + size[y] - most)
                x, y, agree = x[can], y[can], agree[can]
                first = np.full(len(x), -1)
                for kind in (1, 0):
                    sig, there = kinds[kind]
                    both = np.flatnonzero(there[x] & there[y])
                    differ = (sig[x[both]] != sig[y[both]]).reshape(-1, CHUNKS, CHUNK)
                    close = differ.sum(2) <= 1
                    chunk = close.argmax(1)
                    left_out = differ[np.arange(len(both)), chunk].argmax(1)
                    first[both] = np.where(close.any(1), SYMBOLS * kind + CHUNK * chunk + left_out, first[both])
                here = first == slot[x]
                if here.any():
                    u, v = cid[x[here]], cid[y[here]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(agree[here], pa.int64())], ["a", "b", "agree"])
            step += 1

    held: list[pa.RecordBatch] = []
    for batch in batches:
        key, tile = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        last = len(key) - 1 - int(np.argmin(((key == key[-1]) & (tile == tile[-1]))[::-1])) if ((key != key[-1]) | (tile != tile[-1])).any() else -1
        if last < 0 and (not held or (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) == (int(key[0]), int(tile[0]))):
            held.append(batch)
            continue
        yield from pairs(pa.Table.from_batches([*held, batch.slice(0, last + 1)]))
        held = [batch.slice(last + 1)]
    if held:
        yield from pairs(pa.Table.from_batches(held))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in K.slices(batch.column(1)):
            sets = K.wide_shingle_sets(data, offsets, K.NOT_SPACE, SHINGLE)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "shingles"])


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, shingles) -> (cid, long, bits): the last four bits of LONG symbols, two in a byte, and the bitmap of the shingles."""
    for batch in batches:
        for at in range(0, len(batch), 1000):
            sets = [np.frombuffer(x.as_buffer(), np.uint64)[::2] for x in batch.column(1)[at : at + 1000]]
            sig = (_direct(sets, _LONG_XOR, _LONG_MUL) & 15).astype(np.uint8)
            sig = sig[:, ::2] << 4 | sig[:, 1::2]
            bits = np.zeros((len(sets), BITS), bool)
            for row, one in zip(bits, sets, strict=True):
                row[(K.mix(one) % np.uint64(BITS)).astype(np.int64)] = True
            columns = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (sig, np.packbits(bits, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 1000], *columns], ["cid", "long", "bits"])


def _confirmed(sets: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Of a block's pairs (a, b), those whose sets (cid, shingles) are similar enough, as (u, v)."""
    held = {c: np.frombuffer(x, np.uint64).reshape(-1, 2) for c, x in zip(sets["cid"], sets["shingles"], strict=True)}
    keep = np.zeros(len(pairs), bool)
    for i, (a, b) in enumerate(zip(pairs["a"], pairs["b"], strict=True)):
        x, y = held[a], held[b]
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if 100 * len(x) >= PERCENT * len(y):
            both = K.shared_count(x, y)
            keep[i] = 100 * both >= PERCENT * (len(x) + len(y) - both)
    return pairs.loc[keep, ["a", "b"]].set_axis(["u", "v"], axis=1)


class _Job:
    """One run: the documents, their classes, and the shingle sets of the classes that are held against each other."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = spread(docs, ["doc_id", "text"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
        signed = self.docs.select("doc_id", "tid", "text").mapInArrow(_signed, "doc_id long, tid long, n_shingles long, digest binary, low binary, high binary")
        self.rows = stage(signed, "signed")
        classes = self.rows.where("digest is not null").groupBy("digest").agg(
            F.min("doc_id").alias("least"), F.min_by(F.struct("doc_id", "tid"), F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("at"),
            F.any_value("n_shingles").alias("size"), F.any_value("low").alias("low"), F.any_value("high").alias("high"),
        )
        self.classes = stage(classes.select(F.monotonically_increasing_id().alias("cid"), "digest", "least", F.col("at.doc_id").alias("doc_id"), F.col("at.tid").alias("tid"), "size", "low", "high"), "classes")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(cid, shingles) of the classes in ``wanted`` (cid), from one text of each."""
        at = self.classes.select("cid", "doc_id", "tid").join(wanted.distinct(), "cid").withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
        texts = self.docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).join(at, ["doc_id", "tid"]).select("cid", "text")
        return texts.mapInArrow(_sets, "cid long, shingles binary").dropDuplicates(["cid"])

    def linked(self, pairs: DataFrame) -> DataFrame:
        """(u, v) of the ``pairs`` (a, b) whose whole sets are similar enough.

        Classes are dealt to sides of about SIDE_BYTES of sets; a block is a pair of sides with its pairs, and gets each
        set that it needs once, however many of its pairs name it.
        """
        # cids number the staged classes, so unlike classes never share one
        pairs = stage(pairs.select("a", "b").distinct(), "pairs")
        sets = stage(self.sets(pairs.select(F.col("a").alias("cid")).union(pairs.select("b"))), "sets")
        size = sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
        sides = max(LEAST_SIDES, -(-size // SIDE_BYTES))
        side = lambda c: F.pmod(F.hash(c), F.lit(sides)).cast("long")
        placed = pairs.withColumn("block", side("a") * sides + side("b"))
        needed = placed.select(F.col("block").alias("of"), F.col("a").alias("cid")).union(placed.select("block", "b")).distinct().join(sets, "cid")
        confirmed = needed.groupBy("of").cogroup(placed.groupBy("block")).applyInPandas(_confirmed, "u long, v long")
        links = stage(confirmed, "links")
        discard(pairs, sets)
        return links

    def labels(self, edges: DataFrame) -> DataFrame:
        """(cid, component) of all classes."""
        found = components(edges).select(F.col("node").alias("cid"), "component")
        return stage(self.classes.select("cid").join(found, "cid", "left").select("cid", F.coalesce("component", "cid").alias("component")), "labels")

    def settled(self) -> DataFrame:
        """(cid, component) of all classes, by confirmed pairs."""
        spark, signs = self.docs.sparkSession, self.classes.select("cid", "low", "high")
        keys = self.classes.select("cid", "low", "high").mapInArrow(_keys, "key long, cid long")
        # in order of the exclusive-or of its cid with a constant, the first of a bucket is any one, and is known from it
        order = F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, ORDERS[0]).otherwise(ORDERS[1])
        shared = keys.groupBy("key").agg(F.min(F.col("cid").bitwiseXOR(order)).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = shared.select("key", "n", F.col("least").bitwiseXOR(order).alias("first"))
        buckets = stage(keys.join(shared, "key"), "buckets")
        star = buckets.where("cid <> first").select(F.least("first", "cid").alias("a"), F.greatest("first", "cid").alias("b"), "n").groupBy("a", "b").agg(F.min("n").alias("n"))
        sided = lambda pairs: pairs.join(signs.toDF("a", "low_a", "high_a"), "a").join(signs.toDF("b", "low_b", "high_b"), "b").select("a", "b", "low_a", "high_a", "low_b", "high_b", "n")
        edges = self.linked(sided(star).mapInArrow(_near_pairs, "a long, b long"))
        labels = self.labels(edges)
        # buckets of two are settled by the first round; of the others, those that still span components
        open_rows = buckets.where("n > 2").join(labels, "cid")
        mixed = open_rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        mixed = stage(mixed, "mixed")
        longs = stage(self.sets(open_rows.join(mixed, "key").select("cid")).mapInArrow(_long, "cid long, long binary, bits binary"), "longs")
        tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
        spreaded = open_rows.join(mixed, "key").withColumn("tiles", tiles).withColumn("home", F.pmod(F.hash("cid"), F.col("tiles")))
        spreaded = spreaded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        spreaded = spreaded.withColumn("tile", F.least("home", "other") * F.col("tiles") + F.greatest("home", "other"))
        spreaded = spreaded.join(self.classes.select("cid", "size", "low", "high"), "cid").join(longs, "cid").select("key", "tile", "tiles", "home", "cid", "component", "size", "low", "high", "long", "bits")
        spreaded = spreaded.repartition(shuffle_width(spark), "key", "tile").sortWithinPartitions("key", "tile")
        more = self.linked(spreaded.mapInArrow(_tile_pairs, "a long, b long, agree long"))
        discard(buckets, mixed, longs, labels)
        labels = self.labels(edges.unionByName(more))
        discard(edges, more)
        return labels

    def survivors(self) -> DataFrame:
        """(doc_id, tid) of the row that stands for each component: of the least doc_id, null last, and of its texts that with the least hash."""
        rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")
        found = self.settled().join(self.classes.select("cid", "doc_id", "tid"), "cid")
        kept = stage(found.groupBy("component").agg(F.min(rank).alias("at")).select("at.doc_id", "at.tid"), "survivors")
        discard(self.rows, self.classes)
        return kept

    def run(self) -> DataFrame:
        labels = self.settled()
        held = stage(labels.join(self.classes.select("cid", "digest", "least"), "cid").select("component", "digest", "least"), "held")
        # written first, so that the engine can split a large component in the join
        ids = stage(held.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
        least = stage(held.join(ids, "component").select("digest", "component_id"), "least")
        discard(labels, held, ids, self.classes)
        found = self.rows.where("digest is not null").select("doc_id", "n_shingles", "digest").join(least, "digest").select("doc_id", "n_shingles", "component_id")
        return found.unionByName(self.rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    A null, empty or blank text has no shingles, and is its own component. Rows that repeat a doc_id are rows of their own;
    null doc_ids never become a component's id unless it has no other. An empty table gives no rows.
    """
    return _Job(docs).run()


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, for each component: that with the least doc_id, null last.

    Rows are told by doc_id and text together, so rows that share a doc_id stay where their texts are unlike, and rows
    without one go where they are copies. Texts without words are copies of nothing, and stay.
    """
    kept = _Job(docs).survivors().select(*row_key(F.col("tid")))
    worded = F.coalesce("text", F.lit("")).rlike(NOT_WHITE)
    one = docs.where(worded).select("*", *row_key()).join(kept, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY)
    return one.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(~worded))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS nb FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * nb >= 75 * (x.n + y.n - nb)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
