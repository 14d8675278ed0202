"""Cross-tokenizer alignment: two tokenizers' tokens of one text, grouped where both end, over distinct segments.

A text, with a space before it, is cut before runs of white space that start with a space, where neither vocabulary can
merge across: ``verified`` looks through both for entries that hold a space after another character. Tokens of the
whole text are then those of its segments, joined. Texts travel as numbers into the segments of their block, a bounded
part of a task's rows; every distinct segment of all blocks is tokenised and aligned once; alignments go back to the
blocks by joins, and documents are composed there. How many documents hold an id pair linked is counted in the blocks,
summed, looked up once for each distinct segment, and goes back by the same join.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import discard, read, spread, stage

BLOCK = 1 << 24  # bytes of text in a block; a longer text makes a block of its own
CHUNK = 1 << 20  # bytes of a block that are cut at once
CODES = 1 << 18  # codes of a block that are worked on at once; whole rows
#: White space beyond ASCII, in UTF-8, and U+2581, by which the second tokenizer writes a space.
_WIDE = {int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x2581, 0x3000)}
_PART = 4096  # segments that are tokenised at once


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others, in order, for U+0100 onward."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _piece_bytes(piece: str) -> bytes:
    byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


@functools.cache
def tokenizers(a_path: str, b_path: str):
    """Both tokenizers and the bytes of their entries by id."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    value, special = byte_values(), {i: t.content.encode() for i, t in a.get_added_tokens_decoder().items()}
    a_bytes = {i: special[i] if i in special else bytes(value[c] for c in entry) for entry, i in a.get_vocab(with_added_tokens=True).items()}
    return a, b, [a_bytes[i] for i in range(len(a_bytes))], [_piece_bytes(b.id_to_piece(i)) for i in range(b.get_piece_size())]


def verified(a_path: str, b_path: str) -> list[int]:
    """Bytes after which a text must not be cut, as an entry of one of the vocabularies has such a byte and then a space.

    The first tokenizer has to split words as byte-level vocabularies do, before any white space that follows something
    else, and neither may rewrite its input in a way that reaches over a space.
    """
    said = json.loads(_read(a_path))
    split = said["pre_tokenizer"] or {}
    if said["normalizer"] is not None or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
        raise ValueError(f"{a_path}: only byte-level vocabularies without normalisation are known to split before white space")
    _, b, a_bytes, b_bytes = tokenizers(a_path, b_path)
    if b.normalize("x  éﬁ y") != "▁x▁▁éﬁ▁y":
        raise ValueError(f"{b_path}: its normalisation may reach over spaces")
    return sorted({entry[k - 1] for entries in (a_bytes, b_bytes) for entry in entries for k in range(1, len(entry)) if entry[k] == 0x20 and entry[k - 1] > 0x20})


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def cuts(data: np.ndarray, offsets: np.ndarray, unsafe: list[int]) -> np.ndarray:
    """Where segments start: at each text, and at spaces after something that is not white space, unless only white space follows in the text."""
    n = len(data)
    white = np.zeros(256, bool)
    white[[0x20, *range(0x09, 0x0E)]] = True
    on = white[data]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 0x20, data[:-1]
    barred = np.zeros(256, bool)
    barred[: 0x21] = barred[0x7F] = True
    barred[unsafe] = True
    at = np.flatnonzero((data == 0x20) & ~barred[before])
    at = at[~np.isin(at, offsets)]
    two = np.where(at >= 2, data[at - 2], 0).astype(np.int64) << 8 | data[at - 1]
    three = np.where(at >= 3, data[at - 3], 0).astype(np.int64) << 16 | two
    at = at[~(np.isin(two, [w for w in _WIDE if w < 1 << 16]) | np.isin(three, [w for w in _WIDE if w >= 1 << 16]))]
    full = np.flatnonzero(offsets[:-1] < offsets[1:])
    solid = np.flatnonzero(~on)
    last = np.searchsorted(solid, offsets[1:]) - 1  # the last character of each text that is not white space
    last = np.where(last >= 0, solid[np.maximum(last, 0)] if len(solid) else -1, -1)
    at = at[at < last[np.searchsorted(offsets, at, "right") - 1]]
    return np.unique(np.concatenate([offsets[:-1][full], at]))


def _chunks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Rows from and to, of about ``size`` between their offsets."""
    at = 0
    while at < len(offsets) - 1:
        to = min(len(offsets) - 1, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
        yield at, to
        at = to


def _packed(codes: np.ndarray) -> bytes:
    return pa.compress(codes.astype("<i4").tobytes(), "zstd", asbytes=True)


def _unpacked(codes: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(codes, 4 * n, "zstd", asbytes=True), "<i4") if n else np.zeros(0, np.int32)


def _blocks(unsafe: list[int]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text) -> (doc_ids, ends, codes, segments): of each block, its rows' places in ``codes``, which are places in ``segments``."""
        for batch in batches:
            for x, y, data, offsets in K.slices(batch.column(1), BLOCK):
                parts = [np.zeros(0, np.int64)]
                for a, b in _chunks(offsets, CHUNK):
                    if offsets[b] > offsets[a]:
                        parts.append(offsets[a] + cuts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], unsafe))
                starts = np.concatenate(parts)
                whole = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
                coded = whole.dictionary_encode()
                ends = np.searchsorted(starts, offsets[1:]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (batch.column(0)[x:y], pa.array(ends), coded.dictionary.cast(pa.string()))]
                yield pa.RecordBatch.from_arrays([*lists[:2], pa.array([_packed(coded.indices.to_numpy(zero_copy_only=False))], pa.binary()), lists[2]], ["doc_ids", "ends", "codes", "segments"])
        K.release()

    return cut


def _joined(entries: list[bytes], ids: np.ndarray, of: np.ndarray, n: int) -> list[bytes]:
    """The bytes that each segment's ids spell."""
    ends = np.cumsum(np.bincount(of, minlength=n)).tolist()
    spelled = [entries[i] for i in ids.tolist()]
    return [b"".join(spelled[x:y]) for x, y in zip([0, *ends[:-1]], ends, strict=True)]


def aligned(segments: list[str], a: list[list[int]], b: list[list[int]], a_bytes: list[bytes], b_bytes: list[bytes]) -> list[str | None]:
    """The groups of each segment as a1,a2|b1;a3|b2,b3; none where its tokens do not spell it."""
    n = len(segments)
    of_a, of_b = (np.repeat(np.arange(n), [len(x) for x in ids]) for ids in (a, b))
    a_ids, b_ids = (np.array([i for x in ids for i in x], np.int64) for ids in (a, b))
    whole = [s.encode() for s in segments]
    fits = np.array([x == y == z for x, y, z in zip(whole, _joined(a_bytes, a_ids, of_a, n), _joined(b_bytes, b_ids, of_b, n), strict=True)], bool)
    size = np.array([len(x) for x in whole], np.int64)
    a_ids, of_a, b_ids, of_b = a_ids[fits[of_a]], of_a[fits[of_a]], b_ids[fits[of_b]], of_b[fits[of_b]]
    a_ends, b_ends = (np.cumsum([len(entries[i]) for i in ids.tolist()], dtype=np.int64) for entries, ids in ((a_bytes, a_ids), (b_bytes, b_ids)))
    ends = np.intersect1d(a_ends, b_ends)  # tokens of both spell the same bytes in a row, so groups never cross segments
    a_group, b_group = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
    of_group = np.searchsorted(np.cumsum(np.where(fits, size, 0)), ends)
    many_a, many_b = np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends))
    one, two = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
    shown: list[list[str]] = [[] for _ in range(n)]
    x = y = 0
    for k, na, nb in zip(of_group.tolist(), many_a.tolist(), many_b.tolist(), strict=True):
        shown[k].append(f"{one[x]}|{two[y]}" if na == nb == 1 else f"{','.join(one[x : x + na])}|{','.join(two[y : y + nb])}")
        x, y = x + na, y + nb
    return [";".join(g) if ok else None for g, ok in zip(shown, fits.tolist(), strict=True)]


def linked(shown: str) -> tuple[int, int, int, list[int]]:
    """(n_a, n_b, n_groups, pairs) of a list of groups: the id pairs of all its links, a in the upper 32 bits."""
    n_a = n_b = 0
    pairs, groups = [], shown.split(";")
    for group in groups:
        a, b = group.split("|")
        if "," in group:
            one, two = a.split(","), b.split(",")
            pairs += [int(p) << 32 | int(q) for p in one for q in two]
            n_a, n_b = n_a + len(one), n_b + len(two)
        else:
            pairs.append(int(a) << 32 | int(b))
            n_a, n_b = n_a + 1, n_b + 1
    return n_a, n_b, len(groups), pairs


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _aligner(a_path: str, b_path: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a, b, a_bytes, b_bytes = tokenizers(a_path, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, _PART):
                part = batch.column(0)[at : at + _PART]
                texts = part.to_pylist()
                one = [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)]
                two = b.encode([s[1:] for s in texts], num_threads=1)  # the space that every segment starts with is the one that this tokenizer adds
                yield pa.RecordBatch.from_arrays([part, pa.array(aligned(texts, one, two, a_bytes, b_bytes), pa.string())], ["segment", "shown"])
        K.release()

    return align


def _of_rows(ends: np.ndarray) -> np.ndarray:
    """Which row of its block each code belongs to."""
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whole-number sums of each row's values, exact beyond what a weighted bincount is."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[ends], prepend=0)


def _pairs_of_rows(ends: np.ndarray, codes: np.ndarray, fit: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id pairs, and in how many of the rows that fit each is linked. ``flat`` has the pairs of all codes in a row, ``sizes`` how many are each code's."""
    names, dense = np.unique(flat, return_inverse=True)
    first, n = np.cumsum(sizes) - sizes, np.zeros(len(names), np.int64)
    offsets = np.append(0, ends).astype(np.int64)
    for x, y in _chunks(offsets, CODES):
        row_of = np.repeat(np.arange(y - x), np.diff(offsets[x : y + 1]))
        keep = fit[x:y][row_of]
        once = np.unique(row_of[keep] * np.int64(max(1, len(sizes))) + codes[offsets[x] : offsets[y]][keep])  # a segment counts once in a row
        if len(once):
            row, code = once // len(sizes), once % len(sizes)
            took = sizes[code]
            at = np.repeat(first[code] - (np.cumsum(took) - took), took) + np.arange(took.sum())
            held = np.unique(np.repeat(row, took) * np.int64(max(1, len(names))) + dense[at])
            n += np.bincount(held % len(names), minlength=len(names))
    return names[n > 0], n[n > 0]


def _composer(digests: bool):
    def compose(key, block: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        """The block's rows from their segments' groups, and its id pairs with the numbers of rows that hold them."""
        out = []
        texts = more["shown"].to_numpy()[np.argsort(more["code"].to_numpy())]
        fits = np.array([t is not None for t in texts], bool)
        told, flat = array("q"), array("q")
        for t in texts:
            *counts, pairs = linked(t) if t is not None else (0, 0, 0, [])
            told.extend((*counts, len(pairs)))
            flat.extend(pairs)
        numbers, flat = np.array(told, np.int64).reshape(-1, 4), np.array(flat, np.int64)
        for home, ids, ends, codes in zip(*[block[c] for c in ("block", "doc_ids", "ends", "codes")], strict=True):
            at = np.asarray(ends)
            words = _unpacked(codes, int(at[-1]))
            fit, groups, counts = np.ones(len(at), bool), [], []
            offsets = np.append(0, at).astype(np.int64)
            for x, y in _chunks(offsets, CODES):
                part, to = words[offsets[x] : offsets[y]], offsets[x + 1 : y + 1] - offsets[x]
                fit[x:y] = ok = np.bincount(_of_rows(to), ~fits[part], y - x) == 0
                shown = texts[part]
                listed = [";".join(shown[p:q]) if o else "" for p, q, o in zip([0, *to[:-1]], to, ok, strict=True)]
                groups += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in listed] if digests else listed
                counts.append(np.stack([np.where(ok, _sums(numbers[part, k], to), 0) for k in range(4)]))
            pairs, n = _pairs_of_rows(at, words, fit, numbers[:, 3], flat)
            out.append((home, ids, ends, codes, fit, *np.concatenate(counts, 1), groups, pairs, n))
        K.release()
        return pd.DataFrame(out, columns=["block", "doc_ids", "ends", "codes", "fit", *_COUNTS, "groups", "pairs", "n"])

    return compose


_BLOCK = "block long, doc_ids array<string>, ends array<int>, codes binary"
_COMPOSED = f"{_BLOCK}, fit array<boolean>, " + ", ".join(f"{c} array<long>" for c in _COUNTS) + ", groups array<string>, pairs array<long>, n array<long>"


def _scores(key, block: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
    """The block's rows with what their links' counts add up to."""
    order, out = np.argsort(more["code"].to_numpy()), []
    for ids, ends, codes, fit, groups, *counts in zip(*[block[c] for c in ("doc_ids", "ends", "codes", "fit", "groups", *_COUNTS)], strict=True):
        ends, fit = np.asarray(ends), np.asarray(fit, bool)
        codes = _unpacked(codes, int(ends[-1]))
        sums = [np.where(fit, _sums(more[c].to_numpy()[order][codes], ends), 0) for c in ("n_best", "count_sum")]
        out.append(pd.DataFrame(dict(zip(["doc_id", *_COUNTS, "n_best", "count_sum", "groups"], [ids, *counts, *sums, groups], strict=True))))
    K.release()
    return pd.concat(out)


def align(docs: DataFrame, a_path: str, b_path: str, digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """Alignments of the rows of ``docs`` (doc_id, text), and links: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) and (a, b, n).

    ``groups`` lists the groups as a1,a2|b1;a3|b2,b3; with ``digests`` it is that list's SHA-256, in hexadecimal, unless it
    is empty. ``n`` is how many rows hold ids a and b linked. Null and empty texts, and those that the tokens of one
    tokenizer do not spell, have no tokens: zeros and an empty list, and count for no pair. Rows that repeat count each;
    ties for an id's highest count are all highest. An empty table gives no rows.
    """
    unsafe = verified(a_path, b_path)
    texts = spread(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit(" "), "text")).alias("text"))
    cut = texts.mapInArrow(_blocks(unsafe), "doc_ids array<string>, ends array<int>, codes binary, segments array<string>")
    blocks = stage(cut.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")
    listed = blocks.select(F.col("block").alias("home"), F.posexplode("segments").alias("code", "segment"))
    segments = stage(listed.select("segment").distinct().mapInArrow(_aligner(a_path, b_path), "segment string, shown string").withColumn("number", F.monotonically_increasing_id()), "segments")
    placed = stage(listed.join(segments, "segment").select("home", "code", "number", "shown"), "placed")

    rows = blocks.select("block", "doc_ids", "ends", "codes").groupBy("block")
    composed = stage(rows.cogroup(placed.select("home", "code", "shown").groupBy("home")).applyInPandas(_composer(digests), _COMPOSED), "composed")
    discard(blocks)
    counts = composed.select(F.explode(F.arrays_zip("pairs", "n")).alias("p")).groupBy("p.pairs").agg(F.sum("p.n").alias("n"))
    pairs = stage(counts.select(F.shiftright("pairs", 32).alias("a"), F.col("pairs").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n"), "pairs")

    # what a segment's links add up to; those of segments that stand in unfit rows alone add nothing
    best = pairs.groupBy("a").agg(F.max("n").alias("most"))
    known = pairs.join(best, "a").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("is_best"))
    group = segments.select("number", F.explode(F.split("shown", ";", -1)).alias("g")).select("number", F.split("g", "[|]").alias("g"))
    links = group.select("number", F.explode(F.split(F.get("g", 0), ",")).alias("a"), F.get("g", 1).alias("g")).select("number", F.col("a").cast("long").alias("a"), F.explode(F.split("g", ",").cast("array<long>")).alias("b"))
    sums = stage(links.join(known, ["a", "b"]).groupBy("number").agg(F.sum("is_best").alias("n_best"), F.sum("n").alias("count_sum")), "sums")
    discard(segments)
    more = placed.select("home", "code", "number").join(sums, "number", "left").select("home", "code", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))
    schema = "doc_id string, " + ", ".join(f"{c} long" for c in (*_COUNTS, "n_best", "count_sum")) + ", groups string"
    found = composed.drop("pairs", "n").groupBy("block").cogroup(more.groupBy("home")).applyInPandas(_scores, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("long")), pairs


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found, _ = align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)
    return found.withColumnRenamed("groups", "groups_sha256")
