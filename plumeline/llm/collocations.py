"""Phrase collocations by Apriori passes: k-grams are counted only where both their (k-1)-grams are frequent.

Each pass reads all texts. A batch's words become numbers, its k-grams numbers of numbers, and what goes to the shuffle is
a row for each distinct k-gram of the batch, with its count and as text, so sums are exact. The frequent grams of the
pass before are sent to all tasks as a bitmap of their hashes: of SPARE bits a gram, and never more than 2 ** MOST_BITS,
however many grams there are. A gram that passes by chance is counted in vain and then dropped by its count, so the bitmap
decides about cost alone. Phrases are scored and weeded from the level tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import read, spread, stage

LONGEST = 3
LEAST = 10
TOP = 2000
WITHIN = 50  # percent of a phrase's occurrences that a longer one must make up to take its place
SPARE = 32
MOST_BITS = 28  # 32 MiB
SLICE = 1 << 21
NO_LANGUAGE = "und"

_ENDS = np.zeros(256, bool)  # what ends a piece
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False
_LEVEL = "lang string, phrase string, n long"


def _of_language(hashed: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return K.mix(hashed ^ K.mix(lang))


def _hashes(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *[K.Bytes(data, False).hashes(at[:-1], at[1:]) for _, _, data, at in K.slices(texts, SLICE)]])


class _Words:
    """The words of a slice: numbers that stand for language and word, hashes, and how many more follow in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: pa.Array) -> None:
        starts, ends, rows = K.spans(data, offsets, _WORD)
        coded = langs.dictionary_encode()
        self.names, of_row = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lang = np.repeat(of_row, np.diff(rows))
        size = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
        packed = np.ascontiguousarray(K.LOWERED[data[_WORD[data]]])
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(size), pa.py_buffer(packed)]).dictionary_encode()
        self.words, word = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang, self.word, self.code = lang, word, lang * max(1, len(self.words)) + word
        self.hashed, self.lang_hashed = _hashes(self.words)[word], _hashes(self.names)[lang]
        ended = np.append(0, np.cumsum(_ENDS[data]))
        joined = np.zeros(len(starts), bool)
        joined[:-1] = (ended[ends[:-1]] == ended[starts[1:]]) if len(starts) > 1 else False
        joined[rows[1:][np.diff(rows) > 0] - 1] = False
        self.joined = joined

    def at(self, k: int) -> np.ndarray:
        """Places at which ``k`` words in a row stand in one piece."""
        n = len(self.code) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        whole = np.ones(n, bool)
        for j in range(k - 1):
            whole &= self.joined[j : j + n]
        return np.flatnonzero(whole)

    def prints(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the ``k``-grams at these places, with their languages."""
        return _of_language(_gram(self.hashed, at, k), self.lang_hashed[at])

    def counted(self, at: np.ndarray, k: int) -> pa.RecordBatch:
        """A row for each distinct ``k``-gram of these places, exactly."""
        code = self.code[at]
        for j in range(1, k):
            _, code = np.unique(code, return_inverse=True)
            code = code * np.int64(max(1, len(self.words))) + self.word[at + j]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        where = at[first]
        parts = [self.words.take(pa.array(self.word[where + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(self.lang[where])).cast(pa.string()), phrase.cast(pa.string()), pa.array(n)], ["lang", "phrase", "n"])


def _gram(hashed: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = hashed[at]
    for j in range(1, k):
        out = K.mix(out * K._STEP + hashed[at + j])
    return out


def _passes(bitmap: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    at = hashed & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counter(k: int, bitmap):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for x, y, data, offsets in K.slices(batch.column(1), SLICE):
                words = _Words(data, offsets, batch.column(0)[x:y])
                at = words.at(k)
                if held is not None and len(at):
                    ends = np.zeros(len(words.code) + 1, bool)  # whether the (k-1)-gram there is frequent
                    less = words.at(k - 1)
                    ends[less] = _passes(held, words.prints(less, k - 1))
                    at = at[ends[at] & ends[at + 1]]
                if len(at):
                    yield words.counted(at, k)
        K.release()

    return count


def _slots(bits: int):
    """(lang, phrase, n) -> (slot): where each phrase's hash lies in the bitmap."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = _hashes(batch.column(0))
            for x, y, data, offsets in K.slices(batch.column(1), SLICE):
                starts, ends, rows = K.spans(data, offsets, _WORD)
                hashed = K.Bytes(data, False).hashes(starts, ends)
                n = np.diff(rows)
                for k in np.unique(n).tolist():
                    at = np.flatnonzero(n == k)
                    found = _of_language(_gram(hashed, rows[at], k), lang[x:y][at]) & np.uint64((1 << bits) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], ["slot"])

    return slots


def _bitmap(level: DataFrame) -> bytes:
    """The bitmap of a level's phrases: combined word by word on the executors; 2 ** MOST_BITS / 64 rows at most reach the driver."""
    bits = min(MOST_BITS, max(16, (SPARE * level.count()).bit_length()))
    words = level.mapInArrow(_slots(bits), "slot long").groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    packed = np.zeros((1 << bits) // 64, np.int64)
    packed[words["at"].to_numpy()] = words["bits"].to_numpy()
    return packed.tobytes()


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n): all word occurrences of each language; and (lang, phrase, n) of the phrases of 1, 2 ... ``longest`` words that occur ``least`` times or more."""
    context = docs.sparkSession.sparkContext
    texts = spread(docs, ["lang", "text"]).select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    summed = lambda k, bitmap: texts.mapInArrow(_counter(k, bitmap), _LEVEL).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = stage(summed(1, None), "words")
    totals, found = words.groupBy("lang").agg(F.sum("n").alias("n")), [words.where(F.col("n") >= least)]
    for k in range(2, longest + 1):
        bitmap = context.broadcast(_bitmap(found[-1]))
        found.append(stage(summed(k, bitmap).where(F.col("n") >= least), f"grams{k}"))
        bitmap.unpersist()
    return totals, found


def _part(start: Column | int, n: Column) -> Column:
    return F.array_join(F.slice("ws", start, n), " ")


def scored(found: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all phrases of two words or more, by their lowest-scoring cut, the first of those that tie."""
    every, more = found[0], found[1]
    for level in found[1:]:
        every = every.unionByName(level)
    for level in found[2:]:
        more = more.unionByName(level)
    worded = more.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ", -1).alias("ws"))
    cut = worded.select("*", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("first"), _part(F.col("k") + 1, F.size("ws") - F.col("k")).alias("rest"))
    part = lambda name, n: every.select(F.col("lang"), F.col("phrase").alias(name), F.col("n").alias(n))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"cast((1000000 * {whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')}) as bigint)")
    best = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def weeded(phrases: DataFrame) -> DataFrame:
    """``phrases`` without those that stand inside a longer one which makes up WITHIN percent of them or more."""
    inner = phrases.select("lang", "a", F.split("phrase", " ", -1).alias("ws")).where(F.size("ws") > 2)
    inner = inner.select("lang", "a", "ws", F.explode(F.sequence(F.lit(2), F.size("ws") - 1)).alias("k"))
    inner = inner.select("lang", "a", "ws", "k", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("k") + 1)).alias("at"))
    most = inner.select("lang", _part(F.col("at"), F.col("k")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return phrases.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < WITHIN * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language of ``docs`` (lang, text).

    Null and empty texts have no words; null languages are ``und``. Rows that repeat count each. Ties in score and count
    go by the phrase's bytes. A table without phrases that are frequent, an empty one too, gives no rows. A language's
    phrases are cut to ``top`` in every task before they meet.
    """
    totals, found = levels(docs, longest, least)
    phrases = stage(scored(found), "phrases")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    ranked = weeded(phrases).withColumn("rank", place).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, k, phrase, count(*)::BIGINT AS f
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k))
  GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 10),
u AS (SELECT lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:], ' ') AS y FROM c, (SELECT unnest([1, 2]) AS j) WHERE j < k),
s AS (
  SELECT u.lang, u.phrase, a, j, gx.f AS l, gy.f AS r, ((1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (gx.f::HUGEINT * gy.f::HUGEINT))::BIGINT AS score
  FROM u JOIN g gx ON gx.lang = u.lang AND gx.phrase = x AND gx.k = j JOIN g gy ON gy.lang = u.lang AND gy.phrase = y AND gy.k = u.k - j),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, i AS phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS i FROM c WHERE k = 3) GROUP BY ALL),
z AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""
