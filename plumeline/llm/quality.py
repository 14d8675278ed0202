"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one binned feature after another, and then on pairs of features. Their leaves add
up to a lookup table for each feature and pair, so a score is a sum of bin entries, looked up for whole columns at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import read, spread, stage

#: Most labelled rows that a model is fitted on: those with the least hashes of their ids.
TRAIN_ROWS = 20_000
BINS = 24
PAIR_BINS = 8
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1
PAIRS = 6

FEATURES = (
    "log_words", "word_length", "upper", "symbols", "bangs", "bars", "digits", "non_ascii", "lines", "stops", "distinct_words",
    "repeated_next", "distinct_pairs", "distinct_lines", "short_words", "long_words", "top_word", "symbol_ends",
)

_KIND = np.zeros(256, np.uint8)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 1, 2, 3, 4
_KIND[[*b"#$%&*@^~_=+<>/\\{}[]"]] = 5
_KIND[[*b"!"]], _KIND[[*b"|"]], _KIND[[*b".,;:?"]], _KIND[[*b"\n"]] = 6, 7, 8, 9
_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[0x0A] = False
_LETTER = np.isin(_KIND, [1, 2, 3, 4, 8])


def _distinct(hashed: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, and how often its most frequent one comes."""
    out, top = np.zeros(len(rows) - 1), np.zeros(len(rows) - 1)
    for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        if b > a:
            one = np.sort(hashed[a:b])
            cut = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1], [True]]))
            out[i], top[i] = len(cut) - 1, np.diff(cut).max()
    return out, top


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) of a slice of texts; shares of an empty text are 0."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n) * 10, np.diff(offsets))
    kinds = np.bincount(row + _KIND[data], minlength=n * 10).reshape(n, 10).astype(float) if len(data) else np.zeros((n, 10))
    starts, ends, hashed, rows = K.words(data, offsets, K.NOT_SPACE)
    words = np.diff(rows).astype(float)
    row_of = np.repeat(np.arange(n), np.diff(rows))
    count = lambda mask: np.bincount(row_of[mask], minlength=n).astype(float)
    length = ends - starts
    same = np.zeros(len(hashed), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (row_of[1:] == row_of[:-1])
    distinct, top = _distinct(hashed, rows)
    pairs = K.grams(hashed, 2)
    pairs = np.concatenate([pairs, np.zeros(len(hashed) - len(pairs), np.uint64)])
    pair_rows = np.stack([rows[:-1], np.maximum(rows[:-1], rows[1:] - 1)], 1)
    distinct_pairs = np.array([len(np.unique(pairs[a:b])) for a, b in pair_rows.tolist()], float)
    _, _, lines, line_rows = K.words(data, offsets, _NOT_BREAK)
    distinct_lines, _ = _distinct(lines, line_rows)
    per = lambda x, total: np.divide(x, total, out=np.zeros(n), where=total > 0)
    size = np.diff(offsets).astype(float)
    columns = [
        np.log1p(words), per(np.bincount(row_of, length, minlength=n), words), per(kinds[:, 2], kinds[:, 1] + kinds[:, 2]), per(kinds[:, 5], size), per(kinds[:, 6], size),
        per(kinds[:, 7], size), per(kinds[:, 3], size), per(kinds[:, 4], size), per(kinds[:, 9], words), per(kinds[:, 8], words), per(distinct, words),
        per(count(same), words), per(distinct_pairs, np.maximum(words - 1, 0)), per(distinct_lines, np.diff(line_rows).astype(float)), per(count(length <= 3), words),
        per(count(length >= 10), words), per(top, words), per(count(~_LETTER[data[ends - 1]]) if len(ends) else np.zeros(n), words),
    ]
    return np.stack(columns, 1)


@dataclass
class AdditiveModel:
    """Cut points and tables: ``singles[f]`` by bin of feature f, ``doubles`` by coarse bins of two features."""

    cuts: list[np.ndarray]
    base: float
    singles: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    doubles: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.singles):
            total += table[np.searchsorted(self.cuts[f], x[:, f], "right")]
        for f, g, table in self.doubles:
            total += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of an ordered run of gradient and hessian sums; place 0: none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    if not len(gl):
        return 0.0, 0
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < 1) | (hr < 1)] = 0
    k = int(gain.argmax())
    return float(gain[k]), k + 1 if gain[k] > 1e-6 else 0


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree of depth two."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, depth: int) -> None:
        _, k = _split(g[a:b], h[a:b]) if depth else (0, 0)
        if k:
            grow(a, a + k, depth - 1)
            grow(a + k, b, depth - 1)
        else:
            out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)

    grow(0, len(g), 2)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values by cell: one cut along an axis, then one along the other on each side."""
    best, value = 0.0, np.zeros(g.shape)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for k in range(1, len(a)):
            gain, out = 0.0, np.zeros(a.shape)
            for part in (slice(0, k), slice(k, None)):
                gs, hs = a[part].sum(0), b[part].sum(0)
                more, at = _split(gs, hs)
                gain += gs.sum() ** 2 / (hs.sum() + 1) + more
                for cells in (slice(0, at), slice(at, None)):
                    if len(gs[cells]):
                        out[part, cells] = -gs[cells].sum() / (hs[cells].sum() + 1)
            if gain > best:
                best, value = gain, out.T if turned else out
    return best - g.sum() ** 2 / (h.sum() + 1), value


def fit_additive(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Without rows the model scores 0.5; with rows of one label only, near that label."""
    if not len(y):
        return AdditiveModel([np.zeros(0)] * len(FEATURES), 0.0, [np.zeros(1)] * len(FEATURES))
    many = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(many)]
    coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for f in range(many)]
    at = [np.searchsorted(cuts[f], x[:, f], "right") for f in range(many)]
    rough = [np.searchsorted(coarse[f], x[:, f], "right") for f in range(many)]
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    margin, singles = np.full(len(y), base), [np.zeros(len(c) + 1) for c in cuts]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f in range(many):
            g, h = slopes()
            step = RATE * _tree(np.bincount(at[f], g, len(singles[f])), np.bincount(at[f], h, len(singles[f])))
            singles[f] += step
            margin += step[at[f]]
    shape = lambda f, g: (len(coarse[f]) + 1, len(coarse[g]) + 1)

    def cells(f: int, g: int) -> tuple[float, np.ndarray]:
        one, two = slopes()
        cell = rough[f] * (len(coarse[g]) + 1) + rough[g]
        return _pair_tree(*[np.bincount(cell, v, int(np.prod(shape(f, g)))).reshape(shape(f, g)) for v in (one, two)])

    ranked = sorted(((cells(f, g)[0], f, g) for f in range(many) for g in range(f + 1, many)), reverse=True)[:PAIRS]
    doubles = [(f, g, np.zeros(shape(f, g))) for _, f, g in ranked]
    for _ in range(PAIR_ROUNDS):
        for f, g, table in doubles:
            step = RATE * cells(f, g)[1]
            table += step
            margin += step[rough[f], rough[g]]
    return AdditiveModel(cuts, base, singles, coarse, doubles)


# ---------------------------------------------------------------- over tables


def bucket_of_id(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text (null: empty text), modulo ``parts``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def label_sample(labels: DataFrame, column: str, learnt: Column, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, label), ``most`` rows at most: of the ids with ``learnt``, those with the least hashes. Null labels do not count; of several, the largest does."""
    rows = spread(labels, ["doc_id", column]).where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & learnt)
    rows = rows.groupBy("doc_id").agg((F.max(column) > 0).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in K.slices(batch.column(1)):
            x = text_features(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *[pa.array(x[:, f]) for f in range(len(FEATURES))]], ["doc_id", *FEATURES])


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, features...) of every row of ``docs`` (doc_id, text)."""
    return spread(docs, ["doc_id", "text"]).mapInArrow(_featured, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def train(features: DataFrame, sample: DataFrame) -> AdditiveModel:
    """The model of the sampled rows (doc_id, label), which are TRAIN_ROWS at most."""
    one = features.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", *FEATURES)).alias("row"))  # of texts that share an id, the least features
    rows = one.select("doc_id", "row.*").toPandas().sort_values("doc_id")
    return fit_additive(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, learnt: Column) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text) by a model of ``labels`` (doc_id, quality) where ``learnt``.

    Null texts count as empty, and empty texts get a score like any other. Rows that repeat are scored each. Null ids are
    scored but never learnt from. Without usable labels every score is 0.5. An empty table gives no rows.
    """
    features = stage(featured(docs), "features")
    model = train(features, label_sample(labels, "quality", learnt))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(1 + f).to_numpy() for f in range(len(FEATURES))], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(x))], ["doc_id", "score"])

    return features.mapInArrow(score, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = bucket_of_id(F.col("doc_id"), 3) == 1
    scores = quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_rows(docs: DataFrame, learnt_from: DataFrame, labels: DataFrame, learnt: Column) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores 0.5 or more by a model of the labelled texts of ``learnt_from``.

    Rows stand for themselves: neither ids nor anything but the text decides. Null texts count as empty.
    """
    sample = stage(label_sample(labels, "quality", learnt), "sample")
    model = train(featured(spread(learnt_from, ["doc_id", "text"]).join(F.broadcast(sample.select("doc_id")), "doc_id")), sample)
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(place)):
                yield batch.slice(a, b - a).filter(pa.array(held.value.score(text_features(data, offsets)) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
