"""Toxicity by weak supervision.

Voters are words and word beginnings: a list of insults, and those that are far more frequent in toxic than in other
labelled texts; further voters look at how many and how dense their hits are. A voter that says nothing speaks for clean, as far as it
is reliable. A generative model of all votes
estimates, by expectation-maximisation, how often each voter is right and which voters are correlated, so that
correlated votes count for less. A linear classifier is then trained on the posterior labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import read, spread, stage
from .near_dedup import near_duplicates
from .quality import bucket_of_id, label_sample

#: Most labelled rows that voters and models are drawn from.
TRAIN_ROWS = 20_000
#: Most voters drawn from labelled texts.
VOTERS = 384
INSULTS = (
    "idiot", "moron", "stupid", "dumb", "loser", "pathetic", "worthless", "disgusting", "scum", "trash", "clown", "garbage", "filth", "vermin", "imbecile", "bastard", "shut", "hate", "kill", "ugly"
)
BEGINNINGS = (4, 5, 6)
LEAST_HITS = 3
#: Least share of toxic among the texts that have a word, of which half a text more counts as clean: rare words must be purer.
LEAST_SHARE = 0.85


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each word and word beginning, and the number of words of each row."""
    starts, ends, hashed, rows = K.words(data, offsets, K.ALNUM)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    out, of = [hashed], [row]
    for k in BEGINNINGS:
        at = np.flatnonzero(ends - starts > k)
        out.append(K.mix(beginning(data, starts[at], k) + np.uint64(k)))
        of.append(row[at])
    return np.concatenate(of), np.concatenate(out), np.diff(rows)


def beginning(data: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` bytes, lower-cased, as a number."""
    total = np.zeros(len(starts), np.uint64)
    for j in range(k):
        total = (total << np.uint64(8)) | K.LOWERED[data[starts + j]].astype(np.uint64)
    return total


def _word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(K.words(data, np.array([0, len(data)]), K.ALNUM)[2][0])


@dataclass
class ToxicModel:
    tokens: np.ndarray  # sorted hashes
    weights: np.ndarray  # for each token, then for the further features
    bias: float

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return votes(self.tokens, data, offsets)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        present, more = self.hits(data, offsets)
        z = self.bias + present @ self.weights[: len(self.tokens)] + more @ self.weights[len(self.tokens) :]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def votes(tokens: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, tokens) which voters speak, and (rows, 4): any, two or more, dense and very dense hits."""
    n = len(offsets) - 1
    row, hashed, words = _tokens(data, offsets)
    present, total = np.zeros((n, len(tokens))), np.zeros(n)
    if len(tokens) and len(hashed):
        at = np.minimum(np.searchsorted(tokens, hashed), len(tokens) - 1)
        hit = np.flatnonzero(tokens[at] == hashed)
        present[row[hit], at[hit]] = 1
        total = np.bincount(row[hit], minlength=n)
    dense = total / np.maximum(words, 1)
    return present, np.stack([total > 0, present.sum(1) > 1, dense > 0.005, dense > 0.02], 1).astype(float)


def label_model(v: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, each voter's chances to speak for (clean, toxic) rows, and each voter's discount for correlation.

    ``v``: (rows, voters) of 0 and 1. The start takes rows with any vote for toxic; the class balance is kept at ``prior``. Reliabilities are settled first, correlations
    are taken from what they leave unexplained, and the posterior counts each vote by its discount.
    """
    n, many = v.shape
    q, odds = np.where(v.sum(1) > 0, 0.9, 0.02), np.log(prior / (1 - prior))

    def posterior(theta: np.ndarray, discount: np.ndarray) -> np.ndarray:
        on, off = np.log(theta[1] / theta[0]), np.log((1 - theta[1]) / (1 - theta[0]))
        return 1 / (1 + np.exp(-np.clip(odds + v @ (on * discount) + (1 - v) @ (off * discount), -30, 30)))

    theta = np.zeros((2, many))
    for _ in range(rounds):
        for y, w in ((0, 1 - q), (1, q)):
            theta[y] = (w @ v + (0.02 if y == 0 else 0.1)) / (w.sum() + 1)
        theta = np.clip(theta, 1e-6, 1 - 1e-6)
        q = posterior(theta, np.ones(many))
    # what is left of the voters' covariance once the label is known; voters that never speak say nothing of others
    residual = v - (np.outer(1 - q, theta[0]) + np.outer(q, theta[1]))
    residual -= residual.mean(0)
    width = np.sqrt((residual**2).mean(0))
    corr = residual.T @ residual / max(n, 1) / np.maximum(np.outer(width, width), 1e-9)
    np.fill_diagonal(corr, 0)
    corr[:, v.sum(0) == 0] = 0
    discount = 1 / (1 + np.where(np.abs(corr) > 0.1, corr**2, 0).sum(0))
    return posterior(theta, discount), theta, discount


def linear_model(x: np.ndarray, q: np.ndarray, rounds: int = 40, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on the soft labels ``q``, by damped Newton steps."""
    full = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(full.shape[1])
    penalty = np.full(full.shape[1], ridge * 10)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((full * h[:, None]).T @ full + np.diag(penalty), full.T @ (p - q) + penalty * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def _association(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) -> (token, texts, toxic texts), summed over each slice."""
    for batch in batches:
        label = batch.column(0).to_numpy()
        for a, b, data, offsets in K.slices(batch.column(1)):
            row, hashed, _ = _tokens(data, offsets)
            if not len(row):
                continue
            order = np.lexsort((row, hashed))
            row, hashed = row[order], hashed[order]
            keep = np.concatenate([[True], (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])])
            row, hashed = row[keep], hashed[keep]
            first = np.flatnonzero(np.concatenate([[True], hashed[1:] != hashed[:-1]]))
            toxic = np.add.reduceat(label[a + row].astype(np.int64), first)
            yield pa.RecordBatch.from_arrays([pa.array(hashed[first].astype(np.int64)), pa.array(np.diff(np.append(first, len(row)))), pa.array(toxic)], ["token", "n", "toxic"])


def thinned(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Of ``sample`` (doc_id, label), the least id of each label in each group of near copies among its texts in ``docs``."""
    sample = stage(sample, "sample")
    texts = stage(spread(docs, ["doc_id", "text"]).join(F.broadcast(sample), "doc_id"), "texts")
    one = near_duplicates(texts).join(F.broadcast(sample), "doc_id").groupBy("component_id", "label").agg(F.min("doc_id").alias("doc_id"))
    return stage(sample.join(one.select("doc_id"), "doc_id", "left_semi"), "sample")


def train(docs: DataFrame, sample: DataFrame) -> ToxicModel:
    """The model of the sampled rows (doc_id, label), which are TRAIN_ROWS at most, with the texts of ``docs``.

    Of sampled near copies with the same label only one is learnt from, so that what is peculiar to a copied text does not
    pass for a voter. Texts that are unlike are all learnt from.
    """
    sample = thinned(docs, sample)
    texts = spread(docs, ["doc_id", "text"]).join(F.broadcast(sample), "doc_id")
    found = texts.select("label", "text").mapInArrow(_association, "token long, n long, toxic long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    share = F.col("toxic") / (F.col("n") + 0.5)
    found = found.where((F.col("toxic") >= LEAST_HITS) & (share >= LEAST_SHARE)).orderBy((share * F.log("toxic")).desc(), "token").limit(VOTERS).toPandas()
    tokens = np.unique(np.concatenate([found["token"].to_numpy().astype(np.uint64), np.array([_word_hash(w) for w in INSULTS], np.uint64)]))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(2)):
                present, more = votes(tokens, data, offsets)
                both = np.packbits(np.concatenate([present, more], 1).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array([r.tobytes() for r in both], pa.binary())], ["doc_id", "label", "votes"])

    voted = texts.select("doc_id", "label", "text").mapInArrow(vote, "doc_id long, label int, votes binary")
    rows = voted.groupBy("doc_id").agg(F.min(F.struct("label", "votes")).alias("row")).select("doc_id", "row.*").toPandas().sort_values("doc_id")
    many = len(tokens) + 4
    if not len(rows):
        return ToxicModel(tokens, np.concatenate([np.full(len(tokens), 1.0), [3.0, 1.0, 1.0, 1.0]]), -3.0)
    v = np.unpackbits(np.frombuffer(b"".join(rows["votes"]), np.uint8).reshape(len(rows), -1), axis=1)[:, :many].astype(float)
    prior = float(np.clip((rows["label"].sum() + 1) / (len(rows) + 2), 0.005, 0.5))
    q, _, _ = label_model(v, prior)
    weights, bias = linear_model(v, q)
    return ToxicModel(tokens, weights, bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, learnt: Column) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text) by a model of ``labels`` (doc_id, toxic) where ``learnt``.

    Null and empty texts get the score of a text without votes. Rows that repeat are scored each. Null ids are scored but
    never learnt from. Without usable labels the list of insults alone decides. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, label_sample(labels, "toxic", learnt, TRAIN_ROWS)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(model.value.score(data, offsets))], ["doc_id", "score"])

    return spread(docs, ["doc_id", "text"]).mapInArrow(score, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = bucket_of_id(F.col("doc_id"), 5) == 0
    scores = toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
