"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text is a bag of words weighted by their numbers. For each of SAMPLES draws, a word has, from hashes of it alone, two
gamma variables r and c of shape 2 and a uniform b; for a weight w it has the level n = floor(ln w / r + b) and the value
ln c - r (n - b + 1). The word and level of the least value are the sample. Two bags give the same sample with the chance
that is their generalised Jaccard similarity, the sum of the lesser weights over that of the greater ones.

Documents are put in descending order of doc_id by ranges of ids: the first row of each range also goes, as a row to be
looked at, to the range before it. A text and its edited form share most words, which are counted, and whose variables
are drawn, once for both; counting and sampling follow in the ranges' own tasks, without another shuffle of texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITE, read, shuffle_width, spread, stage

SAMPLES = 32
_ROW = 4  # samples that one row is worked out for: more in a row make code that the JVM doesn't compile
BITS = 20  # of a sample's hash that the fingerprint keeps
LEAST_ID = -(1 << 63)


# ---------------------------------------------------------------- the order of documents


def _bounds(docs: DataFrame) -> list[int]:
    """The greatest ids of ranges of about as many rows each; all are ids that there are, and the last is the greatest."""
    n = 2 * shuffle_width(docs.sparkSession)
    found = docs.agg(F.percentile_approx("key", [k / n for k in range(1, n)], max(10_000, 20 * n)).alias("at"), F.max("key").alias("last")).first()
    return [] if found["last"] is None else sorted({x for x in found["at"] if x < found["last"]} | {found["last"]})


def _ahead(rows: DataFrame, first: Column, n: int) -> DataFrame:
    """``rows`` (of, ...) and, for the range after each of the ``n``, a copy of its ``first`` rows to look ahead to."""
    return rows.withColumn("ahead", F.explode(F.when(first, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))).withColumn("of", F.when(F.col("ahead"), F.pmod(F.col("of") + 1, F.lit(n))).otherwise(F.col("of")))


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text) with ``of``, ``place`` (a range of ids, and the place in it from 1), ``next``: the text of the next row; and the number of ranges.

    The next row is that with the next lesser doc_id, that of the last is the first. Rows without an id are the last; rows
    that share an id are in order of their texts' hashes, and then of the texts.
    """
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(LEAST_ID)))
    bounds = _bounds(docs)
    at = F.array(*[F.lit(x) for x in bounds]).cast("array<long>")
    rows = docs.withColumn("of", F.size(F.filter(at, lambda x: x < F.col("key"))).cast("long"))
    rows = _ahead(rows, F.get(at, F.col("of").cast("int")) == F.col("key"), max(1, len(bounds)))
    order = Window.partitionBy("of").orderBy("ahead", F.desc("key"), F.col("doc_id").isNull(), F.xxhash64("text"), "text")
    return rows.select("doc_id", "text", "of", "ahead", F.row_number().over(order).cast("long").alias("place"), F.lead("text").over(order).alias("next")).where("not ahead").drop("ahead"), max(1, len(bounds))


# ---------------------------------------------------------------- sampling

_LN2 = math.log(2)


def _uniforms(hashed: str, shift: int, bits: int) -> str:
    """A uniform number in (0, 2 ** bits) from ``bits`` of a hash."""
    return f"(cast(shiftrightunsigned({hashed}, {shift}) & {(1 << bits) - 1}L as double) + 0.5D)"


def signatures(terms: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    """``keys`` and an array of samples under each name of ``weights``, from rows (keys, t, weights): a term's hash and its weights, a row for each key and term.

    A bag whose weights are all 0 or null has null. Rows carry nothing else, as the JVM leaves longer code uncompiled.
    """
    rows = terms.select(*keys, "t", *[F.ln(F.col(w).cast("double")).alias(w) for w in weights], F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // _ROW - 1))).alias("k"))
    pass_on, each = [*keys, "k", *weights], range(_ROW)
    # one step for each use of what was named in the step before, so that nothing is worked out twice
    rows = rows.select(*pass_on, F.expr("xxhash64(t, k)").alias("t"))
    rows = rows.select(*pass_on, *[F.expr(f"xxhash64(t ^ {i}L) as h{i}") for i in each])
    rows = rows.select(*pass_on, *[F.expr(e) for i in each for e in (f"h{i}", f"xxhash64(h{i}) as g{i}")])
    r = "{0}D - ln({1} * {2})"
    rows = rows.select(
        *pass_on,
        *[F.expr(f"g{i}") for i in each],
        *[F.expr(r.format(44 * _LN2, _uniforms(f"h{i}", 42, 22), _uniforms(f"h{i}", 20, 22)) + f" as r{i}") for i in each],
        *[F.expr(f"ln({r.format(64 * _LN2, _uniforms(f'g{i}', 32, 32), _uniforms(f'g{i}', 0, 32))}) as c{i}") for i in each],
        *[F.expr(f"cast(h{i} & {(1 << 20) - 1}L as double) * {2.0**-20!r}D as b{i}") for i in each],
    )
    rows = rows.select(*pass_on, *[f"{x}{i}" for i in each for x in "grcb"], *[F.expr(f"floor({w} / r{i} + b{i}) as {w}_n{i}") for w in weights for i in each])
    # the value above, the sample's hash below: the least of these longs is the sample of the least value
    least = lambda w, i: F.expr(f"min(shiftleft(cast((c{i} - r{i} * (cast({w}_n{i} as double) - b{i} + 1D) + 128D) * {2.0**35!r}D as bigint), {BITS}) | ((g{i} ^ {w}_n{i}) & {(1 << BITS) - 1}L))")
    found = rows.groupBy(*keys, "k").agg(*[least(w, i).alias(f"{w}_{i}") for w in weights for i in each])
    found = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", *[F.array(*[F.col(f"{w}_{i}") for i in each]).alias(w) for w in weights]))).alias("rows"))
    low = lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    samples = [F.when(F.get("rows", 0)[w][0].isNotNull(), F.transform(F.flatten(F.col("rows")[w]), low)).alias(w) for w in weights]
    return found.select(*keys, *samples)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples; 1 for two bags without terms, 0 for one of them."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.lit(float(SAMPLES))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same)


def shown(samples: Column) -> Column:
    """The fingerprint: the samples' hashes in hexadecimal; empty without terms."""
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), ""), F.lit(""))


# ---------------------------------------------------------------- texts


def _counted(rows: DataFrame) -> DataFrame:
    """(of, place, t, own, edited): hash of each word and how often the text and the edited text hold it; at least one row for each row."""
    words = rows.select("of", "place", F.posexplode(F.array("common", "own", "edited")).alias("part", "s")).select("of", "place", "part", F.explode(F.split("s", f"[{WHITE}]+", -1)).alias("word"))
    count = lambda other: F.count_if((F.col("word") != "") & (F.col("part") != other))
    return words.select("of", "place", F.xxhash64("word").alias("t"), "word", "part").groupBy("of", "place", "t").agg(count(2).alias("own"), count(1).alias("edited"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of ``docs`` (doc_id, text).

    The edited text is the text with its last third, rounded down, replaced by the first as many code points, or all, of the
    next document in descending order of doc_id; after the last comes the first. Words are runs without ASCII white space,
    case kept. Null counts as empty; texts without words have empty fingerprints, alike among each other and unlike all
    others. Equal texts have equal fingerprints. Rows without an id are the last; rows that share one are in order of
    their texts, so equal rows are neighbours. A single row is its own next document. An empty table gives no rows.
    """
    texts = spread(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, n = with_next(texts)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("cut", F.expr("cast(n_chars div 3 as int)")).withColumn("head", F.expr("left(text, cast(n_chars - cut as int))"))
    rows = rows.withColumn("other", F.concat("head", F.expr("left(next, cut)")))
    known = stage(rows.select("of", "place", "doc_id", "n_chars", F.sha2("other", 256).alias("edited_sha256")), "edited")

    # the rows are put in order once more, to the same places, as texts on disk would take more than to deal them out again
    rows = rows.withColumn("common", F.regexp_extract("head", f"(?s)^(.*[{WHITE}])", 1))
    rest = lambda text, name: F.expr(f"substring({text}, length(common) + 1)").alias(name)
    words = _counted(rows.select("of", "place", "common", rest("text", "own"), rest("other", "edited")))
    found = stage(signatures(words, ["of", "place"], ["own", "edited"]), "fingerprints")

    order = Window.partitionBy("of").orderBy("ahead", "place")
    found = _ahead(found, F.col("place") == 1, n).withColumn("next", F.lead(F.struct("own")).over(order)).where("not ahead")
    found = found.select("of", "place", shown(F.col("own")).alias("fingerprint"), shown(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next.own")).alias("near_next"))
    return known.join(found, ["of", "place"]).drop("of", "place")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
