"""A search index of trigram postings: rows that hold a term are looked for among those that hold its rarest trigrams.

``build`` gives, for each row of a search index, its distinct trigrams of code points. Postings are rows, not lists, so a
trigram that a third of all rows hold is no group of any task. Written, they are laid out in buckets by the trigram's
hash, so that a search reads the buckets of its trigrams alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .discovery import search, terms

GRAM = 3
RAREST = 3  # trigrams of a term whose postings are read
BUCKETS = 64


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text; none of a shorter one."""
    n = F.char_length(text)
    return F.when(n >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(index: DataFrame) -> DataFrame:
    """(bucket, gram, id) of a search index (id, search_text)."""
    rows = index.select("id", F.explode(grams_of(F.col("search_text"))).alias("gram"))
    return rows.select(bucket_of(F.col("gram")).alias("bucket"), "gram", "id")


def sizes(postings: DataFrame) -> DataFrame:
    """(bucket, gram, n): how many rows hold each trigram."""
    return postings.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))


def write(index: DataFrame, path: str) -> None:
    """Postings and their sizes under ``path``, a folder for each bucket, sorted by trigram within files."""
    postings = build(index)
    postings.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    found = read(index.sparkSession, path)
    sizes(found).repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/sizes")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, id string, bucket int").parquet(f"{path}/postings").select("bucket", "gram", "id")


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, n long, bucket int").parquet(f"{path}/sizes").select("bucket", "gram", "n")


def trigrams(term: str) -> list[str]:
    return list(dict.fromkeys(term[i : i + GRAM] for i in range(len(term) - GRAM + 1)))


def _of(rows: DataFrame, grams: list[str]) -> DataFrame:
    """Rows of these trigrams; the buckets are named as well, so that others are not read."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string").select(bucket_of(F.col("gram")).alias("b")).distinct().collect()
    return rows.where(F.col("bucket").isin([r["b"] for r in wanted]) & F.col("gram").isin(grams))


def candidates(postings: DataFrame, counts: DataFrame, query: str) -> DataFrame | None:
    """(id) of rows that hold, of each term of three characters or more, its rarest trigrams; none where no term is that long.

    ``counts`` are the postings' ``sizes``. A trigram that no row holds leaves no candidate.
    """
    long = [t for t in terms(query) if len(t) >= GRAM]
    if not long:
        return None
    every = list(dict.fromkeys(g for t in long for g in trigrams(t)))
    n = {r["gram"]: r["n"] for r in _of(counts, every).collect()}  # a row for each trigram of the query at most
    wanted = set()
    for term in long:
        wanted.update(sorted(trigrams(term), key=lambda g: (n.get(g, 0), g))[:RAREST])
    if any(g not in n for g in every):
        return postings.select("id").where("false")
    held = _of(postings, sorted(wanted)).groupBy("id").agg(F.count_distinct("gram").alias("n"))
    return held.where(F.col("n") == len(wanted)).select("id")


def indexed_search(index: DataFrame, postings: DataFrame, counts: DataFrame, query: str) -> DataFrame:
    """What ``search`` finds, by way of the postings: candidates are verified by the whole terms. Queries without a term of three characters scan all rows."""
    found = candidates(postings, counts, query)
    return search(index if found is None else index.join(found, "id", "left_semi"), query)
