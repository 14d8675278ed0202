"""Five stages from documents to token files: quality, near copies, benchmark leaks, source mix, tokens.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of documents; the last writes the token files and returns what is read back from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeline.llm.common import new_path, read, stage
from plumeline.llm.decontaminate import clean_rows
from plumeline.llm.mixing import mixed_rows
from plumeline.llm.near_dedup import one_of_each
from plumeline.llm.quality import bucket_of_id, good_rows
from plumeline.llm.token_output import token_digests, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    return good_rows(docs, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), bucket_of_id(F.col("doc_id"), 3) != 1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return clean_rows(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the token files of all documents."""
    import public_tokenizers

    return token_digests(spark, write_tokens(docs, new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: The classifier and the vocabulary are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
