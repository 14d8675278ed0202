"""Session, table and staging helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = "\\x20\\x09-\\x0D"
NOT_WHITE = f"[^{WHITE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``. Only a local session may leave it unset: it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='plumeline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plumeline/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a finished query's shuffle files go at once, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, a lost executor costs no recomputation, and shuffle files go."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing to come reads, through whatever store the shared folder is in."""
    for df in staged:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Columns that tell rows apart: the doc_id, and a hash of the text.
ROW_KEY = ["__none", "__id", "__tid"]


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_key(tid: Column | None = None) -> list[Column]:
    """ROW_KEY of rows (doc_id, text), or (doc_id) and the hash that is given; no part of it is null."""
    parts = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), text_hash(F.col("text")) if tid is None else tid
    return [p.alias(name) for p, name in zip(parts, ROW_KEY, strict=True)]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only ``columns``, so that other columns of the input, whatever their names, cannot clash with working ones."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
