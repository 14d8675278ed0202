"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every document has a fixed 60-bit hash. A source's words are summed by the top bits of that hash; the running sum
shows in which bucket the budget is crossed, and only that bucket is summed again by its next bits, until the bits
are used up. A document is in when its hash lies below its source's threshold: no document is ever sorted.
Budgets are nested: a source that may be taken twice keeps one whole pass and thresholds only the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NOT_WHITE, read, shuffle_width, spread, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BITS = 60
STEP = 12


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WHITE)).cast("long"), F.lit(0).cast("long"))


def unit_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of the id as text, a colon and the text; null counts as empty. Rows that share an id, or have none, are told by their texts."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, under each name of ``sums``, the sum of a column over the rows before it in ``order``.

    Rows are dealt by range, summed in each range, and the ranges' totals (a row for each range) are sent to all.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    dealt = stage(rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).select("*", F.spark_partition_id().alias("__range")), "ranges")
    before = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    ranges = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__range", *[F.coalesce(F.sum(f"__{name}").over(ranges), F.lit(0)).alias(f"__{name}") for name in sums])
    joined = dealt.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for name, c in sums.items()]).join(F.broadcast(totals), "__range")
    return joined.select(*columns, *[(F.col(name) + F.col(f"__{name}")).alias(name) for name in sums])


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources in order of code points, null last, weigh 5, 2, 1, repeating. Sharing the excess of capped sources until
    none is above its cap ends at min(cap, level * weight) for one level. In order of cap by weight, each source
    gives the level at which all before it are capped and it is not; levels that do not cap it only fall from there on.
    """
    by_name, size = F.col("source").asc_nulls_last(), F.col("source_size")
    numbered = sums_before(sizes, [by_name], {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.pmod("place", F.lit(len(WEIGHTS))) + 1).cast("int"))
    led = sums_before(numbered.select("source", "source_size", weight.alias("weight")), [size / F.col("weight"), by_name], {"size_before": size, "weight_before": F.col("weight")})
    led = stage(led, "led")
    total = led.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    level = (F.lit(SHARE) * F.lit(total["size"]) - F.lit(MOST) * F.col("size_before")) / (F.lit(total["weight"]) - F.col("weight_before"))
    cap = F.lit(MOST) * size
    top = led.where(level * F.col("weight") <= cap).agg(F.max(level).alias("level")).first()["level"]
    return led.select("source", "source_size", (F.least(cap, F.lit(top) * F.col("weight")) if top is not None else cap).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, bound): a document is taken ``whole`` times, and once more if its hash is below ``bound``.

    Each level sums one bucket of each source by STEP more bits, so that no group has more than 2 ** STEP rows.
    """
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(MOST)))).otherwise(0)
    state = targets.withColumn("whole", whole.cast("long"))
    # prefix: the bits known so far of the hash at which the budget is crossed; below: words under that prefix
    state = state.select("*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for bits in range(STEP, BITS + 1, STEP):
        inside = sized.join(state.select("source", "prefix").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", BITS - bits + STEP) == F.col("prefix")))
        sums = inside.groupBy("source", F.shiftright("hash", BITS - bits).alias("bucket")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("size").over(run))
        s = state.select(F.col("source").alias("s"), "budget", "below")
        met = sums.join(s, F.col("source").eqNullSafe(F.col("s"))).where(F.col("below") + F.col("upto") > F.col("budget"))
        met = met.groupBy("source").agg(F.min_by(F.struct("bucket", "size", (F.col("below") + F.col("upto") - F.col("size")).alias("below")), "bucket").alias("at"))
        met = met.select(F.col("source").alias("m"), "at")
        last = F.lit((1 << bits) - 1).cast("long")
        state = state.join(met, F.col("source").eqNullSafe(F.col("m")), "left").select(
            "source", "source_size", "target", "whole", "budget",
            F.coalesce("at.bucket", last).alias("prefix"), F.coalesce("at.below", "below").alias("below"), F.coalesce("at.size", F.lit(0)).alias("edge"),
        )
        state = stage(state, "level").select("*") if bits < BITS else state
    near = F.col("below") + F.col("edge") - F.col("budget") <= F.col("budget") - F.col("below")
    return state.select("source", "source_size", "target", "whole", (F.col("prefix") + F.when(near, 1).otherwise(0)).alias("bound"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of ``docs`` (doc_id, text, source); the rows are those of ``docs``.

    Null text: size 0. Null source: one source, the last. Rows that share doc_id and text share a hash, and are in or out together.
    A source without words has target 0. An empty table gives no rows. The crossing document is in where that is nearer.
    """
    sized, marks = _marked(docs)
    return sized.join(marks, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + (F.col("hash") < F.col("bound")).cast("long"))).alias("taken")
    )


def _marked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = spread(docs, ["doc_id", "text", "source"])
    sized = stage(docs.select("doc_id", "source", words(F.col("text")).alias("size"), unit_hash(F.col("doc_id"), F.col("text")).alias("hash")), "sized")
    targets = stage(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    return sized, stage(thresholds(sized, targets), "thresholds").withColumnRenamed("source", "s")


#: Most sources whose thresholds are sent to every task; more of them are joined.
BROADCAST_SOURCES = 100_000


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it; texts without words are never taken."""
    _, marks = _marked(docs)
    marks = marks.select(F.col("s").alias("__s"), F.col("whole").alias("__whole"), F.col("bound").alias("__bound"))
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_SOURCES else marks
    times = F.when(words(F.col("text")) > 0, F.col("__whole") + (unit_hash(F.col("doc_id"), F.col("text")) < F.col("__bound")).cast("long")).otherwise(0)
    taken = docs.join(marks, F.col("source").eqNullSafe(F.col("__s"))).withColumn("__times", times).where("__times > 0")
    return taken.withColumn("__one", F.explode(F.array_repeat(F.lit(1), F.col("__times").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("source")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT::DOUBLE
     - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT::DOUBLE)
     / (sum(w) OVER (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT::DOUBLE AS lv
  FROM s),
m AS (SELECT max(lv) FILTER (lv * w <= 2.0::DOUBLE * source_size) AS lv FROM l),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(m.lv * w, 2.0::DOUBLE * source_size)) AS target FROM l, m),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS whole FROM t),
g AS (
  SELECT d.source, d.h, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY d.h)::BIGINT AS upto, sum(size)::BIGINT AS edge
  FROM d GROUP BY d.source, d.h),
c AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, g.upto, g.edge, b.target - b.whole * b.source_size AS budget
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.h = g.h)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN upto <= budget OR (upto - edge <= budget AND upto - budget <= budget - (upto - edge)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
