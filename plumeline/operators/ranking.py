"""Places in an order, over listings of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import written

_PLACE_BITS = 33  # of monotonically_increasing_id that count a partition's rows


def ranked(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``rows`` with their place, from 1, in an order that tells all rows apart.

    Rows are dealt by ranges of the order and sorted in each range; a row's place is that in its range plus the sizes of
    the ranges before. Only those sizes, a number for each range, meet in one place. The dealt rows are written once, as
    ranges are drawn by samples and a second look would draw others.
    """
    part, at = F.shiftright("__at", _PLACE_BITS), F.col("__at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each range
    before, total = [], 0
    for row in sorted(sizes, key=lambda r: r["__part"]):
        before.append((row["__part"], total))
        total += row["n"]
    offsets = rows.sparkSession.createDataFrame(before, "__part long, __before long")
    placed = dealt.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.withColumn(name, (F.col("__before") + at).cast("long")).drop("__part", "__at", "__before")


def ranked_few(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """The same for listings that are short by what they list, such as registered sources and their categories: one window."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
