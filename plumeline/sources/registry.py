"""The registry of feeds, and the shelves, as tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Required texts, in the order in which they are checked.
TEXTS = ("id", "name", "category", "feedUrl", "siteUrl", "language")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TEXTS] + [T.StructField("enabled", T.BooleanType()), T.StructField("pos", T.LongType())])


class RegistryError(ValueError):
    """A registry that breaks its contract."""


def check_entries(entries: object) -> list[dict]:
    """The entries with their places; raises RegistryError at the first fault, in order of entries and fields."""
    if not isinstance(entries, list):
        raise RegistryError("the registry must be an array")
    for i, entry in enumerate(entries):
        if not isinstance(entry, dict):
            raise RegistryError(f"entry {i} is not an object")
        for field in TEXTS:
            if not isinstance(entry.get(field), str) or not entry[field].strip():
                raise RegistryError(f"entry {i}: {field} must be a text that is not blank")
        if not isinstance(entry.get("enabled"), bool):
            raise RegistryError(f"entry {i}: enabled must be true or false")
    return [{**{f: e[f] for f in TEXTS}, "enabled": e["enabled"], "pos": i} for i, e in enumerate(entries)]


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry file, read by Spark from any store; it is a short, hand-kept JSON array and checked on the driver."""
    return spark.createDataFrame([tuple(e[f.name] for f in SCHEMA) for e in check_entries(json.loads(_read_text(spark, path)))], SCHEMA).transform(snake)


def snake(registry: DataFrame) -> DataFrame:
    return registry.withColumnsRenamed({"feedUrl": "feed_url", "siteUrl": "site_url"})


def violations(registry: DataFrame) -> DataFrame:
    """(pos, field) of blank or missing fields of registry rows, for registries kept as tables."""
    fields = ["id", "name", "category", "feed_url", "site_url", "language"]
    faults = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(c, F.lit(""))) == "", c) for c in fields], F.when(F.col("enabled").isNull(), "enabled")))
    return registry.select("pos", F.explode(faults).alias("field"))


def last_of_each(registry: DataFrame) -> DataFrame:
    """Of entries that share an id, the last."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("pos")))
    return registry.withColumn("__n", place).where("__n = 1").drop("__n")


def enabled(registry: DataFrame) -> DataFrame:
    return registry.where("enabled")


def repeated_feed_urls(registry: DataFrame) -> DataFrame:
    return registry.groupBy("feed_url").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def parse_shelves(text: str) -> tuple[dict, list[dict]]:
    """The site's texts and the shelves of a shelves file: two-level YAML of plain scalars, which is all that it may hold."""
    site, shelves, part = {}, [], None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := re.match(r"^(site|shelves):\s*$", line):
            part = m[1]
        elif part and (m := re.match(r"^\s+(-\s+)?(\w+):\s*(.*)$", line)):
            value = m[3].strip()
            value = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
            if part == "shelves" and m[1]:
                shelves.append({})
            if part == "shelves" and not shelves:
                raise RegistryError(f"not a list of shelves: {line!r}")
            (site if part == "site" else shelves[-1])[m[2]] = value
        else:
            raise RegistryError(f"not understood: {line!r}")
    return site, shelves


def read_shelves(spark: SparkSession, path: str) -> DataFrame:
    """(shelf_ord, id, title, description)."""
    _, shelves = parse_shelves(_read_text(spark, path))
    return spark.createDataFrame([(i, s.get("id"), s.get("title"), s.get("description")) for i, s in enumerate(shelves)], "shelf_ord long, id string, title string, description string")
