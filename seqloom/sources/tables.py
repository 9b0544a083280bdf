"""Readers of the small tables that operators take: patterns, key-values, features, regions, indexes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.schema import INDEX


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """pattern: one per line, blank lines left out."""
    return spark.read.text(path).select(F.regexp_replace("value", r"\r\z", "").alias("pattern")).where("pattern <> ''")


def read_key_values(spark: SparkSession, path: str, lower_keys: bool = False) -> DataFrame:
    """k, v: the first two tab-separated fields; the last line of a key wins."""
    rows = spark.read.text(path).withColumn("__at", F.monotonically_increasing_id())
    parts = F.split(F.regexp_replace("value", r"\r\z", ""), "\t", -1)
    rows = rows.where(F.size(parts) >= 2).select((F.lower(parts[0]) if lower_keys else parts[0]).alias("k"), parts[1].alias("v"), "__at")
    return rows.groupBy("k").agg(F.max_by("v", "__at").alias("v"))


def read_bed(spark: SparkSession, path: str, chrs: list[str] | None = None) -> DataFrame:
    """chr, s (from 1), e (inclusive), feat, strand. Comments, browser and track lines and short lines are skipped; bad limits or strands are errors."""
    line = F.regexp_replace("value", r"\r\z", "")
    parts = F.split(line, "\t", -1)
    rows = spark.read.text(path).where(~line.rlike("^(#|browser|track)")).where(F.size(parts) >= 3)
    part = lambda i: F.try_element_at(parts, F.lit(i))
    strand = F.nullif(part(6), F.lit(""))
    bad = lambda text: F.raise_error(F.concat(F.lit(text), F.col("value")))
    begin, end = part(2).cast("long"), part(3).cast("long")
    rows = rows.select(
        part(1).alias("chr"),
        F.when(begin < end, begin + 1).otherwise(bad("bad limits: ").cast("long")).alias("s"),
        end.alias("e"),
        F.nullif(part(4), F.lit("")).alias("feat"),
        F.when(strand.isNull() | strand.isin("+", "-", "."), strand).otherwise(bad("bad strand: ").cast("string")).alias("strand"),
    )
    return rows.where(F.lower("chr").isin([c.lower() for c in chrs])) if chrs else rows


def read_gtf(spark: SparkSession, path: str, chrs: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """chr, s, e, strand, type, attributes (map of the ninth column)."""
    parts = F.split(F.regexp_replace("value", r"\r\z", ""), "\t", -1)
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.size(parts) >= 9)
    pairs = F.transform(F.regexp_extract_all(parts[8], F.lit(r'([^;\s]+\s+"[^"]*"|[^;\s]+\s+[^;"\s]+)'), F.lit(1)), lambda p: F.struct(F.regexp_extract(p, r"\A(\S+)", 1).alias("k"), F.regexp_replace(F.regexp_replace(p, r"\A\S+\s+", ""), '"', "").alias("v")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    rows = rows.select(parts[0].alias("chr"), parts[3].cast("long").alias("s"), parts[4].cast("long").alias("e"), F.when(parts[6].isin("+", "-"), parts[6]).alias("strand"), parts[2].alias("type"), F.map_from_entries(first).alias("attributes"))
    if chrs:
        rows = rows.where(F.lower("chr").isin([c.lower() for c in chrs]))
    return rows.where(F.lower("type").isin([t.lower() for t in types])) if types else rows


def parse_region(region: str) -> tuple[str, int, int]:
    """`id:b-e`, `id:b`, `id:b-`, `id:-e` or `id`."""
    for pattern, limits in ((r"(.+?):(-?\d+)-(-?\d+)", lambda m: (int(m[2]), int(m[3]))), (r"(.+?):(\d+)", lambda m: (int(m[2]), int(m[2]))), (r"(.+?):(-?\d+)-", lambda m: (int(m[2]), -1)), (r"(.+?):-(-?\d+)", lambda m: (1, int(m[2])))):
        if found := re.fullmatch(pattern, region):
            return found[1], *limits(found)
    return region, 1, -1


def read_regions(spark: SparkSession, path: str) -> list[str]:
    """One region per line; blank lines are skipped."""
    return [r.pattern.strip() for r in read_patterns(spark, path).collect()]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=INDEX)
