"""Order, limits, sampling and union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import codes
from seqloom.functions import sequence as S


def sort_key(by: str = "id", natural: bool = False, ignore_case: bool = False, prefix: int = 10_000, gap_letters: str = codes.GAPS) -> Column:
    if by == "length":
        return F.length("seq")
    if by == "bases":
        return F.length(F.translate("seq", gap_letters, ""))
    if by not in ("id", "name", "seq"):
        raise ValueError("by is id, name, seq, length or bases")
    key = F.lower(by) if ignore_case else F.col(by)
    if by == "seq":
        return F.substring(key, 1, prefix) if prefix else key
    return S.natural_key(key) if natural else key


def sort(df: DataFrame, *, by: str = "id", natural: bool = False, reverse: bool = False, ignore_case: bool = False, prefix: int = 10_000, gap_letters: str = codes.GAPS) -> DataFrame:
    """Records in order, ties by ordinal. The range partitioning of a global sort: no task holds more than its range."""
    if natural and by not in ("id", "name"):
        raise ValueError("natural order is for ids and names")
    key = sort_key(by, natural, ignore_case, prefix, gap_letters)
    return df.orderBy(key.desc() if reverse else key.asc(), "ordinal")


def head(df: DataFrame, n: int = 10) -> DataFrame:
    if n < 1:
        raise ValueError("n must be at least 1")
    return df.orderBy("ordinal").limit(n)


def record_range(df: DataFrame, span: str) -> DataFrame:
    """Records `a:b`, from 1, negative from the end. Ordinals are dense, so no sort is needed; a negative limit costs one count, as a joined aggregate."""
    start, end = S.parse_span(span)
    if (start > 0) == (end > 0) and start > end:
        raise ValueError("start must not be above end")
    place = F.col("ordinal") + 1
    if start > 0 and end > 0:
        return df.where((place >= start) & (place <= end))
    total = df.agg((F.max("ordinal") + 1).alias("__all"))
    begin, stop = S.sub_location(F.col("__all"), start, end)
    return df.join(total).where((place >= begin) & (place <= stop)).drop("__all")


def head_genome(df: DataFrame, min_words: int = 1) -> DataFrame:
    """The first record and those behind it that share as many leading description words with it as the second does, at least min_words; ends at the first that doesn't."""
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    first = df.agg(F.min_by("descr", "ordinal").alias("__first"), F.min("ordinal").alias("__least"))
    descr = F.when(F.col("descr") == "", F.raise_error(F.concat(F.lit("a record without description: "), F.col("id"))).cast("string")).otherwise(F.col("descr"))
    rows = df.join(first).withColumn("__shared", S.shared_words(descr, F.col("__first")))
    second = rows.where("ordinal > __least").agg(F.min_by("__shared", "ordinal").alias("__second"))
    rows = rows.join(second, how="left")
    wrong = (F.col("ordinal") > F.col("__least")) & ((F.col("__shared") < min_words) | (F.col("__shared") != F.col("__second")))
    stop = rows.where(wrong).agg(F.min("ordinal").alias("__stop"))
    return rows.join(stop).where(F.col("__stop").isNull() | (F.col("ordinal") < F.col("__stop"))).select(*df.columns)


def hash_place(seed: int) -> Column:
    """A number from 0 to 1 that seed and ordinal decide, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("ordinal").cast("string"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def sample(df: DataFrame, *, proportion: float | None = None, number: int | None = None, seed: int = 11) -> DataFrame:
    """Records whose hash place is below the proportion: the same whatever the partitioning. `number` gives about that many."""
    if (proportion is None) == (number is None):
        raise ValueError("one of proportion and number is needed")
    if proportion is not None:
        if not 0 < proportion <= 1:
            raise ValueError("proportion is above 0 and at most 1")
        return df.where(hash_place(seed) < proportion)
    if number < 1:
        raise ValueError("number must be at least 1")
    total = df.agg(F.count("*").alias("__all"))
    return df.join(total).where(hash_place(seed) < F.lit(float(number)) / F.col("__all")).drop("__all")


def shuffle(df: DataFrame, seed: int = 23) -> DataFrame:
    return df.orderBy(hash_place(seed), "ordinal")


def union(*inputs: DataFrame, ordered: bool = False) -> DataFrame:
    """All records. ordered: ordinals follow on from one input to the next."""
    if not ordered:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)
    sizes = reduce(DataFrame.unionAll, [df.agg(F.lit(i).alias("__input"), F.coalesce(F.max("ordinal") + 1, F.lit(0)).alias("__size")) for i, df in enumerate(inputs)])
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__input").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__input", before.alias("__before"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("__input", F.lit(i)) for i, df in enumerate(inputs)])
    return rows.join(sizes, "__input").withColumn("ordinal", F.col("ordinal") + F.col("__before")).drop("__input", "__before")


def with_rank(df: DataFrame, out: str = "rank") -> DataFrame:
    """Numbers the rows of a sorted DataFrame from 1, partition by partition; no task sees all rows.

    The sorted rows are cached, for both uses must see the same partitions; unpersist them through spark.catalog.clearCache().
    """
    rows = df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()).persist()
    parts = rows.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__p", "__first", before.alias("__before"))
    return rows.join(parts, "__p").withColumn(out, F.col("__before") + F.col("__m") - F.col("__first") + 1).drop("__p", "__m", "__n", "__first", "__before")
