"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import checkpointed, count_words, row_key


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: source, source_size. Adds weight and target.

    Sources in code point order, null last, get the weights in turn. The targets add up to `share` of all sizes; none is
    above `most` times its source's size, and what a source cannot take goes to the others by weight. That is the level
    at which capped and uncapped targets fill the total, found from prefix sums over sources ordered by cap / weight.
    One row per source: sources are names of collections, and their table is taken to fit one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0))
    weights_left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("__level", left / weights_left).withColumn("__open", F.col("__level") * F.col("weight") <= F.col("__cap"))
    level = F.first(F.when(F.col("__open"), F.col("__level")), True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("__cap"), F.coalesce(level * F.col("weight"), F.col("__cap")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def size_bin(size: Column) -> Column:
    """A code that grows with the size: exact below 32, then 16 steps for each doubling."""
    bits = F.length(F.bin(size))
    top = F.call_function("shiftright", size, F.greatest(bits - 5, F.lit(0)))
    return F.when(size < 32, size).otherwise((bits - 5) * 32 + top)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, slice_digits: int = 2) -> DataFrame:
    """How often each document goes into the mix.

    Within a source every document's expected copies are target / source_size. They are prefix-summed over the
    documents in order of size, then of a hash; one random offset per source is added; a document is emitted once per
    whole number that its part of the sum crosses. Ordering by size keeps the words taken within about one
    document of the target. All documents of a source expect the same, so the prefix sum is the rank times that number;
    the rank comes from counts over (size bin, hash slice) and a row number within each, so no task holds a source. The hash
    is of id and text, so rows that share an id, or have none, are spread like others. Whole rows are shuffled once.
    `slice_digits` hex digits cut each bin: 256 slices by default, of 4 M rows each at 10**9 rows a bin.

    Returns the input's columns plus size (words; null text: 0), source_size, target and copies; input columns with
    these names are replaced. An empty table gives an empty table. Null sources are one source. Rows that agree in id and
    text share a slice and get their copies in any order among themselves. Sources without words have rate 0 and give nothing.
    """
    kept = [c for c in docs.columns if c not in {"size", "source_size", "target", "copies"}]
    rows = docs.select(
        *[F.col(c).alias(f"__c{i}") for i, c in enumerate(kept)],
        F.col(source_col).cast("string").alias("source"),
        count_words(F.col(text_col)).alias("size"),
        row_key(F.col(id_col), F.col(text_col)).alias("__hash"),
    )
    rows = rows.withColumn("__bin", size_bin(F.col("size"))).withColumn("__slice", F.substring("__hash", 1, slice_digits))
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    # one column names a cell, so that the window and the join share an exchange
    rows = rows.withColumn("__cell", F.concat_ws("/", F.col("__bin").cast("string"), "__slice", named))
    # one narrow table of counts serves both the sources' sizes and the ranks
    counts = checkpointed(rows.groupBy("__cell", "source", "__bin", "__slice").agg(F.count("*").alias("__n"), F.sum("size").alias("__words")))
    sizes = counts.groupBy("source").agg(F.sum("__words").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "__of")
    bins = counts.groupBy("source", "__bin").agg(F.sum("__n").alias("__n"))
    before_bin = Window.partitionBy("source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("source").alias("__of"), F.col("__bin").alias("__of_bin"), F.coalesce(F.sum("__n").over(before_bin), F.lit(0)).alias("__before_bin"))
    before = Window.partitionBy("source", "__bin").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\x00null"))))
    starts = counts.select("__cell", "source", "__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    starts = starts.join(bins, F.col("source").eqNullSafe(F.col("__of")) & (F.col("__bin") == F.col("__of_bin"))).drop("__of", "__of_bin")
    starts = starts.join(targets, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    starts = starts.select("__cell", "source_size", "target", (F.col("__before_bin") + F.col("__before")).alias("__first"), (F.conv(F.substring(offset, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)).alias("__offset"))
    ranked = rows.drop("source", "__bin", "__slice").withColumn("__row", F.row_number().over(Window.partitionBy("__cell").orderBy("size", "__hash")))
    out = ranked.join(starts, "__cell")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("__first") + F.col("__row")
    copies = F.floor(F.col("__offset") + rate * rank) - F.floor(F.col("__offset") + rate * (rank - 1))
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)], "size", "source_size", "target", copies.cast("long").alias("copies"))


def emit(mixed: DataFrame, copy_col: str = "copy") -> DataFrame:
    """The mix itself: each row of mix() as often as its copies say, numbered from 0 in `copy_col`."""
    rows = mixed.where(F.col("copies") > 0).drop(copy_col)
    return rows.withColumn(copy_col, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
