"""Exact deduplication by progressive refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import SPACES, KeySet, Scratch, checkpointed, text_or_empty


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text_col), SPACES, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix_chars: int = 256) -> DataFrame:
    """Groups documents whose texts are equal once each run of white space is one space.

    Rows are told apart by length, then by the hash of a prefix, then by SHA-256 of the whole text. The first pass counts
    lengths and prefixes; the second hashes the whole text of rows that still have a possible partner only. Those are known
    by a bit set that follows the number of groups (by a join where it would be too large), so texts are not shuffled
    for it; false alarms cost a hash, not a wrong group.

    Returns one row per input row: `id_col`, the columns in `carry`, keep_id (smallest id of the group), group_size, kept.
    A null text counts as empty. Rows that repeat an id are all kept if that id stays. Null ids lose to any other;
    a group with null ids alone has keep_id null and keeps all its rows, for they cannot be told apart. A column in
    `carry` that has the name of an output column is not returned. An empty table gives an empty result.
    """
    carried = [c for c in carry if c not in {id_col, "keep_id", "group_size", "kept"}]
    rows = docs.select(F.col(id_col).alias("__id"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carried)], normalised(text_col).alias("__norm"))
    length, prefix = F.octet_length("__norm").cast("long").alias("__len"), F.xxhash64(F.substring("__norm", 1, prefix_chars)).alias("__prefix")
    with Scratch(docs.sparkSession) as scratch:
        groups = rows.select(length, prefix).groupBy("__len", "__prefix").agg(F.count("*").alias("n")).where("n > 1")
        shared = KeySet(scratch.keep(groups.select(F.xxhash64("__len", "__prefix").alias("k"))))
        marked = shared.marked(rows, F.xxhash64(length, prefix), "__open")
        narrow = scratch.keep(marked.withColumn("__full", F.when(F.col("__open"), F.sha2("__norm", 256))).drop("__norm", "__open"))
        hashed = narrow.where(F.col("__full").isNotNull())
        # written, so that both sides of the join are plain exchanges and a hot group can be split
        groups = scratch.keep(hashed.groupBy("__full").agg(F.min("__id").alias("__keep"), F.count("*").alias("__size")).where("__size > 1"))
        found = hashed.join(groups, "__full", "left")
        alone = narrow.where(F.col("__full").isNull()).withColumns({"__keep": F.lit(None).cast(narrow.schema["__id"].dataType), "__size": F.lit(None).cast("long")})
        keep = F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep"))
        return checkpointed(
            found.unionByName(alone).select(
                F.col("__id").alias(id_col),
                *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carried)],
                keep.alias("keep_id"),
                F.coalesce("__size", F.lit(1).cast("long")).alias("group_size"),
                F.col("__id").eqNullSafe(keep).alias("kept"),
            )
        )
