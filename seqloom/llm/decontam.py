"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import BLANKS, SPACES, KeySet, Scratch, checkpointed, fence, let, quick_key, without


def word_hashes(text: Column) -> Column:
    """Hashes of the words, lower-cased; empty for null and for blank texts."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(t, SPACES), lambda w: F.xxhash64(w))))


def runs(hashes: Column, words: int) -> Column:
    """Distinct hashes of all runs of `words` word hashes; the run's length goes into the hash."""
    starts = F.when(F.size(hashes) >= words, F.sequence(F.lit(1), F.size(hashes) - (words - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.lit(words), *[F.element_at(hashes, i + k) for k in range(words)])))


def _item_shingles(items: DataFrame, item_col: str, text_col: str, words: int) -> DataFrame:
    """__item, __h: an item's shingles; an item of fewer words has its whole sequence as its only one."""
    rows = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("__item"), word_hashes(F.col(text_col).cast("string")).alias("__ws"))
    shingles = runs(F.col("__ws"), words)
    for n in range(1, words):
        shingles = F.when(F.size("__ws") == n, runs(F.col("__ws"), n)).otherwise(shingles)
    return rows.select("__item", F.explode(shingles).alias("__h"), F.least(F.size("__ws"), F.lit(words)).alias("__length")).distinct()


def _found(docs: DataFrame, key: Column, items: DataFrame, item_col: str, item_text_col: str, words: int, at_least: float, scratch: Scratch) -> DataFrame:
    """docs: __text, and what the key is made of. Returns __doc (the key), __item, __n, __shared of all pairs with the wanted containment."""
    rows = scratch.keep(_item_shingles(items, item_col, item_text_col, words))
    sizes = rows.groupBy("__item").agg(F.count("__h").alias("__n"))
    class_end = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin("__n"))) - 1
    missing = F.floor(class_end * F.lit(1.0 - at_least) + 1e-9)
    rank = F.row_number().over(Window.partitionBy("__item").orderBy("__h"))
    sketch = scratch.keep(rows.withColumn("__rank", rank).join(sizes, "__item").where(F.col("__rank") <= missing + 1).select("__item", "__h"))
    whole = scratch.keep(rows.groupBy("__item").agg(F.collect_list("__h").alias("__of_item")))
    lengths = sorted(r[0] for r in rows.select("__length").distinct().collect())  # 1 to `words`

    # a document has many shingles, so one foreign hash in ten is too many here
    known = KeySet(scratch.keep(sketch.select("__h").distinct()), bits_a_key=256)
    all_runs = lambda ws: runs(ws, lengths[0]) if len(lengths) == 1 else F.flatten(F.array(F.array().cast("array<bigint>"), *[runs(ws, n) for n in lengths]))
    hashes = fence(let(word_hashes(F.col("__text")), all_runs)).alias("__all")
    hits = docs.select(key.alias("__doc"), hashes).select("__doc", F.explode("__all").alias("__h"))
    if known.bits is not None:  # tested on exploded rows, in generated code, so that the set is not copied for each document
        hits = hits.where(known.test(F.col("__h")))
    pairs = scratch.keep(hits.join(sketch, "__h").select("__doc", "__item").distinct())

    # full shingles of candidate pairs only
    open_docs = KeySet(scratch.keep(pairs.select(F.xxhash64("__doc").alias("h")).distinct()))
    texts = open_docs.filtered(docs.withColumn("__doc", key), F.xxhash64("__doc")).select("__doc", hashes)
    judged = pairs.join(whole, "__item").withColumn("__n", F.size("__of_item").cast("long"))
    judged = judged.join(texts, "__doc").select("__doc", "__item", "__n", F.explode(F.array_intersect("__all", "__of_item")).alias("__h"))
    shared = judged.groupBy("__doc", "__item", "__n").agg(F.count_distinct("__h").alias("__shared"))
    return shared.where(F.col("__shared") / F.col("__n") >= at_least)


def find_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = 5, at_least: float = 0.8) -> DataFrame:
    """Pairs (id_col, item_col) where the document holds at least `at_least` of the item's distinct `words`-word shingles.

    Items are partitioned by size, each class twice as wide as the one before. An item's MinHash sketch is its k smallest
    shingle hashes. A document with the wanted containment lacks at most (1 - at_least) of the item's shingles, so
    with k one above that share of the class's largest size it holds one of the sketch: the search misses nothing.
    Only sketch hashes are searched for. Documents that hold one are candidates for its items, and only candidate pairs are
    verified, on the exact number of shingles that they share.

    Returns id_col, item_col, n_shared, n_item, containment. Case and white space don't count. An item of fewer than `words`
    words is one shingle of that length, and is found where a document holds this run of words. Null and empty texts match
    nothing. Rows that repeat an id are one document, and items that repeat an id one item (their shingles together); null ids
    never match. Empty tables give an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where("__id is not null")
        found = _found(rows, F.col("__id"), items, item_col, item_text_col, words, at_least, scratch)
        return checkpointed(
            found.select(
                F.col("__doc").alias(id_col), F.col("__item").alias(item_col), F.col("__shared").alias("n_shared"), F.col("__n").alias("n_item"), (F.col("__shared") / F.col("__n")).alias("containment")
            )
        )


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = 5, at_least: float = 0.8) -> DataFrame:
    """The documents whose text holds no item (see find_contaminated()); each row is judged by its own text, whatever its id.

    Columns come back as they are, whatever their names. Only rows that a bit set takes for such that go are shuffled.
    """
    text = F.col(text_col).cast("string").alias("__text")
    with Scratch(docs.sparkSession) as scratch:
        bad = checkpointed(_found(docs.select(text), quick_key(F.col("__text")), items, item_col, item_text_col, words, at_least, scratch).select(F.col("__doc").alias("__key_of_text")).distinct())
    columns = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, columns)], quick_key(text).alias("__key_of_text"))
    return without(named, "__key_of_text", bad).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, columns)])
