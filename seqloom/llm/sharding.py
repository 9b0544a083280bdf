"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import KeySet, checkpointed, prefix_sums, text_or_empty


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 64 << 20, least_buckets: int = 1024) -> DataFrame:
    """Puts all rows into shards 0 to n_shards - 1 in a random order; counts differ by one at most (law `rows`).

    First pass: each record goes to a bucket by a seeded hash, with enough buckets that one fits in memory. Second pass:
    each bucket is put in the order of a second hash and then shuffled by Fisher-Yates (Spark's `shuffle` of an array, with
    the seed). Buckets in turn make one random order of all records, which is cut into shards of equal counts. Buckets and
    partitions follow from the rows alone, so reruns agree whatever the session's settings or the input's partitions.

    Returns the input's columns plus shard and slot (gapless from 0 in each shard); input columns with these names are
    replaced. Rows equal in id and text are counted first and numbered, and the numbers scatter them over all buckets; such rows
    must have columns that Spark can group by. Null ids and texts are hashed like values. An empty table gives an empty table.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    kept = [c for c in docs.columns if c not in {"shard", "slot"}]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("__own"), F.octet_length(text_or_empty(text_col)).alias("__bytes"))
    owners = rows.groupBy("__own").agg(F.count("*").alias("n"), F.sum(F.col("__bytes") + 16).alias("b"))
    total = owners.agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("n").alias("most")).first()
    n, size = total["n"] or 0, total["b"] or 0
    rows = rows.drop("__bytes").withColumn("__copy", F.lit(0).cast("long"))
    if (total["most"] or 0) > 1:
        again = KeySet(checkpointed(owners.where("n > 1").select("__own")))
        marked = again.marked(rows, F.col("__own"), "__again")
        once = marked.where("not __again").drop("__again")
        # equal rows meet in one count, which is dealt out again by number
        counted = marked.where("__again").groupBy(*[c for c in rows.columns if c != "__copy"]).agg(F.count("*").alias("__times"))
        numbered = counted.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
        rows = once.unionByName(numbered.select(*rows.columns))

    buckets = max(least_buckets, -(-size // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "__own", "__copy"), F.lit(buckets))
    record = F.struct(F.xxhash64(F.lit(seed + 1), "__own", "__copy").alias("h"), F.struct(*[F.col(f"c{i}") for i in range(len(kept))]).alias("r"))
    counts = rows.groupBy(bucket.alias("__bucket")).agg(F.count("*").alias("__n"))
    offsets = prefix_sums(counts, [], "__bucket", "__n", "__first").select("__bucket", "__first")
    if buckets <= 1 << 18:  # at most 4 MB
        offsets = F.broadcast(offsets)

    parts = max(1, -(-size // bucket_bytes), min(256, -(-size // (4 << 20))))
    scattered = rows.select(bucket.alias("__bucket"), record.alias("__rec")).repartition(parts, "__bucket").sortWithinPartitions("__bucket", "__rec.h")
    by_hash = lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)
    grouped = scattered.groupBy("__bucket").agg(F.array_sort(F.collect_list("__rec"), by_hash).alias("__recs"))
    shuffled = grouped.select("__bucket", F.posexplode(F.shuffle("__recs", seed)).alias("__pos", "__rec"))
    placed = shuffled.join(offsets, "__bucket")
    rank = F.col("__first") + F.col("__pos")
    first = F.call_function("div", F.col("shard").cast("long") * n + (n_shards - 1), F.lit(n_shards))
    return (
        placed.withColumn("shard", F.call_function("div", rank * n_shards, F.lit(max(n, 1))).cast("int"))
        .select(*[F.col(f"__rec.r.c{i}").alias(c) for i, c in enumerate(kept)], "shard", (rank - first).cast("long").alias("slot"))
    )


def write_shards(sharded: DataFrame, path: str, partitions: int | None = None) -> None:
    """One folder per shard, its records in slot order, files in the order of their names.

    Rows are dealt by ranges of (shard, slot) over `partitions` tasks (the session's shuffle partitions by default), so a shard is as
    many files as its size needs. Nulls in any column are written as they are; an empty table gives a folder without rows.
    """
    n = partitions or int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sharded.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.mode("overwrite").partitionBy("shard").parquet(path)
