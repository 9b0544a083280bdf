"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# functions for Python workers travel with their code: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules["seqloom.llm"])

#: Fixed patterns: a run of ASCII white space, and a word.
SPACES = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fence(value: Column) -> Column:
    """The value itself, but neither copied into filters nor merged into other projections: for costly expressions."""
    return F.when(F.rand(0) >= 0, value)


def scratch_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. Only a local session without that setting gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="seqloom-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a result with a reliable checkpoint, which survives lost executors.

    Only what an operator returns is kept this way, since its caller may read it at any time; steps in between are in a Scratch.
    """
    scratch_folder(df.sparkSession)
    return df.checkpoint()


def hash_sample(rows: DataFrame, key: Column, most: int, seed: int, parts: int | None = None) -> DataFrame:
    """At most `most` rows, one for each of the smallest hashes of `key`, dealt over `parts` tasks; rows of equal keys count once.

    Only hashes are sorted, about twice as many as wanted, and rows are read again up to the last hash. All different rows where there are
    few. The rows of a key must agree in all columns that matter.
    """
    place = F.xxhash64(F.lit(seed), key)
    hashes = rows.select(place.alias("__place"))
    n = hashes.agg(F.approx_count_distinct("__place")).first()[0]
    if n > 3 * most:
        hashes = hashes.where(F.col("__place") < int(-(2**63) + 2**64 * 2 * most / n))
    last = hashes.distinct().orderBy("__place").limit(most).agg(F.max("__place")).first()[0]
    found = rows.withColumn("__place", place).where(F.col("__place") <= last if last is not None else F.lit(False))
    return found.repartition(parts or rows.sparkSession.sparkContext.defaultParallelism, "__place").dropDuplicates(["__place"]).drop("__place")


class Scratch:
    """Tables written to the shared scratch folder, gone when the block ends, also after an error.

    A reliable cut of the lineage like a checkpoint, but compressed, read back in few tasks where a table is small, and dropped
    when nothing needs it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{scratch_folder(spark)}/tables-{uuid.uuid4().hex}", 0
        self.kept: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((kept, path))
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Removes kept tables that nothing reads any more."""
        for kept, path in self.kept:
            if any(kept is t for t in tables):
                remove(self.spark, path)
        self.kept = [x for x in self.kept if not any(x[0] is t for t in tables)]

    def sweep(self) -> None:
        """Shuffle files of the steps behind us go when the driver's JVM sees that nothing refers to them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def __exit__(self, *_) -> None:
        self.kept.clear()
        remove(self.spark, self.folder)
        self.sweep()


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage, after which they return heap that they don't need to the system.

    For an application of several steps, before one: JVMs keep the heap of the largest step so far, and Python workers need theirs beside it.
    One task for each core reaches all executors where they are idle; one that is missed only keeps its heap.
    """
    n = spark.sparkContext.defaultParallelism
    collect = F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(collect.alias("collected")).write.format("noop").mode("overwrite").save()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sets the session to hand Python workers no more than this many rows at a time, unless it asks for fewer.

    For an application that reads lazy results with Python over long texts, such as the queries: what holds then counts. Operators don't
    change their caller's session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


@contextlib.contextmanager
def bound_batches(spark: SparkSession, rows: int = 1000):
    """Python workers and Arrow buffers hold a batch of whole texts: no more than this many rows for jobs of this block, unless the
    session asks for fewer. The session's own setting comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lean(function):
    """An Arrow function that gives its memory back to the system when its task ends, since Spark keeps the worker for other tasks."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def prefix_sums(df: DataFrame, group: list[str], order: str, amount: str, out: str, block: int = 4096) -> DataFrame:
    """Adds `out`: the sum of `amount` over smaller `order` (a long from 0) in the same group.

    Two levels, so that no window holds more than `block` rows of one group or one row per block.
    """
    keyed = df.withColumn("__block", F.floor(F.col(order) / block))
    totals = keyed.groupBy(*group, "__block").agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return (
        keyed.join(totals, [*group, "__block"])
        .withColumn(out, F.col("__before") + F.col("__inside"))
        .drop("__block", "__before", "__inside")
    )


#: A set of keys as bits takes so many bits a key, and so many in all at most (8 MB); larger sets are joined.
BITS_A_KEY, MOST_BITS = 10, 1 << 26


def bitset(keys: DataFrame, key: str, log2_words: int) -> Column:
    """A set of hashes as `2**log2_words` longs in one value. It may say yes to a key that is not in it, never no to one that is."""
    words = 1 << log2_words
    bit = F.pmod(F.col(key), F.lit(words * 64))
    marks = keys.select(
        F.shiftright(bit, 6).alias("__w"),
        F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("__b"),
    )
    empty = keys.sparkSession.range(words).select(F.col("id").alias("__w"), F.lit(0).cast("long").alias("__b"))
    dense = marks.unionByName(empty).groupBy("__w").agg(F.bit_or("__b").alias("__b"))
    pairs = F.array_sort(F.collect_list(F.struct("__w", "__b")))
    return dense.agg(F.transform(pairs, lambda x: x["__b"]).alias("bits")).scalar()


def in_bitset(bits: Column, hashed: Column, log2_words: int) -> Column:
    bit = F.pmod(hashed, F.lit(64 << log2_words))
    return F.getbit(F.element_at(bits, (F.shiftright(bit, 6) + 1).cast("int")), (bit % 64).cast("int")) == 1


class KeySet:
    """A table of hashes (one long column) that others are filtered by.

    Its bit set follows the number of keys: about one foreign key in `bits_a_key` passes, up to one in BITS_A_KEY where that takes more
    than `most_bits`. Beyond them no bit set is made, and filters are joins on the key. `keys` is a kept table: it is counted here
    and read again.
    """

    def __init__(self, keys: DataFrame, most_bits: int = MOST_BITS, bits_a_key: int = BITS_A_KEY):
        self.keys, self.name = keys, keys.columns[0]
        words = lambda bits: max(6, math.ceil(math.log2(max(self.n, 1) * bits / 64)))
        self.n = keys.count()
        fits = 64 << words(BITS_A_KEY) <= most_bits
        self.log2_words = min(words(bits_a_key), int(math.log2(most_bits // 64))) if fits else 0
        self.bits = bitset(keys, self.name, self.log2_words) if fits else None

    def test(self, hashed: Column) -> Column:
        """Whether the set may hold the hash, by its bits."""
        return in_bitset(self.bits, hashed, self.log2_words)

    def marked(self, rows: DataFrame, hashed: Column, out: str) -> DataFrame:
        """Adds `out`: whether the row's hash is in the set; by bits (which may say yes to others), or by a join."""
        if self.bits is not None:
            return rows.withColumn(out, self.test(hashed))
        known = self.keys.select(F.col(self.name).alias("__hash_of_key"), F.lit(True).alias("__known")).distinct()
        joined = rows.withColumn("__hash_of_row", hashed).join(known, F.col("__hash_of_row") == F.col("__hash_of_key"), "left")
        return joined.select(*rows.columns, F.col("__known").isNotNull().alias(out))

    def filtered(self, rows: DataFrame, hashed: Column) -> DataFrame:
        return self.marked(rows, hashed, "__in_set").where("__in_set").drop("__in_set")


def row_key(*columns: Column) -> Column:
    """128 bits that stand for the values of some columns, nulls told from values."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns)]
    return F.md5(F.concat(*parts))


def quick_key(*columns: Column) -> Column:
    """Like row_key(), of two fast 64-bit hashes."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(seed), *parts)) for seed in (1, 2)])


def without(rows: DataFrame, key: str, gone: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows whose `key` is not in `gone` (a kept table of that one column). Only rows that a bit set of its hashes lets
    through are joined with it, so the others are not shuffled."""
    held = KeySet(gone.select(F.xxhash64(key).alias("__h")), most_bits)
    if held.bits is None:
        return rows.join(gone, key, "left_anti")
    maybe = held.test(F.xxhash64(key))
    return rows.where(~maybe).unionByName(rows.where(maybe).join(gone, key, "left_anti").select(*rows.columns))


def shielded(docs: DataFrame, needed: tuple[str, ...], apply) -> DataFrame:
    """apply(docs), with the same columns in the end: all but the needed ones have names meanwhile that no operator uses."""
    held = {c: c if c in needed else f"__own{i}" for i, c in enumerate(docs.columns)}
    out = apply(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in held.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in held.items()])
