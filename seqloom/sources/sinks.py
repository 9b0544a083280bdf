"""Writers. Formatting happens here only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.sequence import wrap


def fastx_text(width: int = 60) -> Column:
    """A record as text, without the last line end: FASTA wrapped at `width` (0: one line), FASTQ never wrapped."""
    fasta = F.concat(F.lit(">"), F.col("name"), F.lit("\n"), wrap(F.col("seq"), width))
    fastq = F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    return F.when(F.col("qual").isNull(), fasta).otherwise(fastq)


def bed_text() -> Column:
    return F.concat_ws("\t", "seq_id", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), "pattern_name", F.lit("0"), "strand")


def gtf_text(source: str = "seqloom") -> Column:
    return F.concat(F.concat_ws("\t", "seq_id", F.lit(source), F.lit("location"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("0"), "strand", F.lit("."), F.concat(F.lit('gene_id "'), "pattern_name", F.lit('"; '))))


def write_text(df: DataFrame, value: Column, path: str, order: str | None = "ordinal", merge: bool = False, partitions: int | None = None) -> None:
    """Lines in order over part files, or in one file with `merge`: tasks write parts all the same, whose bytes the driver joins as a stream."""
    rows = df.select(*([F.col(order).alias("__order")] if order else []), value.alias("value"))
    if order:
        rows = rows.repartitionByRange(partitions, "__order") if partitions and not merge else rows.repartitionByRange("__order")
        rows = rows.sortWithinPartitions("__order")
    elif partitions and not merge:
        rows = rows.repartition(partitions)
    if not merge:
        rows.select("value").write.mode("overwrite").text(path)
        return
    parts = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"
    try:
        rows.select("value").write.text(parts)
        _join_parts(df.sparkSession, parts, path)
    finally:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(parts)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def _join_parts(spark: SparkSession, parts: str, path: str) -> None:
    """One file with the bytes of all parts in the folder `path`; a part goes when it is copied, so bytes are on disk about once."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    place = lambda folder, name: hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    target = hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    names = sorted((n for f in fs.listStatus(hadoop.fs.Path(parts)) if (n := f.getPath().getName()).startswith("part-")), key=lambda n: (len(n), n))
    fs.delete(target, True)
    fs.mkdirs(target)
    out = fs.create(place(path, "_joined"), True)
    try:
        for name in names:
            part = fs.open(place(parts, name))
            try:
                hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
            fs.delete(place(parts, name), False)
    finally:
        out.close()
    fs.rename(place(path, "_joined"), place(path, names[0] if names else "part-00000.txt"))
    fs.create(place(path, "_SUCCESS"), True).close()


def write_fastx(df: DataFrame, path: str, width: int = 60, merge: bool = False, partitions: int | None = None) -> None:
    write_text(df, fastx_text(width), path, merge=merge, partitions=partitions)


def write_pairs(pairs: DataFrame, unpaired: DataFrame | None, folder: str, width: int = 60, force: bool = False) -> None:
    """paired.1, paired.2 and, if asked for, unpaired.1, unpaired.2."""
    mode = "overwrite" if force else "error"
    for i in (1, 2):
        rows = pairs.select("ordinal", f"r{i}.name", f"r{i}.seq", f"r{i}.qual").sort("ordinal")
        rows.select(fastx_text(width).alias("value")).write.mode(mode).text(f"{folder}/paired.{i}")
        if unpaired is not None:
            unpaired.where(F.col("side") == i).sort("ordinal").select(fastx_text(width).alias("value")).write.mode(mode).text(f"{folder}/unpaired.{i}")


def write_index(index: DataFrame, path: str) -> None:
    """Part files whose names follow the offsets."""
    index.repartitionByRange("offset").sortWithinPartitions("offset").write.mode("overwrite").csv(path, sep="\t")
