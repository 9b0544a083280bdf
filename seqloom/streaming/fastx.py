"""FASTA folders as unbounded tables; narrow operators (seq, grep, locate, translate, subseq) apply as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.sequence import parse_header
from seqloom.operators.keys import record_key


def stream_fasta(spark: SparkSession, folder: str, id_regexp: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """source, arrived, id, name, descr, seq, qual of every record of every file that arrives. A stream has no ordinals."""
    reader = spark.readStream.format("text").option("lineSep", "\n>").schema("value string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.load(folder).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_modification_time").alias("arrived"))
    rows = rows.where(F.trim(F.regexp_replace("value", r"[\r\n]+", " ")) != "").withColumn("value", F.regexp_replace("value", r"\A[\r\n]*>", ""))
    name = F.regexp_replace(F.substring_index("value", "\n", 1), r"\r\z", "")
    body = F.when(F.instr("value", "\n") > 0, F.regexp_replace("value", r"\A[^\n]*\n", "")).otherwise(F.lit(""))
    rows = rows.select("source", "arrived", name.alias("name"), F.regexp_replace(body, r"[\r\n]", "").alias("seq"))
    id_col, descr = parse_header(F.col("name"), id_regexp)
    return rows.select("source", "arrived", id_col.alias("id"), "name", descr.alias("descr"), "seq", F.lit(None).cast("string").alias("qual"))


def dedup_stream(records: DataFrame, by: str = "seq", keep: str = "1 day", ignore_case: bool = False, both_strands: bool = True) -> DataFrame:
    """The first record of each key that arrives; keys are forgotten `keep` after the watermark passes them, which bounds the state."""
    key = F.xxhash64(record_key(by, ignore_case, both_strands))
    return records.withWatermark("arrived", keep).withColumn("__key", key).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
