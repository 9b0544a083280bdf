"""FASTA and FASTQ files as record DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.sequence import parse_header

FASTA_ENDINGS = (".fa", ".fna", ".ffn", ".faa", ".frn", ".fasta")
FASTQ_ENDINGS = (".fq", ".fastq")
_ENDING = re.compile(r"\.(gz|bz2)$")


def _paths(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def read_list(spark: SparkSession, path: str) -> list[str]:
    """Paths in a list file, one per line; blank lines are skipped. A list of files is short by nature."""
    return [r.value.strip() for r in spark.read.text(path).where(F.trim("value") != "").collect()]


def _pieces(spark: SparkSession, paths: list[str], separator: str, blank: bool = False) -> DataFrame:
    """source, ordinal, value: the parts of the files between separators, numbered in input order; blank ones only if asked for.

    The number is dense: a count per file split, a prefix sum over the splits, and the place in the split.
    """
    read = None
    for i, p in enumerate(paths):
        one = spark.read.option("lineSep", separator).text(p).select("value", F.lit(i).alias("__input"), F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("__block"))
        read = one if read is None else read.unionAll(one)
    rows = read if blank else read.where(F.trim(F.regexp_replace("value", r"[\r\n]+", " ")) != "")
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    splits = rows.groupBy("__input", "source", "__block").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__input", "source", "__block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    rows = rows.join(splits, ["__input", "source", "__block"]).withColumn("__place", F.col("__at") - F.col("__first"))
    # counts and records come from two scans: if the second deals the splits to tasks in another way, say so
    moved = (F.col("__place") < 0) | (F.col("__place") >= F.col("__n"))
    place = F.when(moved, F.raise_error(F.lit("the files were split in another way when they were read again")).cast("long")).otherwise(F.col("__place"))
    return rows.select("source", (F.col("__before") + place).alias("ordinal"), "value")


def _records(rows: DataFrame, name: Column, seq: Column, qual: Column, id_regexp: str | None, ncbi: bool, raw: Column | None = None) -> DataFrame:
    rows = rows.withColumns({"__name": name, "__seq": seq, "__qual": qual})
    id_col, descr = parse_header(F.col("__name"), id_regexp, ncbi)
    columns = ["ordinal", "source", id_col.alias("id"), F.col("__name").alias("name"), descr.alias("descr"), F.col("__seq").alias("seq"), F.col("__qual").alias("qual")]
    return rows.select(*columns, *([] if raw is None else [raw.alias("raw")]))


def read_fasta(spark: SparkSession, path: str | list[str], id_regexp: str | None = None, ncbi: bool = False, min_partitions: int | None = None, with_raw: bool = False) -> DataFrame:
    """Records of FASTA files; sequences may span lines, a header alone is an empty sequence.

    with_raw adds `raw`, the record's text as in the file, which faidx_index needs.
    """
    rows = _pieces(spark, _paths(path), "\n>")
    rows = rows.withColumn("value", F.regexp_replace("value", r"\A[\r\n]*>", ""))
    name = F.regexp_replace(F.substring_index("value", "\n", 1), r"\r\z", "")
    body = F.when(F.instr("value", "\n") > 0, F.regexp_replace("value", r"\A[^\n]*\n", "")).otherwise(F.lit(""))
    seq = F.regexp_replace(body, r"[\r\n]", "")
    out = _records(rows, name, seq, F.lit(None).cast("string"), id_regexp, ncbi, F.concat(F.lit(">"), F.col("value")) if with_raw else None)
    return _at_least(out, min_partitions)


def _at_least(rows: DataFrame, partitions: int | None) -> DataFrame:
    """Not fewer partitions than asked for, nor than a shuffle of the session has, so that they don't grow with the input."""
    if not partitions:
        return rows
    return rows.repartitionByRange(max(partitions, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "ordinal")


def _checked(name: Column, seq: Column, qual: Column) -> Column:
    return F.when(F.length(seq) == F.length(qual), qual).otherwise(F.raise_error(F.concat(F.lit("as many qualities as letters are needed: "), name)).cast("string"))


def read_fastq(spark: SparkSession, path: str | list[str], id_regexp: str | None = None, ncbi: bool = False, multi_line: bool = False, min_partitions: int | None = None, with_raw: bool = False) -> DataFrame:
    """Records of FASTQ files. A quality of another length than its sequence is an error.

    Four-line records: files are split at line ends followed by @. A quality that starts with @ is torn off its record by that;
    its part has one line only and is put back by its place. With multi_line a record may span lines; the lines
    of such a file are parsed by one task, as a stream.
    """
    if multi_line:
        return _multi_line(spark, _paths(path), id_regexp, ncbi)
    rows = _pieces(spark, _paths(path), "\n@", blank=True).withColumn("value", F.regexp_replace(F.regexp_replace("value", r"\r", ""), r"\n+\z", ""))
    lines = F.size(F.split("value", "\n", -1))
    torn = rows.where(lines == 1).select((F.col("ordinal") - 1).alias("ordinal"), F.concat(F.lit("\n@"), F.col("value")).alias("__rest"))
    rows = rows.where(lines > 1).join(torn, "ordinal", "left").withColumn("value", F.concat("value", F.coalesce("__rest", F.lit(""))))
    rows = rows.withColumn("value", F.regexp_replace("value", r"\A\n*@?", ""))
    parts = F.split("value", "\n", -1)
    torn_before = torn.groupBy().agg(F.count("*").alias("n"))
    name, seq = F.element_at(parts, 1), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    qual = _checked(name, seq, F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit("")))
    out = _records(rows, name, seq, qual, id_regexp, ncbi, F.concat(F.lit("@"), F.col("value")) if with_raw else None)
    out = _dense(out, torn_before)
    return _at_least(out, min_partitions)


def _dense(rows: DataFrame, torn: DataFrame) -> DataFrame:
    """Numbers records again where torn parts have left holes; without any the order stays as it is."""
    if torn.first()[0] == 0:
        return rows
    blocks = rows.groupBy(F.floor(F.col("ordinal") / 4096).alias("__block")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__block").orderBy("ordinal")
    rows = rows.withColumn("__block", F.floor(F.col("ordinal") / 4096)).withColumn("__row", F.row_number().over(inside) - 1)
    return rows.join(blocks, "__block").withColumn("ordinal", F.col("__before") + F.col("__row")).drop("__block", "__row", "__before")


#: Rows and letters with qualities that the parser of records over several lines holds before it passes them on.
_ROWS, _LETTERS = 1000, 4 << 20


def _parse_lines(lines: Iterator[tuple[str, int, str]]) -> Iterator[tuple]:
    """Records from (source, input, line), the lines of a file being together and in order; holds one record."""
    file, row, name, seq, qual, size, got, at = None, 0, "", [], [], 0, 0, "header"
    for source, i, line in lines:
        if (i, source) != file:
            if at != "header":
                yield (file[1], file[0], row, name, "".join(seq), "".join(qual))
            file, row, at = (i, source), 0, "header"
        line = line.replace("\r", "")
        if at == "header":
            if line:
                name, seq, qual, size, got, at = line[1:], [], [], 0, 0, "sequence"
            continue
        if at == "sequence" and not line.startswith("+"):
            seq.append(line)
            size += len(line)
            continue
        if at == "sequence":
            at = "quality"
        else:
            qual.append(line)
            got += len(line)
        if got >= size:
            yield (source, i, row, name, "".join(seq), "".join(qual))
            row, at = row + 1, "header"
    if at != "header":
        yield (file[1], file[0], row, name, "".join(seq), "".join(qual))


def _multi_line(spark: SparkSession, paths: list[str], id_regexp: str | None, ncbi: bool) -> DataFrame:
    """Files are read in splits; the lines of a file go to one task in order, as a stream of which Python holds a batch and a record."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["source", "__input", "__row", "__n", "__s", "__q"])
        rows, letters = [], 0
        for row in _parse_lines(line for batch in batches for line in zip(batch["source"], batch["__input"], batch["value"])):
            rows.append(row)
            letters += len(row[4]) + len(row[5])
            if len(rows) >= _ROWS or letters >= _LETTERS:
                yield frame(rows)
                rows, letters = [], 0
        if rows:
            yield frame(rows)

    read = None
    for i, p in enumerate(paths):
        one = spark.read.option("lineSep", "\n").text(p).select("value", F.lit(i).alias("__input"), F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("__block"))
        read = one if read is None else read.unionAll(one)
    lines = read.withColumn("__at", F.monotonically_increasing_id()).repartition("__input", "source").sortWithinPartitions("__input", "source", "__block", "__at")
    rows = lines.select("source", "__input", "value").mapInPandas(parse, "source string, __input int, __row long, __n string, __s string, __q string")
    files = rows.groupBy("__input", "source").agg(F.count("*").alias("__c"))
    before = Window.orderBy("__input", "source").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("__input", "source", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    rows = rows.join(files, ["__input", "source"]).withColumn("ordinal", F.col("__before") + F.col("__row"))
    return _records(rows, F.col("__n"), F.col("__s"), _checked(F.col("__n"), F.col("__s"), F.col("__q")), id_regexp, ncbi)


def sniff(spark: SparkSession, path: str) -> str:
    """`fasta` or `fastq`: by ending, else by the first letter."""
    plain = _ENDING.sub("", path.lower())
    if plain.endswith(FASTA_ENDINGS):
        return "fasta"
    if plain.endswith(FASTQ_ENDINGS):
        return "fastq"
    first = spark.read.text(path).where(F.trim("value") != "").first()
    kind = {">": "fasta", "@": "fastq"}.get(first.value[0] if first else "")
    if kind is None:
        raise ValueError(f"{path}: neither FASTA nor FASTQ")
    return kind


def read_auto(spark: SparkSession, path: str, **options) -> DataFrame:
    """A file, a folder of part files, or a folder of Parquet record tables."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return (read_fasta if sniff(spark, path) == "fasta" else read_fastq)(spark, path, **options)


def from_table(df: DataFrame, id_col: str = "id", seq_col: str = "seq", qual_col: str | None = None, ordinal_col: str = "ordinal", name_col: str | None = None, descr_col: str | None = None, source: str | None = None) -> DataFrame:
    """Any table as records."""
    null = F.lit(None).cast("string")
    name = F.col(name_col) if name_col else F.col(id_col)
    return df.select(
        F.col(ordinal_col).cast("long").alias("ordinal"), F.lit(source).cast("string").alias("source"), F.col(id_col).cast("string").alias("id"), name.cast("string").alias("name"),
        (F.col(descr_col) if descr_col else F.lit("")).alias("descr"), F.col(seq_col).alias("seq"), (F.col(qual_col) if qual_col else null).alias("qual"),
    )
