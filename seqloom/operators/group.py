"""Grouping and aggregating records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import codes
from seqloom.functions import sequence as S
from seqloom.operators.keys import ONE_STRAND, group_key, record_key

OFFSETS = {"sanger": 33, "solexa": 64, "illumina-1.3+": 64, "illumina-1.5+": 64, "illumina-1.8+": 33}


def stats(df: DataFrame, *, all: bool = False, gap_letters: str = "- .", encoding: str = "sanger", label: str = "-") -> DataFrame:
    """One row: file, format, type, num_seqs, sum_len, min_len, avg_len, max_len; with `all` also Q1, Q2, Q3, sum_gap, N50, Q20, Q30, L50.

    Quartiles and N50 come from the histogram of lengths. Quartiles are medians of halves, the middle record being in both.
    The type is that of the first record. No records: zeros, and empty format and type.
    """
    if encoding not in OFFSETS:
        raise ValueError(f"encoding is one of {sorted(OFFSETS)}")
    length, base = F.length("seq"), OFFSETS[encoding]
    above = lambda q: F.regexp_count("qual", F.lit(f"[{chr(92)}x{base + q:02x}-~]"))
    kind = S.guess_type(F.substring("seq", 1, 10_000))
    kind = F.when(kind == "dna", "DNA").when(kind == "rna", "RNA").when(kind == "protein", "Protein").otherwise("")
    aggregates = [
        F.coalesce(F.when(F.max(F.col("qual").isNotNull()), "FASTQ").when(F.count("*") > 0, "FASTA"), F.lit("")).alias("format"),
        F.coalesce(F.min_by(kind, "ordinal"), F.lit("")).alias("type"),
        F.count("*").alias("num_seqs"),
        F.coalesce(F.sum(length), F.lit(0)).alias("sum_len"),
        F.coalesce(F.min(length), F.lit(0)).cast("long").alias("min_len"),
        F.coalesce(F.round(F.avg(length), 1), F.lit(0.0)).alias("avg_len"),
        F.coalesce(F.max(length), F.lit(0)).cast("long").alias("max_len"),
    ]
    if not all:
        return df.agg(*aggregates).select(F.lit(label).alias("file"), "*")
    share = lambda q: F.coalesce(F.round(F.try_divide(F.sum(above(q)) * 100, F.sum(length)), 2), F.lit(0.0))
    aggregates += [F.coalesce(F.sum(S.count_letters(F.col("seq"), gap_letters)), F.lit(0)).alias("sum_gap"), share(20).alias("Q20"), share(30).alias("Q30")]
    # at most as many rows as there are different lengths
    lengths = df.groupBy(length.cast("long").alias("__len")).agg(F.count("*").alias("__n"))
    up, everything = Window.orderBy("__len"), Window.partitionBy()
    lengths = lengths.select(
        "__len", "__n",
        F.sum("__n").over(up).alias("__to"),
        F.sum("__n").over(everything).alias("__all"),
        F.sum(F.col("__len") * F.col("__n")).over(Window.orderBy(F.desc("__len"))).alias("__bases"),
        F.sum("__n").over(Window.orderBy(F.desc("__len"))).alias("__from_top"),
        F.sum(F.col("__len") * F.col("__n")).over(everything).alias("__sum"),
    )
    at = lambda rank: F.min(F.when(F.col("__to") >= rank, F.col("__len")))
    n = F.col("__all")
    half = F.floor((n + 1) / 2)
    middle = lambda first, size: (at(first + F.floor((size - 1) / 2) + 1) + at(first + F.floor(size / 2) + 1)) / 2
    zero = F.lit(0)
    enough = F.col("__bases") * 2 >= F.col("__sum")
    quartiles = lengths.agg(
        F.coalesce(middle(zero, half), F.lit(0.0)).alias("Q1"), F.coalesce(middle(zero, n), F.lit(0.0)).alias("Q2"), F.coalesce(middle(n - half, half), F.lit(0.0)).alias("Q3"),
        F.coalesce(F.max(F.when(enough, F.col("__len"))), F.lit(0).cast("long")).alias("N50"),
        # records of the longer lengths, and as many of the N50 length as the half needs
        F.coalesce(F.min_by(F.col("__from_top") - F.col("__n") + F.ceil((F.col("__sum") / 2 - (F.col("__bases") - F.col("__len") * F.col("__n"))) / F.greatest(F.col("__len"), F.lit(1))), F.when(enough, -F.col("__len"))), F.lit(0)).cast("long").alias("L50"),
    )
    return df.agg(*aggregates).join(quartiles).select(F.lit(label).alias("file"), "format", "type", "num_seqs", "sum_len", "min_len", "avg_len", "max_len", "Q1", "Q2", "Q3", "sum_gap", "N50", "L50", "Q20", "Q30")


def _key(by: str, ignore_case: bool, both_strands: bool, seq_type: str) -> Column:
    return group_key(by, ignore_case, by == "seq" and both_strands and seq_type not in ONE_STRAND).alias("__key")


def _firsts(df: DataFrame, key: Column) -> DataFrame:
    """The first ordinal of each key: keys meet in an aggregate, whole records don't cross the cluster for it."""
    return df.groupBy(key).agg(F.min("ordinal").alias("ordinal")).select("ordinal")


def rmdup(df: DataFrame, *, by: str = "id", ignore_case: bool = False, both_strands: bool = True, seq_type: str = "auto") -> DataFrame:
    """The first record of each id, name or sequence; sequences count as equal to their reverse complement with both_strands."""
    return df.join(_firsts(df, _key(by, ignore_case, both_strands, seq_type)), "ordinal", "left_semi")


def rmdup_removed(df: DataFrame, *, by: str = "id", ignore_case: bool = False, both_strands: bool = True, seq_type: str = "auto") -> DataFrame:
    """The records that rmdup() drops."""
    return df.join(_firsts(df, _key(by, ignore_case, both_strands, seq_type)), "ordinal", "left_anti")


def rmdup_counts(df: DataFrame, *, by: str = "id", ignore_case: bool = False, both_strands: bool = True, seq_type: str = "auto") -> DataFrame:
    """n, ids: for each key of several records their number and their ids in order, joined by `, `."""
    key = _key(by, ignore_case, both_strands, seq_type)
    shared = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    rows = df.select(key, "ordinal", "id").join(shared, "__key")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"]), ", ")
    return rows.groupBy("__key", "n").agg(ids.alias("ids")).select("n", "ids")


def rename(df: DataFrame, *, by: str = "id") -> DataFrame:
    """Later records of an id (or name) get `_2`, `_3`, ... on their id."""
    row = F.row_number().over(Window.partitionBy(record_key(by)).orderBy("ordinal"))
    out = df.withColumn("__row", row)
    new = F.concat("id", F.lit("_"), F.col("__row").cast("string"))
    name = F.when(F.col("descr") == "", new).otherwise(F.concat(new, F.lit(" "), F.col("descr")))
    again = F.col("__row") > 1
    return out.withColumns({"name": F.when(again, name).otherwise(F.col("name")), "id": F.when(again, new).otherwise(F.col("id"))}).drop("__row")


def faidx_index(df: DataFrame, *, full_head: bool = False, block: int = 4096) -> DataFrame:
    """name, length, offset, line_bases, line_width, qual_offset, from records read with their raw text.

    Offsets are byte counts of the records before, as prefix sums over blocks and within them. Lines of
    unequal length but for the last are an error.
    """
    head = F.octet_length(F.substring_index("raw", "\n", 1)) + 1
    body = F.when(F.col("qual").isNull(), F.substring(F.col("raw"), F.length(F.substring_index("raw", "\n", 1)) + 2, F.length("raw"))).otherwise(F.col("seq"))
    lines = F.filter(F.split(F.regexp_replace(body, r"\n+\z", ""), "\n"), lambda x: x != "")
    widths = F.transform(lines, lambda x: F.length(F.regexp_replace(x, r"\r", "")))
    first = F.coalesce(F.try_element_at(widths, F.lit(1)), F.lit(0))
    bad = F.exists(F.slice(widths, 1, F.greatest(F.size(widths) - 1, F.lit(0))), lambda w: w != first) | (F.coalesce(F.try_element_at(widths, F.lit(-1)), F.lit(0)) > first)
    # what is dealt to blocks has no text but the name
    rows = df.select(
        F.col("name" if full_head else "id").alias("name"),
        F.length("seq").cast("long").alias("length"),
        F.when(bad, F.raise_error(F.concat(F.lit("lines differ in length before the last one of record "), F.col("id"))).cast("long")).otherwise(first.cast("long")).alias("line_bases"),
        F.when(F.col("raw").contains("\r\n"), 2).otherwise(1).alias("__breaks"),
        F.col("qual").isNotNull().alias("__fastq"),
        head.alias("__head"),
        (F.octet_length("raw") + 1).alias("__bytes"),
        "ordinal",
        F.floor(F.col("ordinal") / block).alias("__block"),
    )
    blocks = rows.groupBy("__block").agg(F.sum("__bytes").alias("__sum"))
    blocks = blocks.select("__block", F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__bytes").over(Window.partitionBy("__block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__inside", inside).join(blocks, "__block")
    offset, breaks = F.col("__before") + F.col("__inside") + F.col("__head"), F.col("__breaks")
    return rows.select(
        "name",
        "length",
        offset.cast("long").alias("offset"),
        "line_bases",
        F.when(F.col("line_bases") > 0, F.col("line_bases") + breaks).otherwise(0).cast("long").alias("line_width"),
        F.when(F.col("__fastq"), offset + F.col("length") + breaks + 1 + breaks).cast("long").alias("qual_offset"),
    )
