"""Operators on one record at a time."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import codes
from seqloom.functions import sequence as S
from seqloom.operators.keys import ONE_STRAND


def _without_gaps(df: DataFrame, gaps: str) -> DataFrame:
    if not gaps or not gaps.isascii():
        raise ValueError("gap letters are ASCII, one at least")
    kept = F.array_join(F.transform(F.filter(F.arrays_zip(F.split("seq", "").alias("s"), F.split("qual", "").alias("q")), lambda z: ~z["s"].isin(*gaps)), lambda z: z["q"]), "")
    return df.withColumn("qual", F.when(F.col("qual").isNotNull(), kept)).withColumn("seq", F.translate("seq", gaps, ""))


def seq(
    df: DataFrame, *, reverse: bool = False, complement: bool = False, only: str = "record", only_id: bool = False, remove_gaps: bool = False, gap_letters: str = codes.GAPS,
    case: str | None = None, to: str | None = None, validate: bool = False, validate_len: int = 10_000, min_len: int | None = None, max_len: int | None = None,
    min_qual: float | None = None, max_qual: float | None = None, qual_base: int = 33, seq_type: str = "auto",
) -> DataFrame:
    """Filters by length and mean quality, then reverses, complements, converts. `only`: name, seq or qual give one column `value`."""
    if min_len is not None and max_len is not None and 0 < max_len < min_len:
        raise ValueError("min_len is above max_len")
    if min_qual is not None and max_qual is not None and 0 < max_qual < min_qual:
        raise ValueError("min_qual is above max_qual")
    if only not in ("record", "name", "seq", "qual", "name+seq") or case not in (None, "lower", "upper") or to not in (None, "rna", "dna"):
        raise ValueError("unknown value of only, case or to")
    if remove_gaps:
        df = _without_gaps(df, gap_letters)
    if min_len and min_len > 0:
        df = df.where(F.length("seq") >= min_len)
    if max_len and max_len > 0:
        df = df.where(F.length("seq") <= max_len)
    quality = S.mean_quality(F.col("qual"), qual_base)
    if min_qual and min_qual > 0:
        df = df.where(quality >= min_qual)
    if max_qual and max_qual > 0:
        df = df.where(quality < max_qual)
    if only_id:
        df = df.withColumn("name", F.col("id"))
    if validate or seq_type in codes.LETTERS:
        kind = "dna" if seq_type == "auto" else seq_type
        bad = F.substring("seq", 1, validate_len or 1 << 30).rlike("[^" + re.escape(codes.LETTERS[kind] + codes.GAPS) + "]")
        df = df.withColumn("seq", F.when(bad, F.raise_error(F.concat(F.lit(f"letters not of {kind}: "), F.col("id"))).cast("string")).otherwise(F.col("seq")))
    changed, quals = F.col("seq"), F.col("qual")
    if reverse:
        changed, quals = F.reverse(changed), F.reverse(quals)
    if complement and seq_type not in ONE_STRAND:
        changed = S.complement(changed, seq_type == "rna")
    if to:
        changed = F.translate(changed, "Tt", "Uu") if to == "rna" else F.translate(changed, "Uu", "Tt")
    if case:
        changed = F.lower(changed) if case == "lower" else F.upper(changed)
    df = df.withColumns({"seq": changed, "qual": quals})
    if only == "record":
        return df
    values = {"name": F.col("name"), "seq": F.col("seq"), "qual": F.when(F.col("qual").isNull(), F.raise_error(F.lit("FASTA has no quality")).cast("string")).otherwise(F.col("qual"))}
    if only == "name+seq":
        return df.select("ordinal", F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")).alias("value"))
    return df.select("ordinal", values[only].alias("value"))


def seq_type(df: DataFrame, guess_length: int = 10_000) -> str:
    """The type of a dataset: that of its first record's first letters (0: all of them). One small job; `auto` without records."""
    if guess_length and guess_length < 1000:
        raise ValueError("the guess takes 1000 letters at least, or all")
    text = F.substring("seq", 1, guess_length) if guess_length else F.col("seq")
    return df.agg(F.min_by(S.guess_type(text), "ordinal")).first()[0] or "auto"


def fq2fa(df: DataFrame) -> DataFrame:
    return df.withColumn("qual", F.lit(None).cast("string"))


def duplicate(df: DataFrame, times: int = 1) -> DataFrame:
    """Each record `times` times; `copy` numbers them from 1."""
    if times < 1:
        raise ValueError("times must be at least 1")
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def _java_replacement(text: str) -> str:
    r"""`${1}` and `$1` refer to groups, `$$` is a dollar; anything else stands for itself."""
    out = re.sub(r"\$\$|\$\{(\d+)\}|\$(\d+)|[\\$]", lambda m: r"\$" if m[0] == "$$" else f"${m[1] or m[2]}" if m[1] or m[2] else "\\" + m[0], text)
    return out


def replace(
    df: DataFrame, pattern: str, replacement: str = "", *, by_seq: bool = False, ignore_case: bool = False, nr_width: int = 1, kv: DataFrame | None = None,
    key_idx: int = 1, on_miss: str = "replace", miss_text: str = "", id_regexp: str | None = None,
) -> DataFrame:
    """Replaces all matches in the name (or the sequence of FASTA records).

    `{nr}` is the record's number from 1; `{kv}` the value of the key captured by group `key_idx` in kv (columns k, v). A key that kv lacks:
    on_miss `untouched` leaves the record, `keep_key` puts the key, `replace` puts miss_text. Two matches in one name are an error with {kv}.
    """
    if not pattern:
        raise ValueError("a pattern is needed")
    if on_miss not in ("replace", "keep_key", "untouched"):
        raise ValueError("on_miss is replace, keep_key or untouched")
    column = "seq" if by_seq else "name"
    regexp = f"(?i){pattern}" if ignore_case else pattern
    target = F.col(column)
    if by_seq:
        target = F.when(F.col("qual").isNull(), target).otherwise(F.raise_error(F.lit("sequences of FASTQ records can't be replaced")).cast("string"))
    if "{kv}" in replacement:
        if kv is None or by_seq:
            raise ValueError("{kv} needs key-values and works on names")
        key = F.regexp_extract("name", regexp, key_idx)
        key = F.lower(key) if ignore_case else key
        keys = F.when(F.col("name").rlike(regexp), key)
        kv = kv.select((F.lower("k") if ignore_case else F.col("k")).alias("__k"), F.col("v").alias("__v"))
        df = df.withColumn("__key", keys).join(kv, F.col("__key") == F.col("__k"), "left").drop("__k")
        missing = F.col("__key") if on_miss == "keep_key" else F.lit(miss_text)
        value = F.coalesce(F.col("__v"), missing)
        target = F.when(F.regexp_count("name", F.lit(regexp)) > 1, F.raise_error(F.concat(F.lit("pattern matches more than once: "), F.col("name"))).cast("string")).otherwise(target)
    # {nr} and {kv} depend on the record: letters that mean something in a replacement are quoted
    quoted = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
    parts: list[Column] = []
    for piece in re.split(r"(\{nr\}|\{kv\})", replacement):
        if piece == "{nr}":
            nr = (F.col("ordinal") + 1).cast("string")
            parts.append(F.lpad(nr, F.greatest(F.length(nr), F.lit(nr_width)), F.lit("0")))
        elif piece == "{kv}":
            parts.append(quoted(value))
        elif piece:
            parts.append(F.lit(_java_replacement(piece)))
    new = F.regexp_replace(target, F.lit(regexp), F.concat(*parts) if parts else F.lit(""))
    if "{kv}" in replacement:
        if on_miss == "untouched":
            new = F.when(F.col("__v").isNull(), target).otherwise(new)
        new = F.when(F.col("__key").isNull(), target).otherwise(new)
    df = df.withColumn(column, new).drop("__key", "__v")
    if not by_seq:
        ids = S.parse_header(F.col("name"), id_regexp)
        df = df.withColumns({"id": ids[0], "descr": ids[1]})
    return df


def subseq(df: DataFrame, region: str) -> DataFrame:
    """The region `a:b` of each sequence and quality."""
    start, end = S.parse_span(region)
    length = F.length("seq")
    return df.withColumns({"seq": S.region(F.col("seq"), start, end, length), "qual": S.region(F.col("qual"), start, end, length)})


def translate(
    df: DataFrame, *, table: int = 1, frames: tuple[int, ...] = (1,), trim: bool = False, clean: bool = False, allow_unknown: bool = False, init_as_m: bool = False,
    append_frame: bool = False, seq_type: str = "auto",
) -> DataFrame:
    """One protein record per frame, with a column `frame`; 6 stands for all six frames."""
    if seq_type in ONE_STRAND:
        raise ValueError("only DNA and RNA can be translated")
    frames = (1, 2, 3, -1, -2, -3) if 6 in frames else tuple(frames)
    proteins = F.array(*[F.struct(F.lit(f).alias("frame"), S.translate(F.col("seq"), f, table, allow_unknown, init_as_m, clean, trim).alias("seq")) for f in frames])
    out = df.withColumn("__p", F.explode(proteins)).withColumns({"frame": F.col("__p.frame"), "seq": F.col("__p.seq"), "qual": F.lit(None).cast("string")}).drop("__p")
    if append_frame:
        out = out.withColumn("id", F.concat("id", F.lit("_frame="), F.col("frame").cast("string")))
        out = out.withColumn("name", F.concat("id", F.lit(" "), "descr"))
    return out


def genetic_codes(spark: SparkSession, table: int = 0, ambiguous: bool = False) -> DataFrame:
    """0: number and name of all codes; else the codons of one, with degenerate ones if asked for."""
    if table == 0:
        return spark.createDataFrame([(n, c[0]) for n, c in codes.CODES.items()], "code int, name string")
    rows = (codes.degenerate_codons if ambiguous else codes.codons)(table)
    return spark.createDataFrame([(c, a, c in codes.starts(table)) for c, a in rows.items()], "codon string, amino_acid string, start boolean")
