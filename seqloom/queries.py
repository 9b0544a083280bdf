"""One query per operator over record views of the test tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import operators as O
from seqloom.operators.order import hash_place, with_rank
from seqloom.functions.sequence import wrap
from seqloom.sources import fastx, sinks, tables
from seqloom.sources.sinks import bed_text

# ---- views: records made from the table of documents


def reads(spark: SparkSession, d: str) -> DataFrame:
    seq = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    return spark.read.parquet(f"{d}/documents.parquet").select(
        F.col("doc_id").alias("ordinal"),
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.concat(F.lit("d"), "doc_id", F.lit(" "), "lang", F.lit(" "), "source").alias("name"),
        F.concat("lang", F.lit(" "), "source").alias("descr"),
        seq.alias("seq"),
        F.translate(seq, "ACGT", "5?I#").alias("qual"),
    )


def dup(spark: SparkSession, d: str) -> DataFrame:
    new = F.concat(F.lit("g"), (F.col("ordinal") % 97).cast("string"))
    return reads(spark, d).withColumns({"id": new, "name": F.concat(new, F.lit(" "), "descr")})


def r1(spark: SparkSession, d: str) -> DataFrame:
    return dup(spark, d)


def r2(spark: SparkSession, d: str) -> DataFrame:
    """All records again, under other ids, two thirds of them with other sequences."""
    new, size = F.concat(F.lit("g"), (F.col("ordinal") % 131).cast("string")), F.greatest(F.length("seq") - (F.col("ordinal") % 3).cast("int"), F.lit(0))
    return reads(spark, d).withColumns({"id": new, "name": F.concat(new, F.lit(" "), "descr"), "seq": F.substring(F.col("seq"), F.lit(1), size), "qual": F.substring(F.col("qual"), F.lit(1), size)})


def gaps(spark: SparkSession, d: str) -> DataFrame:
    seq = F.regexp_replace(F.upper("text"), "[^ACGT .-]", "")
    null = F.lit(None).cast("string")
    new = F.concat(F.lit("d"), "doc_id")
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("ordinal"), new.alias("id"), new.alias("name"), F.lit("").alias("descr"), seq.alias("seq"), null.alias("qual"))


def key_values(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet").select(F.concat(F.lit("d"), "doc_id").alias("k"), F.concat(F.lit("q"), "quality").alias("v"))


def bed(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("ordinal")
    return reads(spark, d).where(F.length("seq") >= 100).select(
        F.col("id").alias("chr"), (10 + o % 50).alias("s"), (29 + o % 50).alias("e"), F.concat(F.lit("f"), "ordinal").alias("feat"), F.when(o % 2 == 0, "+").otherwise("-").alias("strand")
    )


def gtf(spark: SparkSession, d: str) -> DataFrame:
    rows = bed(spark, d).withColumn("type", F.when(F.col("s") % 3 == 0, "CDS").otherwise("exon"))
    return rows.withColumn("attributes", F.create_map(F.lit("gene_id"), F.concat(F.lit("gene_"), "feat"), F.lit("source"), F.lit("x"))).drop("feat")


def parts(spark: SparkSession, d: str) -> DataFrame:
    part = F.substring("seq", 11, 30)
    turned = F.reverse(F.translate(part, "ACGT", "TGCA"))
    return reads(spark, d).where(F.length("seq") >= 60).select("id", F.when(F.col("ordinal") % 2 == 0, part).otherwise(turned).alias("seq"))


_VIEWS = {
    "fx_reads": """SELECT doc_id AS ordinal, concat('d', doc_id) AS id, concat('d', doc_id, ' ', lang, ' ', source) AS name, concat(lang, ' ', source) AS descr,
      regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq, translate(regexp_replace(upper(text), '[^ACGT]', '', 'g'), 'ACGT', '5?I#') AS qual FROM documents""",
    "fx_dup": "SELECT ordinal, concat('g', ordinal % 97) AS id, concat('g', ordinal % 97, ' ', descr) AS name, descr, seq, qual FROM fx_reads",
    "fx_r1": "SELECT * FROM fx_dup",
    "fx_r2": """SELECT ordinal, concat('g', ordinal % 131) AS id, concat('g', ordinal % 131, ' ', descr) AS name, descr,
      substring(seq, 1, CAST(greatest(length(seq) - ordinal % 3, 0) AS BIGINT)) AS seq, substring(qual, 1, CAST(greatest(length(qual) - ordinal % 3, 0) AS BIGINT)) AS qual FROM fx_reads""",
    "fx_gaps": "SELECT doc_id AS ordinal, concat('d', doc_id) AS id, regexp_replace(upper(text), '[^ACGT .-]', '', 'g') AS seq FROM documents",
    "fx_kv": "SELECT concat('d', doc_id) AS k, concat('q', quality) AS v FROM labels",
    "fx_bed": """SELECT id AS chr, CAST(10 + ordinal % 50 AS BIGINT) AS s, CAST(29 + ordinal % 50 AS BIGINT) AS e, concat('f', ordinal) AS feat,
      CASE WHEN ordinal % 2 = 0 THEN '+' ELSE '-' END AS strand FROM fx_reads WHERE length(seq) >= 100""",
    "fx_sub": """SELECT id, CASE WHEN ordinal % 2 = 0 THEN substring(seq, 11, 30) ELSE reverse(translate(substring(seq, 11, 30), 'ACGT', 'TGCA')) END AS seq
      FROM fx_reads WHERE length(seq) >= 60""",
    "fx_two": "SELECT *, 0 AS neg, seq AS t FROM fx_reads UNION ALL SELECT *, 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM fx_reads",
}
_WITH = "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in _VIEWS.items()) + "\n"
_RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
_AAS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_MITO = "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = _WITH + sql
        return f

    return register


# ---- one record at a time


@_query(f"SELECT id, {_RC} AS seq, reverse(qual) AS qual FROM fx_reads")
def seq_revcomp(s, d):
    return O.seq(reads(s, d), reverse=True, complement=True).select("id", "seq", "qual")


@_query("SELECT id, translate(seq, 'T', 'U') AS seq FROM fx_reads")
def seq_rna(s, d):
    return O.seq(reads(s, d), to="rna").select("id", "seq")


@_query("SELECT id, lower(seq) AS seq FROM fx_reads")
def seq_case(s, d):
    return O.seq(reads(s, d), case="lower").select("id", "seq")


@_query("SELECT id, translate(seq, ' .-', '') AS seq FROM fx_gaps")
def seq_rmgaps(s, d):
    return O.seq(gaps(s, d), remove_gaps=True).select("id", "seq")


@_query("SELECT id, seq FROM fx_reads WHERE length(seq) BETWEEN 100 AND 500")
def seq_len_filter(s, d):
    return O.seq(reads(s, d), min_len=100, max_len=500).select("id", "seq")


@_query("""SELECT id FROM fx_reads WHERE length(seq) > 0 AND -10 * log10(list_sum(list_transform(string_split(qual, ''), lambda c: pow(10.0, (33 - ascii(c)) / 10.0))) / length(qual)) >= 7.5
  AND -10 * log10(list_sum(list_transform(string_split(qual, ''), lambda c: pow(10.0, (33 - ascii(c)) / 10.0))) / length(qual)) < 8.25""")
def seq_qual_filter(s, d):
    return O.seq(reads(s, d), min_qual=7.5, max_qual=8.25).select("id")


@_query("SELECT ordinal, id AS value FROM fx_reads")
def seq_names(s, d):
    return O.seq(reads(s, d), only="name", only_id=True)


@_query("SELECT id, name, seq, CAST(NULL AS VARCHAR) AS qual FROM fx_reads")
def fq2fa(s, d):
    return O.fq2fa(reads(s, d)).select("id", "name", "seq", "qual")


@_query(r"SELECT ordinal, concat('doc', ordinal, ' [', descr, ']') AS name, concat('doc', ordinal) AS id FROM fx_reads")
def replace_name(s, d):
    return O.replace(reads(s, d), r"^d(\d+) (.+)$", "doc${1} [$2]").select("ordinal", "name", "id")


@_query(r"SELECT ordinal, regexp_replace(name, '^d\d+', 'rec_' || lpad(CAST(ordinal + 1 AS VARCHAR), CAST(greatest(5, length(CAST(ordinal + 1 AS VARCHAR))) AS INTEGER), '0')) AS name FROM fx_reads")
def replace_nr(s, d):
    return O.replace(reads(s, d), r"^d\d+", "rec_{nr}", nr_width=5).select("ordinal", "name")


@_query("SELECT ordinal, concat(id, ':', coalesce(v, id), ' ', descr) AS name FROM fx_reads LEFT JOIN fx_kv ON k = id")
def replace_kv(s, d):
    return O.replace(reads(s, d), r"^(d\d+) ", "$1:{kv} ", kv=key_values(s, d), on_miss="keep_key").select("ordinal", "name")


@_query("SELECT id, regexp_replace(seq, 'A(C+)', '\\1N', 'g') AS seq FROM fx_reads")
def replace_seq(s, d):
    return O.replace(O.fq2fa(reads(s, d)), "a(c+)", "${1}N", by_seq=True, ignore_case=True).select("id", "seq")


def _protein(aas: str, strand: str, frame: int) -> str:
    base = lambda k: f"(instr('TCAG', substring({strand}, 3 * i + {frame} + {k}, 1)) - 1)"
    one = f"substring('{aas}', CAST(16 * {base(0)} + 4 * {base(1)} + {base(2)} + 1 AS BIGINT), 1)"
    return f"coalesce(array_to_string(list_transform(range(greatest((length({strand}) - {frame - 1}) // 3, 0)), lambda i: {one}), ''), '')"


@_query(f"SELECT id, {_protein(_AAS, 'seq', 1)} AS seq FROM fx_reads")
def translate_f1(s, d):
    return O.translate(reads(s, d)).select("id", "seq")


@_query(" UNION ALL ".join(f"SELECT concat(id, '_frame={sign}{f}') AS id, {sign}{f} AS frame, regexp_replace({_protein(_MITO, 't', f)}, '[X*]+$', '') AS seq FROM fx_two WHERE neg = {neg}" for sign, neg in (("", 0), ("-", 1)) for f in (1, 2, 3)))
def translate_6(s, d):
    return O.translate(reads(s, d), table=2, frames=(6,), trim=True, append_frame=True).select("id", "frame", "seq")


@_query("SELECT id, substring(seq, 5, 56) AS seq, substring(qual, 5, 56) AS qual FROM fx_reads")
def subseq_region(s, d):
    return O.subseq(reads(s, d), "5:60").select("id", "seq", "qual")


@_query("SELECT id, CASE WHEN length(seq) < 10 THEN '' ELSE substring(seq, CAST(greatest(length(seq) - 29, 1) AS BIGINT), CAST(length(seq) - 9 - greatest(length(seq) - 29, 1) + 1 AS BIGINT)) END AS seq FROM fx_reads")
def subseq_region_end(s, d):
    return O.subseq(reads(s, d), "-30:-10").select("id", "seq")


# ---- search


@_query("SELECT ordinal, id FROM fx_dup WHERE id IN ('g3', 'g50', 'g96')")
def grep_id(s, d):
    return O.grep(dup(s, d), ["g3", "g50", "g96", "absent"]).select("ordinal", "id")


@_query("SELECT ordinal, id FROM fx_reads WHERE id IN (SELECT k FROM fx_kv WHERE v = 'q1')")
def grep_id_table(s, d):
    wanted = key_values(s, d).where("v = 'q1'").select(F.col("k").alias("pattern"))
    return O.grep(reads(s, d), wanted).select("ordinal", "id")


@_query("SELECT ordinal, name FROM fx_dup WHERE lower(name) IN ('g3 en src3', 'g10 en src7', 'g4 de src1')")
def grep_name(s, d):
    return O.grep(dup(s, d), ["G3 en src3", "g10 EN src7", "g4 de src1"], by="name", ignore_case=True).select("ordinal", "name")


@_query("SELECT DISTINCT ordinal FROM fx_two WHERE contains(t, 'ACTACTG') OR contains(t, 'GATTACA')")
def grep_seq(s, d):
    return O.grep(reads(s, d), ["ACTACTG", "GATTACA"], by="seq").select("ordinal")


@_query("SELECT ordinal, name FROM fx_reads WHERE regexp_matches(name, '(fr|de) src1$')")
def grep_regex(s, d):
    return O.grep(reads(s, d), ["(fr|de) src1$"], by="name", mode="regexp").select("ordinal", "name")


@_query("SELECT DISTINCT ordinal FROM fx_two WHERE regexp_matches(t, 'AC[ACGT][CT]GG[AG]TT')")
def grep_degenerate(s, d):
    return O.grep(reads(s, d), ["ACNYGGRTT"], mode="degenerate").select("ordinal")


@_query("SELECT ordinal FROM fx_reads WHERE length(seq) >= 9 AND len(list_filter(range(1, length(seq) - 7), lambda i: hamming(substring(seq, i, 9), 'ACTATCGGA') <= 2)) > 0")
def grep_mismatch(s, d):
    return O.grep(reads(s, d), ["ACTATCGGA"], max_mismatch=2, both_strands=False).select("ordinal")


@_query("SELECT ordinal FROM fx_reads WHERE contains(substring(seq, 1, 30), 'TTA')")
def grep_region(s, d):
    return O.grep(reads(s, d), ["TTA"], region="1:30", both_strands=False).select("ordinal")


@_query("SELECT DISTINCT ordinal FROM fx_two WHERE contains(t || t, 'TAATTAC')")
def grep_circular(s, d):
    return O.grep(reads(s, d), ["TAATTAC"], by="seq", circular=True).select("ordinal")


@_query("SELECT ordinal, id FROM fx_dup WHERE id NOT IN ('g3', 'g50', 'g96')")
def grep_invert(s, d):
    return O.grep(dup(s, d), ["g3", "g50", "g96"], invert=True).select("ordinal", "id")


@_query("SELECT count(DISTINCT ordinal) AS n FROM fx_two WHERE contains(t, 'ACTAC')")
def grep_count(s, d):
    return O.grep_count(reads(s, d), ["ACTAC"], by="seq")


@_query("SELECT DISTINCT min(ordinal) OVER (PARTITION BY p) AS ordinal FROM fx_two JOIN (VALUES ('ACTAC'), ('GATTACA'), ('TTTTTTT')) AS v(p) ON contains(t, p)")
def grep_delete_matched(s, d):
    return O.grep(reads(s, d), ["ACTAC", "GATTACA", "TTTTTTT"], by="seq", first_per_pattern=True).select("ordinal")


def _located(where: str, starts: str, k: int, text: str = "t") -> str:
    return f"""SELECT id AS seq_id, p AS pattern, CASE neg WHEN 0 THEN '+' ELSE '-' END AS strand,
      CAST(CASE neg WHEN 0 THEN i ELSE length(seq) - i - {k - 1} + 1 + CASE WHEN i + {k - 1} > length(seq) THEN length(seq) ELSE 0 END END AS BIGINT) AS "start",
      CAST(CASE neg WHEN 0 THEN i + {k - 1} ELSE length(seq) - i + 1 + CASE WHEN i + {k - 1} > length(seq) THEN length(seq) ELSE 0 END END AS BIGINT) AS "end", substring({text}, i, {k}) AS matched
    FROM (SELECT *, unnest(range(1, {starts})) AS i FROM fx_two) JOIN (VALUES {where}) AS v(p) ON true"""  # noqa: E501


@_query(_located("('ACTA'), ('TATA')", "greatest(length(seq) - 2, 1)", 4) + " WHERE substring(t, i, 4) = p")
def locate_literal(s, d):
    return O.locate(reads(s, d), ["ACTA", "TATA"]).drop("pattern_name")


@_query("""SELECT seq_id, count(*) AS n FROM (SELECT id AS seq_id, unnest(regexp_extract_all(seq, 'TAT.?')) FROM fx_reads) GROUP BY seq_id""")
def locate_nongreedy(s, d):
    return O.locate(reads(s, d), ["TAT"], non_greedy=True, both_strands=False).groupBy("seq_id").agg(F.count("*").alias("n"))


@_query(_located("('ACNYG')", "greatest(length(seq) - 3, 1)", 5) + " WHERE regexp_matches(substring(t, i, 5), '^AC[ACGT][CT]G$')")
def locate_degenerate(s, d):
    return O.locate(reads(s, d), ["ACNYG"], mode="degenerate").drop("pattern_name")


@_query(_located("('ACTATC')", "greatest(length(seq) - 4, 1)", 6) + " WHERE neg = 0 AND length(substring(t, i, 6)) = 6 AND hamming(substring(t, i, 6), p) <= 1")
def locate_mismatch(s, d):
    return O.locate(reads(s, d), ["ACTATC"], max_mismatch=1, both_strands=False).drop("pattern_name")


@_query(_located("('TTAAC')", "length(seq) + 1", 5, "t || t") + " WHERE substring(t || t, i, 5) = p")
def locate_circular(s, d):
    return O.locate(reads(s, d), ["TTAAC"], circular=True).drop("pattern_name")


@_query("""SELECT concat_ws(chr(9), id, i - 1, i + 3, 'acta', 0, '+') AS value FROM (SELECT *, unnest(range(1, greatest(length(seq) - 2, 1))) AS i FROM fx_reads) WHERE substring(seq, i, 4) = 'ACTA'""")
def locate_bed(s, d):
    return O.locate(reads(s, d), {"acta": "ACTA"}, both_strands=False).select(bed_text().alias("value"))


# ---- several inputs


@_query("SELECT ordinal, id FROM fx_r1 WHERE id IN (SELECT id FROM fx_r2)")
def common_id(s, d):
    return O.common(r1(s, d), r2(s, d)).select("ordinal", "id")


@_query(f"SELECT ordinal FROM fx_r1 WHERE least(seq, {_RC}) IN (SELECT least(seq, {_RC}) FROM fx_r2)")
def common_seq(s, d):
    return O.common(r1(s, d), r2(s, d), by="seq").select("ordinal")


_CONCAT = """SELECT coalesce(a.ordinal, b.ordinal) AS ordinal, coalesce(b.ordinal, -1) AS ordinal_b, coalesce(a.id, b.id) AS id,
  CASE WHEN a.id IS NULL THEN b.name WHEN b.id IS NULL THEN a.name ELSE concat(a.id, ' ', a.descr, '|', b.descr) END AS name,
  coalesce(a.seq, '') || coalesce(b.seq, '') AS seq, coalesce(a.qual, '') || coalesce(b.qual, '') AS qual FROM fx_r1 a {} JOIN fx_r2 b ON a.id = b.id"""  # fmt: skip


@_query(_CONCAT.format("INNER"))
def concat_inner(s, d):
    return O.concat(r1(s, d), r2(s, d)).drop("descr")


@_query(_CONCAT.format("FULL"))
def concat_full(s, d):
    return O.concat(r1(s, d), r2(s, d), full=True).drop("descr").withColumn("ordinal_b", F.coalesce("ordinal_b", F.lit(-1)))


_ROWS = "(SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS k FROM {})"


@_query(f"SELECT a.id, a.ordinal AS o1, b.ordinal AS o2, a.seq AS s1, b.seq AS s2 FROM {_ROWS.format('fx_r1')} a JOIN {_ROWS.format('fx_r2')} b USING (id, k)")
def pair(s, d):
    return O.pair(r1(s, d), r2(s, d)).select("id", F.col("r1.ordinal").alias("o1"), F.col("r2.ordinal").alias("o2"), F.col("r1.seq").alias("s1"), F.col("r2.seq").alias("s2"))


@_query(f"""SELECT 1 AS side, ordinal, id FROM {_ROWS.format('fx_r1')} a WHERE NOT EXISTS (SELECT 1 FROM {_ROWS.format('fx_r2')} b WHERE a.id = b.id AND a.k = b.k)
  UNION ALL SELECT 2, ordinal, id FROM {_ROWS.format('fx_r2')} a WHERE NOT EXISTS (SELECT 1 FROM {_ROWS.format('fx_r1')} b WHERE a.id = b.id AND a.k = b.k)""")
def unpaired(s, d):
    return O.unpaired(r1(s, d), r2(s, d)).select("side", "ordinal", "id")


@_query(f"""SELECT r.id, p.seq, CASE WHEN instr(r.seq, p.seq) > 0 THEN substring(qual, instr(r.seq, p.seq), length(p.seq)) ELSE substring(reverse(qual), instr({_RC.replace('seq', 'r.seq')}, p.seq), length(p.seq)) END AS qual
  FROM fx_reads r JOIN fx_sub p ON r.id = p.id WHERE instr(r.seq, p.seq) > 0 OR instr({_RC.replace('seq', 'r.seq')}, p.seq) > 0""")
def fa2fq(s, d):
    return O.fa2fq(reads(s, d), parts(s, d)).select("id", "seq", "qual")


def _features(tail: str, begin_plus: str, end_plus: str, begin_minus: str, end_minus: str, label: str, where: str = "") -> str:
    b, e = f"greatest(CASE strand WHEN '+' THEN {begin_plus} ELSE {begin_minus} END, 1)", f"least(CASE strand WHEN '+' THEN {end_plus} ELSE {end_minus} END, length(seq))"
    part = f"CASE WHEN {b} <= {e} THEN substring(seq, {b}, {e} - {b} + 1) ELSE '' END"
    return f"""SELECT concat(id, '_', s, '-', e, ':', strand, '{tail} ', {label}) AS name, CASE strand WHEN '+' THEN {part} ELSE reverse(translate({part}, 'ACGT', 'TGCA')) END AS seq
    FROM fx_reads JOIN fx_bed ON id = chr {where}"""


@_query(_features("", "s", "e", "s", "e", "feat"))
def subseq_bed(s, d):
    return O.subseq_features(reads(s, d), bed(s, d)).select("name", "seq")


@_query(_features("_us:5_ds:120", "s - 5", "e + 120", "s - 120", "e + 5", "concat('gene_', feat)", "WHERE s % 3 = 0"))
def subseq_gtf(s, d):
    return O.subseq_features(reads(s, d), gtf(s, d), up=5, down=120, feature_types=["cds"]).select("name", "seq")


@_query(_features("_usf:15", "s - 15", "s - 1", "e + 1", "e + 15", "feat"))
def subseq_flank(s, d):
    return O.subseq_features(reads(s, d), bed(s, d), up=15, only_flank=True).select("name", "seq")


_REGIONS = ["d3:11-40", "d5:20", "d7:-15--3", "d8:5-", "d9", "d11:40-11", "d999999"]


@_query(f"""SELECT 'd3:11-40' AS head, substring(seq, 11, 30) AS seq FROM fx_reads WHERE id = 'd3' AND length(seq) >= 11
  UNION ALL SELECT 'd5:20-20', substring(seq, 20, 1) FROM fx_reads WHERE id = 'd5' AND length(seq) >= 20
  UNION ALL SELECT 'd7:-15--3', substring(seq, length(seq) - 14, 13) FROM fx_reads WHERE id = 'd7' AND length(seq) >= 15
  UNION ALL SELECT 'd8', substring(seq, 5, length(seq)) FROM fx_reads WHERE id = 'd8' AND length(seq) >= 5
  UNION ALL SELECT 'd9', seq FROM fx_reads WHERE id = 'd9' AND length(seq) >= 1
  UNION ALL SELECT 'd11:40-11', reverse(translate(substring(seq, 11, 30), 'ACGT', 'TGCA')) FROM fx_reads WHERE id = 'd11' AND length(seq) >= 11""")
def faidx_query(s, d):
    return O.faidx_query(reads(s, d), _REGIONS).select("head", "seq")


# ---- groups


@_query("""SELECT id AS name, CAST(length(seq) AS BIGINT) AS length,
  CAST(coalesce(sum(length(name) + 2 + length(seq) + (length(seq) + 59) // 60 + CASE WHEN length(seq) = 0 THEN 1 ELSE 0 END) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(name) + 2 AS BIGINT) AS "offset",
  CAST(least(length(seq), 60) AS BIGINT) AS line_bases, CAST(CASE WHEN length(seq) = 0 THEN 0 ELSE least(length(seq), 60) + 1 END AS BIGINT) AS line_width FROM fx_reads""")
def faidx_index(s, d):
    from seqloom.sources.sinks import fastx_text

    rows = O.fq2fa(reads(s, d))
    return O.faidx_index(rows.withColumn("raw", fastx_text(60))).drop("qual_offset")


@_query("""SELECT '-' AS file, 'FASTQ' AS format, 'DNA' AS type, count(*) AS num_seqs, CAST(sum(length(seq)) AS BIGINT) AS sum_len, min(length(seq)) AS min_len, round(avg(length(seq)), 1) AS avg_len, max(length(seq)) AS max_len FROM fx_reads""")
def stats_basic(s, d):
    return O.stats(reads(s, d))


@_query("""SELECT '-' AS file, 'FASTA' AS format, 'DNA' AS type, count(*) AS num_seqs, CAST(sum(l) AS BIGINT) AS sum_len, min(l) AS min_len, round(avg(l), 1) AS avg_len, max(l) AS max_len,
  (list_sort(list(l))[(len(list(l)) + 1) // 2 // 2 + CASE WHEN (len(list(l)) + 1) // 2 % 2 = 1 THEN 1 ELSE 0 END] + list_sort(list(l))[(len(list(l)) + 1) // 2 // 2 + 1]) / 2 AS Q1,
  median(l) AS Q2,
  (list_sort(list(l), 'DESC')[(len(list(l)) + 1) // 2 // 2 + CASE WHEN (len(list(l)) + 1) // 2 % 2 = 1 THEN 1 ELSE 0 END] + list_sort(list(l), 'DESC')[(len(list(l)) + 1) // 2 // 2 + 1]) / 2 AS Q3,
  CAST(sum(l - length(translate(seq, '- .', ''))) AS BIGINT) AS sum_gap, max(CASE WHEN 2 * c >= total THEN l END) AS N50, min(CASE WHEN 2 * c >= total THEN r END) AS L50, 0.0::DOUBLE AS Q20, 0.0::DOUBLE AS Q30
FROM (SELECT *, length(seq) AS l, sum(length(seq)) OVER (ORDER BY length(seq) DESC, ordinal ROWS UNBOUNDED PRECEDING) AS c, sum(length(seq)) OVER () AS total, row_number() OVER (ORDER BY length(seq) DESC, ordinal) AS r FROM fx_gaps)""")
def stats_all(s, d):
    return O.stats(gaps(s, d), all=True)


@_query("""SELECT round(100.0 * sum(length(qual) - length(translate(qual, '5?I', ''))) / sum(length(qual)), 2) AS Q20, round(100.0 * sum(length(qual) - length(translate(qual, '?I', ''))) / sum(length(qual)), 2) AS Q30 FROM fx_reads""")
def stats_quality(s, d):
    return O.stats(reads(s, d), all=True).select("Q20", "Q30")


@_query("SELECT min(ordinal) AS ordinal, id FROM fx_dup GROUP BY id")
def rmdup_id(s, d):
    return O.rmdup(dup(s, d)).select("ordinal", "id")


@_query("SELECT min(ordinal) AS ordinal, lower(name) AS name FROM fx_dup GROUP BY lower(name)")
def rmdup_name(s, d):
    return O.rmdup(dup(s, d), by="name", ignore_case=True).select("ordinal", F.lower("name").alias("name"))


@_query(f"SELECT ordinal, id, seq FROM fx_reads QUALIFY row_number() OVER (PARTITION BY least(seq, {_RC}) ORDER BY ordinal) = 1")
def rmdup_seq(s, d):
    return O.rmdup(reads(s, d), by="seq").select("ordinal", "id", "seq")


@_query(f"SELECT ordinal, id FROM fx_reads QUALIFY row_number() OVER (PARTITION BY least(seq, {_RC}) ORDER BY ordinal) > 1")
def rmdup_dups(s, d):
    return O.rmdup_removed(reads(s, d), by="seq").select("ordinal", "id")


@_query(f"SELECT count(*) AS n, string_agg(id, ', ' ORDER BY ordinal) AS ids FROM fx_reads GROUP BY least(seq, {_RC}) HAVING count(*) > 1")
def rmdup_counts(s, d):
    return O.rmdup_counts(reads(s, d), by="seq")


@_query("""SELECT ordinal, CASE WHEN r > 1 THEN concat(id, '_', r) ELSE id END AS id, CASE WHEN r > 1 THEN concat(id, '_', r, ' ', descr) ELSE name END AS name
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS r FROM fx_dup)""")
def rename(s, d):
    return O.rename(dup(s, d)).select("ordinal", "id", "name")


# ---- order


def _sorted(order: str) -> str:
    return f"SELECT ordinal, row_number() OVER (ORDER BY {order}) AS rank FROM "


@_query(_sorted("id, ordinal") + "fx_dup")
def sort_id(s, d):
    return with_rank(O.sort(dup(s, d)).select("ordinal"))


@_query(_sorted("seq DESC, ordinal") + "fx_reads")
def sort_seq(s, d):
    return with_rank(O.sort(reads(s, d), by="seq", prefix=0, reverse=True).select("ordinal"))


@_query(_sorted("length(seq), ordinal") + "fx_reads")
def sort_len(s, d):
    return with_rank(O.sort(reads(s, d), by="length").select("ordinal"))


@_query(_sorted("length(translate(seq, ' .-', '')) DESC, ordinal") + "fx_gaps")
def sort_bases(s, d):
    return with_rank(O.sort(gaps(s, d), by="bases", reverse=True).select("ordinal"))


@_query(_sorted("CAST(substring(id, 2) AS BIGINT), ordinal") + "fx_dup")
def sort_natural(s, d):
    return with_rank(O.sort(dup(s, d), natural=True).select("ordinal"))


@_query("SELECT ordinal, id FROM fx_reads WHERE ordinal BETWEEN 100 AND 149")
def range_pos(s, d):
    return O.record_range(reads(s, d), "101:150").select("ordinal", "id")


@_query("SELECT ordinal, id FROM fx_reads WHERE ordinal BETWEEN (SELECT max(ordinal) - 99 FROM fx_reads) AND (SELECT max(ordinal) - 9 FROM fx_reads)")
def range_neg(s, d):
    return O.record_range(reads(s, d), "-100:-10").select("ordinal", "id")


@_query("SELECT ordinal, id FROM fx_reads WHERE ordinal < 10")
def head(s, d):
    return O.head(reads(s, d)).select("ordinal", "id")


@_query("""SELECT ordinal, id FROM (SELECT *, CASE WHEN lang <> l0 THEN 0 WHEN src <> s0 THEN 1 ELSE 2 END AS shared FROM
    (SELECT *, string_split(descr, ' ')[1] AS lang, string_split(descr, ' ')[2] AS src, (SELECT string_split(descr, ' ')[1] FROM fx_reads WHERE ordinal = 0) AS l0, (SELECT string_split(descr, ' ')[2] FROM fx_reads WHERE ordinal = 0) AS s0 FROM fx_reads))
  QUALIFY ordinal = 0 OR coalesce(max(CASE WHEN ordinal > 0 AND (shared < 1 OR shared <> second) THEN 1 ELSE 0 END) OVER (ORDER BY ordinal), 0) = 0""".replace("shared <> second", "shared <> (SELECT CASE WHEN string_split(b.descr, ' ')[1] <> string_split(a.descr, ' ')[1] THEN 0 WHEN string_split(b.descr, ' ')[2] <> string_split(a.descr, ' ')[2] THEN 1 ELSE 2 END FROM fx_reads a, fx_reads b WHERE a.ordinal = 0 AND b.ordinal = 1)"))
def head_genome(s, d):
    return O.head_genome(reads(s, d)).select("ordinal", "id")


@_query("SELECT ordinal, id FROM fx_reads WHERE ordinal < 20")
def head_genome_strains(s, d):
    """Strains of twenty records each: the first strain is the head."""
    rows = reads(s, d).withColumn("descr", F.concat(F.lit("Some species strain s"), F.floor(F.col("ordinal") / 20)))
    return O.head_genome(rows, 2).select("ordinal", "id")


_PLACE = "CAST('0x' || substr(md5('{}:' || ordinal), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE"


@_query(f"SELECT ordinal, id FROM fx_reads WHERE {_PLACE.format(11)} < 0.25")
def sample_hash(s, d):
    return O.sample(reads(s, d), proportion=0.25).select("ordinal", "id")


@_query(f"SELECT ordinal FROM fx_reads WHERE {_PLACE.format(5)} < 100.0::DOUBLE / (SELECT count(*) FROM fx_reads)")
def sample_number(s, d):
    return O.sample(reads(s, d), number=100, seed=5).select("ordinal")


@_query(_sorted(f"{_PLACE.format(23)}, ordinal") + "fx_reads")
def shuffle_hash(s, d):
    return with_rank(O.shuffle(reads(s, d)).select("ordinal"))


@_query("SELECT ordinal, id, c AS copy FROM fx_reads, (VALUES (1), (2), (3)) AS v(c)")
def duplicate(s, d):
    return O.duplicate(reads(s, d), 3).select("ordinal", "id", "copy")


@_query("SELECT ordinal, id FROM fx_r1 UNION ALL SELECT ordinal + (SELECT max(ordinal) + 1 FROM fx_r1), id FROM fx_r2")
def union_order(s, d):
    return O.union(r1(s, d), r2(s, d), ordered=True).select("ordinal", "id")


# ---- files: written from the tables, and read back


def _place(spark: SparkSession) -> str:
    """A new folder among the checkpoints, which all executors share; a local session without that setting has one of its own."""
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="seqloom-files-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
    return f"{top}/files-{uuid.uuid4().hex}"


def _written(df: DataFrame, ending: str, **options) -> str:
    path = f"{_place(df.sparkSession)}{ending}"
    sinks.write_fastx(df, path, **options)
    return path


def _lines(df: DataFrame, *columns, ending: str = ".tsv") -> str:
    path = f"{_place(df.sparkSession)}{ending}"
    sinks.write_text(df, F.concat_ws("\t", *columns), path, order=None)
    return path


_WHOLE = ("ordinal", "id", "name", "descr", "seq", "qual")


@_query("SELECT ordinal, id, name, descr, seq, CAST(NULL AS VARCHAR) AS qual FROM fx_reads")
def file_fasta(s, d):
    return fastx.read_fasta(s, _written(O.fq2fa(reads(s, d)), ".fa")).select(*_WHOLE)


@_query("SELECT ordinal, id, name, descr, seq, CAST(NULL AS VARCHAR) AS qual FROM fx_reads")
def file_fasta_partitions(s, d):
    path = _written(O.fq2fa(reads(s, d)), ".fasta", width=0, partitions=5)
    return fastx.read_fasta(s, path, min_partitions=7).select(*_WHOLE)


@_query("SELECT ordinal, id, name, descr, seq, qual FROM fx_reads")
def file_fastq(s, d):
    return fastx.read_fastq(s, _written(reads(s, d), ".fq")).select(*_WHOLE)


@_query("SELECT ordinal, id, name, descr, seq, qual FROM fx_reads")
def file_fastq_partitions(s, d):
    return fastx.read_fastq(s, _written(reads(s, d), ".fastq", merge=True), min_partitions=7).select(*_WHOLE)


@_query("SELECT ordinal, id, seq, '@' || substring(qual, 2) AS qual FROM fx_reads WHERE length(seq) > 0")
def file_fastq_torn(s, d):
    """Qualities that begin like a header."""
    rows = O.seq(reads(s, d), min_len=1).withColumn("qual", F.concat(F.lit("@"), F.substring("qual", 2, 1 << 30)))
    back = fastx.read_fastq(s, _written(rows, ".fq"))
    return back.select(F.substring("id", 2, 20).cast("long").alias("ordinal"), "id", "seq", "qual")


@_query("SELECT ordinal, id, seq, qual FROM fx_reads WHERE length(seq) > 0")
def file_fastq_multi_line(s, d):
    rows = O.seq(reads(s, d), min_len=1)
    path = f"{_place(s)}.fq"
    fold = lambda c: wrap(F.col(c), 70)
    sinks.write_text(rows, F.concat(F.lit("@"), "name", F.lit("\n"), fold("seq"), F.lit("\n+\n"), fold("qual")), path)
    back = fastx.read_fastq(s, path, multi_line=True)
    return back.select(F.substring("id", 2, 20).cast("long").alias("ordinal"), "id", "seq", "qual")


@_query("SELECT ordinal, id, seq, CAST(NULL AS VARCHAR) AS qual FROM fx_reads UNION ALL SELECT ordinal + (SELECT max(ordinal) + 1 FROM fx_reads), id, seq, qual FROM fx_reads")
def file_sniffed(s, d):
    """A FASTA and a FASTQ folder without telling endings, from a list of inputs."""
    paths = [_written(O.fq2fa(reads(s, d)), ""), _written(reads(s, d), "")]
    listed = _lines(s.createDataFrame([(p,) for p in paths], "p string"), "p", ending=".txt")
    return O.union(*[fastx.read_auto(s, p) for p in sorted(fastx.read_list(s, listed), key=paths.index)], ordered=True).select("ordinal", "id", "seq", "qual")


@_query("SELECT ordinal, regexp_extract(name, 'src(\\d+)$', 1) AS found, 'x' || ordinal AS ncbi FROM fx_reads")
def file_header_ids(s, d):
    """Ids by a regular expression, and between bars."""
    plain = O.fq2fa(reads(s, d))
    bars = plain.withColumn("name", F.concat(F.lit("gi|1|ref|x"), "ordinal", F.lit("| y")))
    one = fastx.read_fasta(s, _written(plain, ".fa"), id_regexp=r"src(\d+)$").select("ordinal", F.col("id").alias("found"))
    return one.join(fastx.read_fasta(s, _written(bars, ".fa"), ncbi=True).select("ordinal", F.col("id").alias("ncbi")), "ordinal")


@_query("SELECT ordinal, id FROM fx_reads WHERE id IN (SELECT k FROM fx_kv WHERE v = 'q0')")
def file_patterns(s, d):
    wanted = tables.read_patterns(s, _lines(key_values(s, d).where("v = 'q0'"), "k", ending=".txt"))
    return O.grep(reads(s, d), wanted).select("ordinal", "id")


@_query("SELECT ordinal, concat(id, ':', coalesce(v, 'none'), ' ', descr) AS name FROM fx_reads LEFT JOIN fx_kv ON k = id")
def file_key_values(s, d):
    kv = tables.read_key_values(s, _lines(key_values(s, d), "k", "v"))
    return O.replace(reads(s, d), r"^(d\d+) ", "$1:{kv} ", kv=kv, on_miss="replace", miss_text="none").select("ordinal", "name")


@_query("SELECT chr, s, e, feat, strand FROM fx_bed")
def file_bed(s, d):
    return tables.read_bed(s, _lines(bed(s, d).select("chr", F.col("s") - 1, "e", "feat", F.lit("0").alias("score"), "strand"), "*", ending=".bed")).select("chr", "s", "e", "feat", "strand")


@_query("SELECT chr, s, e, strand, CASE WHEN s % 3 = 0 THEN 'CDS' ELSE 'exon' END AS type, concat('gene_', feat) AS gene, 'x' AS source FROM fx_bed")
def file_gtf(s, d):
    rows = gtf(s, d).select("chr", F.lit("made"), "type", "s", "e", F.lit("."), "strand", F.lit("."), F.concat(F.lit('gene_id "'), F.col("attributes")["gene_id"], F.lit('"; source "x";')))
    back = tables.read_gtf(s, _lines(rows, "*", ending=".gtf"))
    return back.select("chr", "s", "e", "strand", "type", F.col("attributes")["gene_id"].alias("gene"), F.col("attributes")["source"].alias("source"))


@_query("SELECT concat('d', doc_id, ':2-', 2 + doc_id % 7) AS head, substring(regexp_replace(upper(text), '[^ACGT]', '', 'g'), 2, CAST(1 + doc_id % 7 AS BIGINT)) AS seq FROM documents WHERE doc_id < 30 AND length(regexp_replace(upper(text), '[^ACGT]', '', 'g')) >= 2")
def file_regions(s, d):
    """Thirty regions from a file; a region list is short."""
    regions = s.range(30).select(F.concat(F.lit("d"), "id", F.lit(":2-"), F.col("id") % 7 + 2).alias("r"))
    return O.faidx_query(reads(s, d), tables.read_regions(s, _lines(regions, "r", ending=".txt"))).select("head", "seq")


@_query("""SELECT id AS name, CAST(length(seq) AS BIGINT) AS length,
  CAST(coalesce(sum(length(name) + 6 + 2 * length(seq)) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(name) + 2 AS BIGINT) AS "offset",
  CAST(length(seq) AS BIGINT) AS line_bases, CAST(CASE WHEN length(seq) = 0 THEN 0 ELSE length(seq) + 1 END AS BIGINT) AS line_width,
  CAST(coalesce(sum(length(name) + 6 + 2 * length(seq)) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(name) + length(seq) + 5 AS BIGINT) AS qual_offset FROM fx_reads""")
def file_fastq_index(s, d):
    """An index of FASTQ records, written and read again."""
    path = f"{_place(s)}.fai"
    sinks.write_index(O.faidx_index(reads(s, d).withColumn("raw", sinks.fastx_text())), path)
    return tables.read_index(s, path).select("name", "length", "offset", "line_bases", "line_width", "qual_offset")


@_query(f"SELECT side, ordinal, id, seq FROM (SELECT 1 AS side, a.ordinal, a.id, a.seq FROM {_ROWS.format('fx_r1')} a JOIN {_ROWS.format('fx_r2')} b USING (id, k) UNION ALL SELECT 2, b.ordinal, b.id, b.seq FROM {_ROWS.format('fx_r1')} a JOIN {_ROWS.format('fx_r2')} b USING (id, k))")
def file_pairs(s, d):
    """Both folders of a pairing, with the ordinal in the description."""
    one, two = (r(s, d).withColumn("name", F.concat("id", F.lit(" "), "ordinal")) for r in (r1, r2))
    path = _place(s)
    sinks.write_pairs(O.pair(one, two), O.unpaired(one, two), path)
    sides = [fastx.read_fastq(s, f"{path}/paired.{i}").select(F.lit(i).alias("side"), F.col("descr").cast("long").alias("ordinal"), "id", "seq") for i in (1, 2)]
    return sides[0].unionAll(sides[1])


@_query(f"SELECT a.ordinal, a.id, a.seq FROM {_ROWS.format('fx_r1')} a JOIN {_ROWS.format('fx_r2')} b USING (id, k)")
def pick_side(s, d):
    return O.pick(O.pair(r1(s, d), r2(s, d)), 0).select("ordinal", "id", "seq")


@_query("SELECT ordinal, translate(seq, ' .-', '') AS seq, translate(qual, '!', '') AS qual FROM (SELECT ordinal, seq, translate(seq, 'ACGT .-', '5?I#!!!') AS qual FROM fx_gaps)")
def seq_rmgaps_quality(s, d):
    """Qualities go with the gaps that they belong to."""
    rows = gaps(s, d).withColumn("qual", F.translate("seq", "ACGT .-", "5?I#!!!"))
    return O.seq(rows, remove_gaps=True).select("ordinal", "seq", "qual")


@_query("SELECT count(*) AS n FROM fx_reads WHERE NOT regexp_matches(seq, '[^ACGT]')")
def seq_validate(s, d):
    """All records pass; a letter of no alphabet is an error (see the tests)."""
    return O.seq(reads(s, d), validate=True, validate_len=0).agg(F.count("seq").alias("n"))


@_query("SELECT id AS seq_id, i AS start, length(m) + i - 1 AS \"end\", m AS matched FROM (SELECT id, i, regexp_extract(substring(seq, i), '^TA+C') AS m FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS i FROM fx_reads)) WHERE m <> ''")
def locate_regexp(s, d):
    """Hits of different lengths; none of them can lie within another."""
    return O.locate(reads(s, d), ["TA+C"], mode="regexp", both_strands=False).select("seq_id", "start", F.col("end").cast("int").alias("end"), "matched")


@_query("SELECT seq_id, pattern_name, start FROM (SELECT id AS seq_id, 'p' || length(p) AS pattern_name, CAST(i AS BIGINT) AS start, p FROM (SELECT *, unnest(range(1, greatest(length(seq) - 2, 1))) AS i FROM fx_reads) JOIN (VALUES ('ACTA'), ('GATTA')) AS v(p) ON substring(seq, i, length(p)) = p)")
def locate_pattern_file(s, d):
    """Patterns from a FASTA file."""
    found = s.createDataFrame([(0, "p4", "ACTA"), (1, "p5", "GATTA")], "ordinal long, name string, seq string").withColumn("qual", F.lit(None).cast("string"))
    return O.locate(reads(s, d), fastx.read_fasta(s, _written(found, ".fa")), both_strands=False).select("seq_id", "pattern_name", "start")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the distinct sequences, both strands being one."""
    return O.stats(O.rmdup(reads(spark, d), by="seq"), all=True)
