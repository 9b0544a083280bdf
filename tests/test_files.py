"""Files: layouts, round trips, small tables."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seqloom import operators as O
from seqloom.sources import fastx, sinks, tables


def put(path, text):
    path.write_bytes(text.encode())
    return str(path)


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("ordinal").select(*columns).collect()]


def test_fasta_layouts(spark, tmp_path):
    path = put(tmp_path / "a.fa", "\n>one first > part\r\nACG\r\n\r\nT\r\n>empty\n>two\nGG\nCC")
    df = fastx.read_auto(spark, path)
    assert rows(df, "ordinal", "id", "descr", "seq", "qual") == [(0, "one", "first > part", "ACGT", None), (1, "empty", "", "", None), (2, "two", "", "GGCC", None)]


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_fastq_with_marks_in_quality(spark, tmp_path, split):
    draw = random.Random(split)
    want, text = [], ""
    for i in range(60):
        seq = "".join(draw.choice("ACGT") for _ in range(draw.randrange(1, 30)))
        qual = draw.choice("@+I") + "".join(draw.choice("@+I5") for _ in seq[1:])
        want.append((i, f"r{i}", seq, qual))
        text += f"@r{i} d\n{seq}\n+\n{qual}\n"
    path = put(tmp_path / "a.fq", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert rows(fastx.read_fastq(spark, path), "ordinal", "id", "seq", "qual") == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fastq_many_lines_and_errors(spark, tmp_path):
    path = put(tmp_path / "a.fq", "@a x\nAC\nGT\n+a\n@I\n+I\n@b\nA\n+\n@\n")
    assert rows(fastx.read_fastq(spark, path, multi_line=True), "id", "seq", "qual") == [("a", "ACGT", "@I+I"), ("b", "A", "@")]
    path = put(tmp_path / "b.fq", "@a\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="as many qualities"):
        fastx.read_fastq(spark, path).collect()


def test_order_over_files(spark, tmp_path):
    one, two = put(tmp_path / "z.fa", ">a\nA\n>b\nC\n"), put(tmp_path / "b.fa", ">c\nG\n")
    assert rows(fastx.read_fasta(spark, [one, two]), "ordinal", "id") == [(0, "a"), (1, "b"), (2, "c")]
    listed = put(tmp_path / "list", f"{one}\n\n{two}\n")
    assert fastx.read_list(spark, listed) == [one, two]


@pytest.mark.parametrize("merge", [False, True])
def test_round_trip(spark, tmp_path, merge):
    path = put(tmp_path / "a.fa", "".join(f">s{i} d{i}\n{'ACGTN' * i}\n" for i in range(30)))
    df = fastx.read_fasta(spark, path)
    sinks.write_fastx(df, str(tmp_path / "out"), width=7, merge=merge)
    again = fastx.read_fasta(spark, str(tmp_path / "out"))
    assert rows(again, "ordinal", "name", "seq") == rows(df, "ordinal", "name", "seq")


def test_index_matches_file(spark, tmp_path):
    text = "".join(f">s{i} d\n" + "".join(("ACGT" * i)[k : k + 10] + "\n" for k in range(0, 4 * i, 10)) for i in range(1, 20))
    path = put(tmp_path / "a.fa", text)
    index = O.faidx_index(fastx.read_fasta(spark, path, with_raw=True))
    for r in index.collect():
        assert text[r.offset : r.offset + r.line_bases] == ("ACGT" * int(r.name[1:]))[: r.line_bases]
        assert r.length == 4 * int(r.name[1:]) and r.line_width == r.line_bases + 1
    sinks.write_index(index, str(tmp_path / "fai"))
    assert tables.read_index(spark, str(tmp_path / "fai")).count() == 19
    bad = put(tmp_path / "b.fa", ">a\nACG\nA\nACG\n")
    with pytest.raises(Exception, match="lines differ in length"):
        O.faidx_index(fastx.read_fasta(spark, bad, with_raw=True)).collect()


def test_small_tables(spark, tmp_path):
    bed = put(tmp_path / "a.bed", "#c\ntrack x\nbrowser y\nchr1\t5\n\nchr1\t0\t4\tn\t0\t-\nCHR2\t3\t9\n")
    assert [tuple(r) for r in tables.read_bed(spark, bed).orderBy("s").collect()] == [("chr1", 1, 4, "n", "-"), ("CHR2", 4, 9, None, None)]
    assert tables.read_bed(spark, bed, chrs=["chr2"]).count() == 1
    for line in ("chr1\t4\t4\n", "chr1\t1\t4\tn\t0\tx\n"):
        with pytest.raises(Exception, match="bad"):
            tables.read_bed(spark, put(tmp_path / "bad.bed", line)).collect()
    gtf = put(tmp_path / "a.gtf", '#x\nchr1\ts\texon\t2\t5\t.\t-\t.\tgene_id "g 1"; n 3;\nchr1\ts\tCDS\t2\t5\t.\t.\t.\tgene_id "h";\n')
    got = tables.read_gtf(spark, gtf, types=["EXON"]).collect()
    assert [(r.s, r.e, r.strand, r.attributes["gene_id"], r.attributes["n"]) for r in got] == [(2, 5, "-", "g 1", "3")]
    kv = put(tmp_path / "kv.tsv", "a\t1\nb\na\t2\tx\n")
    assert [tuple(r) for r in tables.read_key_values(spark, kv).collect()] == [("a", "2")]
    assert [r.pattern for r in tables.read_patterns(spark, put(tmp_path / "p", "x\n\ny\n")).collect()] == ["x", "y"]
    assert [tables.parse_region(r) for r in ("id:5-10", "id:5", "id:5-", "id:-5", "id", "a:b:-7--2")] == [("id", 5, 10), ("id", 5, 5), ("id", 5, -1), ("id", 1, 5), ("id", 1, -1), ("a:b", -7, -2)]


def test_pairs_and_locations(spark, tmp_path):
    a, b = (fastx.read_fastq(spark, put(tmp_path / f"{x}.fq", text)) for x, text in (("a", "@r\nA\n+\nI\n@s\nC\n+\nI\n"), ("b", "@r\nG\n+\nI\n")))
    sinks.write_pairs(O.pair(a, b), O.unpaired(a, b), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/paired.2")).count() == 4
    assert spark.read.text(str(tmp_path / "out/unpaired.1")).count() == 4
    found = O.locate(O.fq2fa(a), {"p": "A"}, both_strands=False)
    assert [r.v for r in found.select(sinks.bed_text().alias("v")).collect()] == ["r\t0\t1\tp\t0\t+"]
    assert found.select(sinks.gtf_text().alias("v")).first().v.startswith("r\tseqloom\tlocation\t1\t1\t0\t+\t.\tgene_id")
    assert found.where(F.col("matched") == "A").count() == 1


def test_index_is_dealt_out(spark, tmp_path):
    """No task writes the whole index, and the part files follow one another."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.col("id").alias("ordinal"), F.concat(F.lit("r"), "id").alias("id"), F.concat(F.lit("r"), "id").alias("name"), F.repeat(F.lit("A"), F.col("id").cast("int") % 50).alias("seq"))
        index = O.faidx_index(df.withColumn("qual", F.col("seq")).withColumn("raw", sinks.fastx_text()), block=256)
        sinks.write_index(index, str(tmp_path / "fai"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    parts = [f.read_text().splitlines() for f in sorted((tmp_path / "fai").glob("part-*"))]
    assert sum(map(len, parts)) == 4000 and max(map(len, parts)) < 3000
    offsets = [int(line.split("\t")[2]) for part in parts for line in part]
    assert offsets == sorted(offsets)


@pytest.mark.parametrize("order", ["ordinal", None])
def test_merged_file_has_no_task_with_all_lines(spark, tmp_path, order):
    """One file in order, of lines that several tasks wrote; what was there before goes."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    marked = F.concat(F.lit("r"), "ordinal")
    out = tmp_path / "out"
    try:
        df = spark.range(4000, numPartitions=5).select(F.col("id").alias("ordinal"))
        for rows in (df.limit(3), df):
            sinks.write_text(rows, marked, str(out), order, merge=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    files = list(out.glob("part-*"))
    assert len(files) == 1 and [f.name for f in tmp_path.iterdir()] == ["out"]
    lines = files[0].read_text().splitlines()
    assert lines == [f"r{i}" for i in range(4000)]


def test_merge_uses_several_tasks(spark, tmp_path, monkeypatch):
    """The joined parts are more than one."""
    seen, joined = [], sinks._join_parts
    monkeypatch.setattr(sinks, "_join_parts", lambda s, parts, path: (seen.extend(p.name for p in Path(parts).glob("part-*")), joined(s, parts, path)))
    df = spark.range(4000, numPartitions=5).select(F.col("id").alias("ordinal"))
    sinks.write_text(df, F.col("ordinal").cast("string"), str(tmp_path / "out"), None, merge=True)
    assert len(seen) == 5
    assert spark.read.text(str(tmp_path / "out")).count() == 4000


def test_records_over_lines_are_a_stream():
    """A record comes before the lines behind it are taken; ends and blanks as ever."""
    taken = []

    def lines(*texts):
        for n, text in enumerate(texts):
            for line in text.split("\n"):
                taken.append(line)
                yield f"f{n}", 0, line

    text = "\n@a x\r\nAC\nGT\n+a\n@I\n+I\n\n@b\nA\n+\n@\n@none\n\n+\n@cut\nAC\n+\nI"
    stream = fastx._parse_lines(lines(text, "@c\nAC", "@d\nG\n+\nI\n"))
    assert next(stream) == ("f0", 0, 0, "a x", "ACGT", "@I+I") and len(taken) == 7
    assert list(stream) == [("f0", 0, 1, "b", "A", "@"), ("f0", 0, 2, "none", "", ""), ("f0", 0, 3, "cut", "AC", "I"), ("f1", 0, 0, "c", "AC", ""), ("f2", 0, 0, "d", "G", "I")]


@pytest.mark.parametrize("split", [50, 1 << 20])
def test_records_over_lines_in_splits(spark, tmp_path, split):
    """A file's records are the same however it is split; ordinals go on from file to file."""
    draw = random.Random(split)
    want, paths = [], []
    for x in "zb":
        text = ""
        for _ in range(40):
            seq = "".join(draw.choice("ACGT") for _ in range(draw.randrange(1, 40)))
            qual = "".join(draw.choice("@+I5") for _ in seq)
            fold = lambda s: "\n".join(s[k : k + 9] for k in range(0, len(s), 9))
            text += f"@r{len(want)} d\n{fold(seq)}\n+\n{fold(qual)}\n"
            want.append((len(want), f"r{len(want)}", seq, qual))
        paths.append(put(tmp_path / f"{x}.fq", text))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert rows(fastx.read_fastq(spark, paths, multi_line=True), "ordinal", "id", "seq", "qual") == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
