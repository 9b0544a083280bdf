"""Golden cases on tiny inputs; each runs with one and with several partitions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqloom import operators as O
from seqloom.functions import codes
from seqloom.functions import sequence as S
from seqloom.operators import join
from seqloom.schema import RECORD


def records(spark, rows, n=1):
    """rows: (name, seq) or (name, seq, qual)."""
    data = []
    for i, (name, seq, *qual) in enumerate(rows):
        head, _, descr = name.partition(" ")
        data.append((i, "x", head, name, descr, seq, qual[0] if qual else None))
    return spark.createDataFrame(data, RECORD).repartition(n)


def rows(df, *columns, order="ordinal"):
    return [tuple(r) for r in df.orderBy(order).select(*columns).collect()]


@pytest.mark.parametrize("n", [1, 7])
@pytest.mark.parametrize(("span", "want"), [((1, 1), "A"), ((2, 4), "CGT"), ((-4, -2), "cgt"), ((-4, -1), "cgtn"), ((-1, -1), "n"), ((2, -2), "CGTNacgt"), ((1, -1), "ACGTNacgtn"), ((1, 12), "ACGTNacgtn"), ((-12, -1), "ACGTNacgtn"), ((20, 30), "")])
def test_region_table(spark, span, want, n):
    df = records(spark, [("a", "ACGTNacgtn")], n)
    assert df.select(S.region(F.col("seq"), *span).alias("s")).first().s == want


@pytest.mark.parametrize("span", [(0, 3), (1, 0), (-3, 2)])
def test_bad_regions(span):
    with pytest.raises(ValueError):
        S.check_region(*span)


@pytest.mark.parametrize("n", [1, 7])
def test_rename_and_rmdup(spark, n):
    df = records(spark, [("id comment", "actg"), ("id description", "ACTG"), ("x", "TTT"), ("id", "AAA"), ("y", "TTT")], n)
    assert rows(O.rename(df), "name") == [("id comment",), ("id_2 description",), ("x",), ("id_3",), ("y",)]
    assert rows(O.rmdup(df), "ordinal") == [(0,), (2,)] + [(4,)]
    assert rows(O.rmdup(df, by="seq"), "ordinal") == [(0,), (1,), (2,)]
    assert rows(O.rmdup_removed(df, by="seq"), "ordinal") == [(3,), (4,)]
    assert sorted(map(tuple, O.rmdup_counts(df, by="seq").collect())) == [(3, "x, id, y")]
    with pytest.raises(ValueError):
        O.rmdup(df, by="nothing")


def test_degenerate_codons(spark):
    known = codes.degenerate_codons(1)
    for codon, aa in (("ACN", "T"), ("CCN", "P"), ("CGN", "R"), ("CTN", "L"), ("GCN", "A"), ("GGN", "G"), ("GTN", "V"), ("TCN", "S"), ("MGR", "R"), ("YTR", "L")):
        assert known[codon] == aa
    df = records(spark, [("a", "ACNMGRyTRTAAA"), ("b", "aug"), ("c", "AC")])
    assert rows(O.translate(df, frames=(1,)), "seq") == [("TRL*",), ("M",), ("",)]
    assert rows(O.translate(df, trim=True), "seq")[0] == ("TRL",)
    assert rows(O.translate(df, clean=True), "seq")[0] == ("TRLX",)
    assert {r.frame for r in O.translate(df, frames=(6,), allow_unknown=True).collect()} == {1, 2, 3, -1, -2, -3}
    assert rows(O.translate(records(spark, [("a", "TTGAAA")]), init_as_m=True), "seq") == [("MK",)]
    assert rows(O.translate(records(spark, [("a b", "AAA")]), append_frame=True), "name") == [("a_frame=1 b",)]
    with pytest.raises(Exception, match="codon without a reading"):
        O.translate(records(spark, [("a", "ANN")])).collect()
    assert O.genetic_codes(spark).count() == 24
    assert O.genetic_codes(spark, 1).where("start").count() == 3


def test_replace(spark):
    df = records(spark, [("seq1 one", "ACGT"), ("seq2 two", "AAAA")])
    assert rows(O.replace(df, "(.)", "$1 ", by_seq=True), "seq")[0] == ("A C G T ",)
    assert rows(O.replace(df, r"^seq(\d)", "n{nr}_${1}$$", nr_width=3), "name") == [("n001_1$ one",), ("n002_2$ two",)]
    kv = spark.createDataFrame([("seq1", "v$1")], "k string, v string")
    miss = {"replace": "? two", "keep_key": "seq2 two", "untouched": "seq2 two"}
    for on_miss, second in miss.items():
        got = rows(O.replace(df, r"^(\w+)", "{kv}", kv=kv, on_miss=on_miss, miss_text="?"), "name", "id")
        assert got == [("v$1 one", "v$1"), (second, second.split()[0])]
    with pytest.raises(Exception, match="more than once"):
        O.replace(df, r"(\w+)", "{kv}", kv=kv).collect()
    with pytest.raises(ValueError):
        O.replace(df, "")


def test_seq_filters_and_gaps(spark):
    df = records(spark, [("a", "AC-G", "I!5?"), ("b", "", ""), ("c", "acgu", "IIII")])
    assert rows(O.seq(df, remove_gaps=True), "seq", "qual")[0] == ("ACG", "I!?")
    assert rows(O.seq(df, min_len=1, max_len=4, case="upper", to="dna"), "seq") == [("AC-G",), ("ACGT",)]
    assert rows(O.seq(df, min_qual=30), "id") == [("c",)]
    assert rows(O.seq(df, only="qual"), "value") == [("I!5?",), ("",), ("IIII",)]
    with pytest.raises(ValueError):
        O.seq(df, min_len=5, max_len=3)
    with pytest.raises(Exception, match="letters not of dna"):
        O.seq(df, validate=True, seq_type="dna").collect()


@pytest.mark.parametrize("n", [1, 7])
def test_grep(spark, n):
    df = records(spark, [("a x", "ACGTAC"), ("b y", "GTACGTA"), ("a z", "TTTTT"), ("C", "")], n)
    assert rows(O.grep(df, ["a"]), "ordinal") == [(0,), (2,)]
    assert rows(O.grep(df, ["a"], invert=True), "ordinal") == [(1,), (3,)]
    assert rows(O.grep(df, ["c"], ignore_case=True), "ordinal") == [(3,)]
    assert rows(O.grep(df, ["AAAAA"], by="seq"), "ordinal") == [(2,)]
    assert rows(O.grep(df, ["AAAAA"], by="seq", both_strands=False), "ordinal") == []
    assert rows(O.grep(df, ["ACAC"], by="seq", circular=True, both_strands=False), "ordinal") == [(0,)]
    assert rows(O.grep(df, ["GTTCGT"], max_mismatch=1, both_strands=False), "ordinal") == [(1,)]
    assert rows(O.grep(df, ["AC"], region="1:2", both_strands=False), "ordinal") == [(0,)]
    assert rows(O.grep(df, ["a"], first_per_pattern=True), "ordinal") == [(0,)]
    wanted = spark.createDataFrame([("a",), ("b",)], "pattern string")
    assert rows(O.grep(df, wanted, first_per_pattern=True), "ordinal") == [(0,), (1,)]
    assert O.grep_count(df, ["^[ab]"], mode="regexp").first().n == 3
    for bad in ({"patterns": []}, {"patterns": [""]}, {"patterns": ["A1"], "by": "seq"}, {"patterns": ["A"], "max_mismatch": 2}):
        with pytest.raises(ValueError):
            O.grep(df, **bad)


def naive_hits(seq, p):
    return [i + 1 for i in range(len(seq) - len(p) + 1) if seq[i : i + len(p)] == p]


def test_locate_against_loops(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice("ACGT") for _ in range(draw.randrange(60))) for _ in range(40)]
    df = records(spark, [(f"s{i}", t) for i, t in enumerate(texts)], 3)
    turned = str.maketrans("ACGT", "TGCA")
    want = set()
    for i, t in enumerate(texts):
        want |= {(f"s{i}", "+", b, b + 1) for b in naive_hits(t, "AC")}
        want |= {(f"s{i}", "-", len(t) - b, len(t) - b + 1) for b in naive_hits(t.translate(turned)[::-1], "AC")}
    found = O.locate(df, ["AC"])
    assert {(r.seq_id, r.strand, r.start, r.end) for r in found.collect()} == want
    assert found.where("matched <> 'AC'").count() == 0
    near = O.locate(df, ["ACGTA"], max_mismatch=2, both_strands=False)
    want = {(f"s{i}", b + 1) for i, t in enumerate(texts) for b in range(len(t) - 4) if sum(x != y for x, y in zip(t[b : b + 5], "ACGTA")) <= 2}
    assert {(r.seq_id, r.start) for r in near.collect()} == want
    greedy = O.locate(records(spark, [("a", "AAAAAAA")]), ["AA"], non_greedy=True, both_strands=False)
    assert sorted(r.start for r in greedy.collect()) == [1, 4]
    ring = O.locate(records(spark, [("a", "CAAAT")]), ["TC"], circular=True)
    assert [(r.start, r.end, r.strand) for r in ring.collect()] == [(5, 6, "+")]
    assert O.locate(records(spark, [("a", "")]), ["A"]).count() == 0


def test_more_patterns_than_a_block(spark, monkeypatch):
    monkeypatch.setattr("seqloom.operators.search.INLINE", 2)
    df = records(spark, [("a", "AACC"), ("b", "GGTA"), ("c", "TTTT"), ("d", "CACA")], 3)
    file = records(spark, [("p", "GGG"), ("q", "GGT"), ("p", "AAC"), ("r", "TTT"), ("s", "CAC"), ("t", "ATG")], 1)
    found = O.locate(df, file, both_strands=False)
    assert sorted((r.seq_id, r.pattern_name, r.start) for r in found.collect()) == [("a", "p", 1), ("b", "q", 1), ("c", "r", 1), ("c", "r", 2), ("d", "s", 1)]
    wanted = ["GGT", "AAC", "CAC", "AA", "CCCC", "GGT"]
    for patterns in (wanted, spark.createDataFrame([(p,) for p in wanted], "pattern string")):
        grep = lambda **options: rows(O.grep(df, patterns, both_strands=False, **options), "ordinal")  # noqa: B023, E731
        assert grep(by="seq") == [(0,), (1,), (3,)] and grep(by="seq", invert=True) == [(2,)]
        assert grep(by="seq", first_per_pattern=True) == [(0,), (1,), (3,)]
    assert rows(O.grep(df, ["^a", "x", "y", "[cd]$"], mode="regexp"), "ordinal") == [(0,), (2,), (3,)]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("v") if n else F.array().cast("array<int>").alias("v"))
    assert df.select(S.running_sums(F.col("v"), 5).alias("s")).first().s == [5 + i * (i + 1) // 2 for i in range(1, n + 1)]


def test_two_inputs(spark):
    a = records(spark, [("x one", "AC", "II"), ("x two", "GG", "II"), ("y three", "T", "I")], 3)
    b = records(spark, [("x four", "TT", "55"), ("z five", "CCC", "555")], 2)
    assert sorted(r.seq for r in O.concat(a, b).collect()) == ["ACTT", "GGTT"]
    assert sorted((r.name, r.seq) for r in O.concat(a, b, full=True).collect()) == [("x one|four", "ACTT"), ("x two|four", "GGTT"), ("y three", "T"), ("z five", "CCC")]
    assert [(r.r1.seq, r.r2.seq) for r in O.pair(a, b).collect()] == [("AC", "TT")]
    assert sorted((r.side, r.id) for r in O.unpaired(a, b).collect()) == [(1, "x"), (1, "y"), (2, "z")]
    assert [r.seq for r in O.pick(O.pair(a, b), 1).collect()] == ["TT"]
    assert rows(O.common(a, b), "ordinal") == [(0,), (1,)]
    fq = records(spark, [("r", "AACCGG", "123456")])
    assert rows(O.fa2fq(fq, records(spark, [("r", "CCG")])), "seq", "qual") == [("CCG", "345")]
    assert rows(O.fa2fq(fq, records(spark, [("r", "GGTT")])), "seq", "qual") == [("GGTT", "4321")]
    assert O.fa2fq(fq, records(spark, [("r", "GGTT")]), both_strands=False).count() == 0


def test_features_and_regions(spark):
    df = records(spark, [("Chr1", "AACCGGTTAC")])
    spots = spark.createDataFrame([("chr1", 3, 5, "f", "+"), ("chr1", 3, 5, "g", "-"), ("chr1", 1, 2, None, None)], "chr string, s long, e long, feat string, strand string")
    got = {(r.name, r.seq) for r in O.subseq_features(df, spots, up=1, down=20).collect()}
    assert got == {("Chr1_3-5:+_us:1_ds:20 f", "ACCGGTTAC"), ("Chr1_3-5:-_us:1_ds:20 g", "CCGGTT"), ("Chr1_1-2:._us:1_ds:20 ", "AACCGGTTAC")}
    flank = {(r.name, r.seq) for r in O.subseq_features(df, spots, up=2, only_flank=True).collect()}
    assert flank == {("Chr1_3-5:+_usf:2 f", "AA"), ("Chr1_3-5:-_usf:2 g", "AC"), ("Chr1_1-2:._usf:2 ", "")}
    with pytest.raises(ValueError):
        O.subseq_features(df, spots, only_flank=True)
    got = {r.region: (r.head, r.seq) for r in O.faidx_query(df, ["Chr1:2-4", "Chr1:4-2", "Chr1", "Chr1:3-", "Chr1:-2", "Chr1:3", "chr1"]).collect()}
    assert got == {"Chr1:2-4": ("Chr1:2-4", "ACC"), "Chr1:4-2": ("Chr1:4-2", "GGT"), "Chr1": ("Chr1", "AACCGGTTAC"), "Chr1:3-": ("Chr1", "CCGGTTAC"), "Chr1:-2": ("Chr1:1-2", "AA"), "Chr1:3": ("Chr1:3-3", "C")}


@pytest.mark.parametrize("n", [1, 7])
def test_order(spark, n):
    df = records(spark, [(f"a{i} s t", "A" * (i % 4)) for i in (10, 9, 100, 1)], n)
    assert [r.id for r in O.sort(df).collect()] == ["a1", "a10", "a100", "a9"]
    assert [r.id for r in O.sort(df, natural=True).collect()] == ["a1", "a9", "a10", "a100"]
    assert [r.id for r in O.sort(df, by="length", reverse=True).collect()] == ["a10", "a9", "a1", "a100"]
    assert [r["rank"] for r in O.order.with_rank(O.sort(df).select("ordinal")).orderBy("rank").collect()] == [1, 2, 3, 4]
    for span, want in (("1:2", [0, 1]), ("-2:-1", [2, 3]), ("2:-2", [1, 2]), ("3:10", [2, 3]), ("-10:-4", [0])):
        assert [x for (x,) in rows(O.record_range(df, span), "ordinal")] == want
    with pytest.raises(ValueError):
        O.record_range(df, "3:2")
    assert rows(O.head(df, 2), "id") == [("a10",), ("a9",)]
    assert O.duplicate(df, 3).count() == 12
    assert rows(O.union(df, df, ordered=True), "ordinal") == [(i,) for i in range(8)]
    assert {r.id for r in O.sample(df, proportion=0.5).collect()} == {r.id for r in O.sample(df.repartition(3), proportion=0.5).collect()}
    assert sorted(r.id for r in O.shuffle(df).collect()) == ["a1", "a10", "a100", "a9"]


def test_head_genome(spark):
    heads = ["Staph aureus strain A c1", "Staph aureus strain A c2", "Staph aureus strain A c3", "Staph aureus strain B c1", "Staph aureus strain A c4"]
    df = records(spark, [(f"n{i} {h}", "A") for i, h in enumerate(heads)], 3)
    assert rows(O.head_genome(df), "ordinal") == [(0,), (1,), (2,)]
    assert rows(O.head_genome(df, 5), "ordinal") == [(0,)]
    with pytest.raises(Exception, match="without description"):
        O.head_genome(records(spark, [("a b", "A"), ("c", "A")])).collect()


def test_stats(spark):
    df = records(spark, [(f"s{i}", "ACGT-A"[:0] + "A" * n) for i, n in enumerate((10, 20, 30, 40))], 2)
    got = O.stats(df, all=True).first()
    assert (got.format, got.type, got.num_seqs, got.sum_len, got.min_len, got.avg_len, got.max_len) == ("FASTA", "DNA", 4, 100, 10, 25.0, 40)
    assert (got.Q1, got.Q2, got.Q3, got.N50, got.L50) == (15.0, 25.0, 35.0, 30, 2)
    odd = O.stats(records(spark, [(f"s{i}", "A" * n) for i, n in enumerate((1, 2, 3, 4, 5))]), all=True).first()
    assert (odd.Q1, odd.Q2, odd.Q3) == (2.0, 3.0, 4.0)
    qual = O.stats(records(spark, [("a", "ACGT", "5?I#")]), all=True).first()
    assert (qual.Q20, qual.Q30, qual.format) == (75.0, 50.0, "FASTQ")
    none = O.stats(records(spark, []), all=True).first()
    assert (none.num_seqs, none.sum_len, none.Q2, none.N50, none.type) == (0, 0, 0.0, 0, "")


def test_headers(spark):
    heads = ["a  two spaces", "b\ttab then space x", "c", "gi|110645304|ref|NC_002516.2| Pseudomonas"]
    df = spark.createDataFrame([(h,) for h in heads], "name string")
    got = [tuple(r) for r in df.select(*S.parse_header(F.col("name"))).collect()]
    assert got[:1] == [("a", "two spaces")] and got[2] == ("c", "")
    assert got[1] == ("b\ttab", "then space x")
    assert df.select(S.parse_header(F.col("name"), ncbi=True)[0].alias("i")).collect()[3].i == "NC_002516.2"
    with pytest.raises(ValueError):
        S.parse_header(F.col("name"), "^abc")


def test_properties(spark):
    draw = random.Random(9)
    df = records(spark, [(f"r{i % 20} x", "".join(draw.choice("ACGTN") for _ in range(draw.randrange(40)))) for i in range(80)], 5)
    both = O.seq(O.seq(df, reverse=True, complement=True), reverse=True, complement=True)
    assert rows(both, "seq") == rows(df, "seq")
    for options in ({"patterns": ["r3"]}, {"patterns": ["AC"], "by": "seq"}, {"patterns": ["A.C"], "by": "seq", "mode": "regexp"}):
        assert O.grep(df, **options).count() + O.grep(df, **options, invert=True).count() == 80
    assert O.rmdup(df, by="seq").count() + O.rmdup_removed(df, by="seq").count() == 80
    other = df.where("ordinal % 3 = 0")
    assert 2 * O.pair(df, other).count() + O.unpaired(df, other).count() == 80 + other.count()
    renamed = O.rename(df)
    assert renamed.select("id").distinct().count() == 80


@pytest.mark.parametrize("full", [False, True])
def test_concat_of_a_frequent_id_is_dealt_out(spark, monkeypatch, full):
    """All pairs once and nothing else, and no partition with most of them."""
    for name, value in (("CELL", 8), ("TASK_PAIRS", 64)):
        monkeypatch.setattr(join, name, value, raising=False)
    rows = lambda spec: spark.createDataFrame([(i, x, f"{x} d{i}", f"d{i}", "A" * (i % 5), "I" * (i % 5)) for i, x in enumerate(spec)], "ordinal long, id string, name string, descr string, seq string, qual string")
    one, two = [*["hot"] * 40, *["left"] * 20, "both", None], [*["hot"] * 50, *["right"] * 20, "both", "both", None]
    want = [(i, k) for i, x in enumerate(one) for k, y in enumerate(two) if x is not None and x == y]
    if full:
        want += [(i, None) for i, x in enumerate(one) if x in ("left", None)] + [(k, k) for k, y in enumerate(two) if y in ("right", None)]
    got = O.concat(rows(one), rows(two), full=full).withColumn("p", F.spark_partition_id()).collect()
    assert sorted((r.ordinal, -1 if r.ordinal_b is None else r.ordinal_b) for r in got) == sorted((i, -1 if k is None else k) for i, k in want)
    assert all(r.seq == "A" * (r.ordinal % 5 + r.ordinal_b % 5) and r.name == f"{r.id} d{r.ordinal}|d{r.ordinal_b}" for r in got if r.id in ("hot", "both"))
    assert max(Counter(r.p for r in got).values()) < len(got) / 2
