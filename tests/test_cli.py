import json

import pytest

from seqloom.plans.cli import main
from seqloom.plans.commands import COMMANDS, SHORT


def lines(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


@pytest.fixture
def fa(tmp_path):
    path = tmp_path / "a.fa"
    path.write_text(">s1 one\nACGTAC\n>s2 two\nTTTT\n>s1 again\nGTACGT\n")
    return str(path)


def test_commands(spark, fa, tmp_path, capsys):
    out = str(tmp_path / "out")
    go = lambda *argv: main([*argv, "-o", out, "--merge"], spark)
    go("seq", "--reverse", "--complement", fa)
    assert lines(spark, out) == [">s1 one", "GTACGT", ">s2 two", "AAAA", ">s1 again", "ACGTAC"]
    go("rmdup", "--by-seq", fa, "--dup-num-file", str(tmp_path / "num"), "--dup-seqs-file", str(tmp_path / "dup"))
    assert lines(spark, out) == [">s1 one", "ACGTAC", ">s2 two", "TTTT"]
    assert lines(spark, tmp_path / "num") == ["2\ts1, s1"] and lines(spark, tmp_path / "dup") == [">s1 again", "GTACGT"]
    go("grep", "--pattern", "s2", fa)
    assert lines(spark, out) == [">s2 two", "TTTT"]
    go("locate", "--pattern", "GTAC", "--bed", "--only-positive-strand", fa)
    assert sorted(lines(spark, out)) == ["s1\t0\t4\tGTAC\t0\t+", "s1\t2\t6\tGTAC\t0\t+"]
    go("faidx", fa, "s2:1-2")
    assert lines(spark, out) == [">s2:1-2", "TT"]
    go("translate", "--list-transl-table", "0")
    assert len(lines(spark, out)) == 24
    proteins = tmp_path / "p.fa"
    proteins.write_text(">p\nMKLEFQ\n>q\nQFELKM\n")
    go("grep", "--pattern", "FQ", "--by-seq", str(proteins))
    assert lines(spark, out) == [">p", "MKLEFQ"]
    with pytest.raises(ValueError, match="DNA and RNA"):
        go("translate", str(proteins))
    main(["stats", "--tabular", fa], spark)
    assert capsys.readouterr().out.splitlines()[1].split("\t")[1:5] == ["FASTA", "DNA", "3", "16"]
    with pytest.raises(ValueError):
        go("sample", "--proportion", "1", fa, fa)


def test_seq_validates_all_letters_and_knows_the_quality_base(spark, tmp_path):
    out, fa, fq = (str(tmp_path / n) for n in ("out", "long.fa", "b.fq"))
    (tmp_path / "long.fa").write_text(">s\n" + "ACGT" * 2500 + "!\n")
    (tmp_path / "b.fq").write_text("@a\nAC\n+\nhh\n@b\nAC\n+\nBB\n")
    main(["seq", "--validate-seq", fa, "-o", out, "--merge"], spark)
    with pytest.raises(Exception, match="letters not of dna"):
        main(["seq", "--validate-seq", "--validate-seq-length", "0", fa, "-o", out, "--merge"], spark)
    main(["seq", "--min-qual", "20", "--qual-ascii-base", "64", "--name", fq, "-o", out, "--merge"], spark)
    assert lines(spark, out) == ["a"]


def test_pipe(spark, fa, tmp_path):
    job = tmp_path / "job.json"
    job.write_text(json.dumps({"cmd": ["rename"], "pipe": [{"cmd": ["head", "--number", "3", fa]}]}))
    out = str(tmp_path / "out")
    main(["pipe", str(job), "-o", out, "--merge"], spark)
    assert [x for x in lines(spark, out) if x[0] == ">"] == [">s1 one", ">s2 two", ">s1_2 again"]


def test_every_command_is_there():
    assert len(COMMANDS) == 22


def test_short_options(spark, fa, tmp_path):
    out = str(tmp_path / "out")
    go = lambda *argv: main([*argv, "-o", out, "--merge"], spark)
    go("seq", "-r", "-p", "-l", "-m", "5", fa)
    assert lines(spark, out) == [">s1 one", "gtacgt", ">s1 again", "acgtac"]
    fq = tmp_path / "a.fq"
    fq.write_text("@a\nAC\n+\nhh\n@b\nAC\n+\nJJ\n")
    go("seq", "-b", "64", "-Q", "30", "-n", str(fq))
    assert lines(spark, out) == ["a"]
    long = tmp_path / "long.fa"
    long.write_text(">x\n" + "ACGT" * 3000 + "!\n")
    go("seq", "-v", "-n", str(long))
    assert lines(spark, out) == ["x"]
    with pytest.raises(Exception, match="letters not of dna"):
        go("seq", "-v", "-V", "0", "-s", str(long))
    go("grep", "-n", "-i", "-p", "S2 TWO", fa)
    assert lines(spark, out) == [">s2 two", "TTTT"]
    go("range", "-r", "2:2", fa)
    assert lines(spark, out) == [">s2 two", "TTTT"]
    for argv, option in ((("range", fa), "range"), (("fa2fq", str(fq)), "fasta-file")):
        with pytest.raises(ValueError, match=option):
            go(*argv)
    for name, short in SHORT.items():
        assert set(short) <= set(COMMANDS[name].options) and len(set(short.values())) == len(short)
