from seqloom import operators as O
from seqloom.streaming import dedup_stream, stream_fasta


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fa").write_text(">a x\nACG\nT\n>b\nAAAA\n")
    (folder / "b.fa").write_text(">c\nTTTT\n")
    found = dedup_stream(O.seq(stream_fasta(spark, str(folder), files_per_trigger=1), min_len=2))
    run = found.writeStream.format("memory").queryName("records").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    got = spark.sql("select id, seq from records").collect()
    assert {r.seq for r in got} in ({"ACGT", "AAAA"}, {"ACGT", "TTTT"}) and len(got) == 2
