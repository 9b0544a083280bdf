"""The pipeline's stages against brute force on a small corpus."""

import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm.common import scratch_folder
from seqloom.llm.queries import QUERIES, SQL

from .test_text import brute_near, tokenizer


def corpus(folder, spark):
    draw = random.Random(8)
    words = {"en": "the and of house water with this that", "de": "der und die haus wasser nicht mit auch"}
    items = [(i, " ".join(f"item{draw.randrange(90)}" for _ in range(12))) for i in range(5)]
    rows = []
    for i in range(150):
        lang = draw.choice(sorted(words))
        text = " ".join(draw.choice(words[lang].split()) + (str(draw.randrange(9)) if j % 3 == 0 else "") for j in range(draw.randrange(30, 120)))
        if i % 15 == 0:
            text += " " + items[i % 5][1] + " and"
        rows.append((i, text, lang if i % 7 else None, f"s{draw.randrange(4)}", len(text)))
    rows += [(200 + i, rows[i][1].upper(), rows[i][2], "s9", 5) for i in range(20)] + [(300, None, None, None, None), (301, "12 34", "en", "s1", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows, items = corpus(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "tokens":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            steps[name] = [r.doc_id for r in docs.collect()]
    assert sorted(steps["language"]) == sorted(d for d in texts if d not in (300, 301))
    near = brute_near([(d, texts[d]) for d in steps["language"]], 5, 80)
    assert sorted(steps["near_dedup"]) == sorted(d for d, _, _, kept in near if kept)
    sh = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    clean = [d for d in steps["near_dedup"] if not any(len(sh(texts[d]) & sh(t)) >= 0.8 * len(sh(t)) for _, t in items)]
    assert sorted(steps["decontaminate"]) == sorted(clean) and len(clean) < len(steps["near_dedup"])
    assert set(steps["mix"]) <= set(clean) and max(Counter(steps["mix"]).values()) <= 2
    got = Counter((r.doc_id, r.n_tokens) for r in out.collect())
    model = tokenizer()
    assert got == Counter((d, len(model.encode(texts[d], add_special_tokens=False)) + 1) for d in steps["mix"])
    assert Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect()) == got


def test_stages_keep_columns_and_run_on_nothing(spark, tmp_path):
    """Columns with the operators' own names come back as they were; empty tables go through."""
    folder = str(tmp_path / "in")
    corpus(folder, spark)
    clash = ["score", "lang_pred", "size", "source_size", "target", "copies", "copy", "kept", "__row"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40).select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in clash])
    docs.write.parquet(f"{tmp_path}/clash")
    docs = spark.read.parquet(f"{tmp_path}/clash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in clash), name
    empty = str(tmp_path / "empty")
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.decontaminate(spark, docs, empty).count() == docs.count()
    left = [f for f in os.listdir(scratch_folder(spark).removeprefix("file:")) if f.startswith(("pipeline-", "tables-", "token-ids-"))]
    assert not left


def test_stages_return_heap(spark, tmp_path, monkeypatch):
    """Each stage has the executors' heap collected before its own work; here they share the driver's JVM."""
    folder = str(tmp_path / "in")
    corpus(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans

    def full() -> int:
        return sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())

    calls = []
    give_back = corpus_pipeline.give_back
    monkeypatch.setattr(corpus_pipeline, "give_back", lambda s: calls.append(-full()) or give_back(s) or calls.append(full()))
    for _, stage in corpus_pipeline.STAGES:
        calls.clear()
        stage(spark, docs, folder)
        assert len(calls) == 2 and sum(calls) > 0


def test_queries_without_sql(spark, tmp_path):
    """The registered op2, op3, op4 and op6 against plain Python."""
    folder = str(tmp_path / "in")
    rows, _ = corpus(folder, spark)
    urls = ["http://A.Example.NET/en/x?q=1#f", "https://www.example.com/de/a", "http://b.org/fr/", "http://c.net/x", None, "no url", "http://d.info/win?a=1&b=2", "http://e.edu/"]
    spark.createDataFrame([(i, u, "<html>") for i, u in enumerate(urls * 5)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    texts = {r[0]: r[1] or "" for r in rows}

    got = QUERIES["op2_sharding"](spark, folder)
    assert set(got.columns) >= {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    got = got.collect()
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == {(d, len(t.encode()) + 16, zlib.crc32(t.encode()), "rows", None) for d, t in texts.items()}
    counts = Counter(r.shard for r in got)
    assert sorted(counts) == list(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(40) for i in range(counts[s])]

    model = tokenizer()
    ids = {d: [*model.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    got = QUERIES["op3_token_output"](spark, folder).collect()
    start, want = 0, []
    for d in sorted(ids):
        want.append((d, start, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes())))
        start += len(ids[d])
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    got = QUERIES["op4_token_counts"](spark, folder).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [(d, len(texts[d].encode()), len(ids[d]) - 1, len(ids[d]) > 1025) for d in sorted(ids)]

    got = sorted(QUERIES["op6_url_filter"](spark, folder).collect(), key=lambda r: r.page_id)
    want = [("a.example.net", "/en/x", "example.net/en/", "allow"), ("www.example.com", "/de/a", "example.com/de/", "block"), ("b.org", "/fr/", "org/fr/", "allow"), ("c.net", "/x", "net/", "block")]
    assert [(r.host, r.path, r.rule, r.verdict) for r in got[:4]] == want
    assert [(r.host, r.path, r.rule) for r in got[4:8]] == [("", "", None), ("", "", None), ("d.info", "/win", None), ("e.edu", "/", None)]
    assert len(got) == 40 and {r.verdict for r in got} <= {"allow", "block"} and all(len({(r.host, r.verdict) for r in got[i::8]}) == 1 for i in range(8))


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11)) and set(SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "tokens"]


D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_held_out_accuracy(spark):
    found = QUERIES["op9_language_id"](spark, D).join(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right >= 0.95 * n


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = QUERIES[name](spark, D)
    columns = sorted(got.columns)
    plain = lambda rows: sorted(repr([round(float(x), 6) if isinstance(x, float) else x for x in r]) for r in rows)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert plain(got.select(*columns).collect()) == plain(want.select(*columns).fetchall())
