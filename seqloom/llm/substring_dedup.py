"""Removal of word sequences that an earlier document holds, over a compacted de Bruijn graph."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import wordhash
from seqloom.llm.common import KeySet, Scratch, bound_batches, checkpointed, lean

STEP = wordhash.WORD_STEP
UNSTEP = np.uint64(pow(int(STEP), -1, 1 << 64))
CORE = 4


class Paths:
    """The windows of some texts, cut into chunks: maximal runs of windows with the same least core hash.

    A window is k words, an edge of the graph. Its core is the smallest hash among its runs of CORE words, so equal
    windows have equal cores, wherever they stand; a chunk is a short path of edges that share a core. Word hashes are
    cut to `hash_bits`, for tests.
    """

    def __init__(self, texts: pa.Array, k: int, hash_bits: int = 64):
        data, offsets = wordhash.buffers(texts)
        starts, ends, first = wordhash.find_words(data, offsets)
        self.words, self.first = wordhash.hash_words(data, starts, ends) & np.uint64((1 << hash_bits) - 1), first
        n = max(len(self.words) - k + 1, 0)
        low = wordhash.hash_runs(self.words, CORE)
        span = k - CORE + 1
        width = 1
        while 2 * width <= span and len(low):
            low = np.minimum(low[: max(len(low) - width, 0)], low[width:])
            width *= 2
        core = np.minimum(low[:n], low[span - width : span - width + n]) if n else low[:0]
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
        at = np.flatnonzero(np.arange(n) + k <= first[doc + 1]) if n else np.zeros(0, np.int64)
        core, doc = core[at], doc[at]
        new = np.ones(len(at), bool)
        new[1:] = (core[1:] != core[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        self.at, self.doc, self.core = at[head], doc[head], core[head].view(np.int64)
        self.size = np.diff(np.append(head, len(at)))
        self.start = self.at - first[self.doc]
        self.k = k

    def path_hashes(self) -> np.ndarray:
        """Hash of all words of each chunk."""
        up = wordhash.powers(STEP, len(self.words))
        sums = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(self.words * up[: len(self.words)], out=sums[1:])
        down = wordhash.powers(UNSTEP, len(self.words))
        to = self.at + self.size + self.k - 1
        return wordhash.mixed((sums[to] - sums[self.at]) * down[self.at] + self.size.astype(np.uint64) * wordhash.MIX_1).view(np.int64)

    def window_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of all chunks, and where each chunk's begin."""
        edges = wordhash.hash_runs(self.words, self.k)
        begins = np.concatenate([[0], np.cumsum(self.size)])
        place = np.arange(begins[-1]) - np.repeat(begins[:-1], self.size)
        return edges[np.repeat(self.at, self.size) + place].view(np.int64), begins


def _cores(k: int, hash_bits: int):
    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("__id").to_numpy(zero_copy_only=False), batch.column("__text")
            for at, to in wordhash.in_parts(texts):
                paths = Paths(texts[at:to], k, hash_bits)
                owner = ids[at:to][paths.doc]
                order = np.argsort(paths.core, kind="stable")
                core, owner = paths.core[order], owner[order]
                if len(core):
                    head = np.flatnonzero(np.append(True, core[1:] != core[:-1]))
                    yield pa.RecordBatch.from_arrays([pa.array(core[head]), pa.array(np.minimum.reduceat(owner, head)), pa.array(np.maximum.reduceat(owner, head))], names=["__core", "__lo", "__hi"])

    return cores


def _chunks(k: int, windows: bool, hash_bits: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, texts = batch.column("__id").to_numpy(zero_copy_only=False), batch.column("__mark").to_numpy(zero_copy_only=False), batch.column("__text")
            for at, to in wordhash.in_parts(texts):
                paths = Paths(texts[at:to], k, hash_bits)
                columns = [paths.core, paths.path_hashes(), ids[at:to][paths.doc], marks[at:to][paths.doc], paths.start.astype(np.int32), paths.size.astype(np.int32)]
                names = ["__core", "__path", "__id", "__mark", "__start", "__size"]
                columns = [pa.array(c) for c in columns]
                if windows:
                    edges, begins = paths.window_hashes()
                    columns.append(pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(edges)))
                    names.append("__edges")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return chunks


CHUNK = "__core long, __path long, __id long, __mark long, __start int, __size int"


def _cut(k: int, others: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("__text"), batch.column("__spans")
            for at, to in wordhash.in_parts(texts):
                part = texts[at:to]
                data, offsets = wordhash.buffers(part)
                starts, ends, first = wordhash.find_words(data, offsets)
                raw, kept, counts, removed, runs = data.tobytes(), [], [], [], []
                for a, b, span in zip(first[:-1], first[1:], spans[at:to]):
                    gone = np.zeros(b - a + 1, np.int64)
                    if span.is_valid and len(span.values):
                        s, n = (span.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "size"))
                        np.add.at(gone, s, 1)
                        np.add.at(gone, np.minimum(s + n + (k - 1), b - a), -1)
                        gone = np.cumsum(gone) > 0
                        gone[-1] = False
                    else:
                        gone = gone > 0
                    keep = np.flatnonzero(~gone[:-1]) + a
                    kept.append(b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())]).decode())
                    counts.append(b - a)
                    removed.append(b - a - len(keep))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    runs.append([{"start": int(x), "stop": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                rest = [batch.column(c)[at:to] for c in others]
                found = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*rest, *found], names=[*others, "n_words", "n_removed", "spans", "kept_text"])

    return cut


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128 bits of the words that stand at each place asked for."""
    for batch in batches:
        texts, asked = batch.column("__text"), batch.column("__asked")
        for at, to in wordhash.in_parts(texts):
            data, offsets = wordhash.buffers(texts[at:to])
            starts, ends, first = wordhash.find_words(data, offsets)
            raw, rows, found = data.tobytes(), [], []
            for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
                words = [raw[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                whole = b" ".join(words)
                place = np.concatenate([[0], np.cumsum(ends[a:b] - starts[a:b] + 1)])
                for want in asked[at + i].as_py():
                    x, n = want["start"], want["n"]
                    rows.append((at + i, x, n))
                    found.append(hashlib.md5(whole[place[x] : place[x + n] - 1], usedforsecurity=False).digest() if x + n <= b - a else None)
            row = pa.array([r[0] for r in rows], pa.int64())
            columns = [batch.column("__id").take(row), batch.column("__mark").take(row), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["__id", "__mark", "__start", "__n", "__digest"])


def _words_at(named: DataFrame, places: DataFrame, scratch: Scratch) -> DataFrame:
    """places: __id, __mark, __start, __n. Adds __digest; only documents with a place are read."""
    asked = places.distinct().groupBy("__id", "__mark").agg(F.collect_list(F.struct(F.col("__start").alias("start"), F.col("__n").alias("n"))).alias("__asked"))
    asked = scratch.keep(asked)
    known = KeySet(asked.select(F.xxhash64("__id", "__mark").alias("h")))
    texts = known.filtered(named, F.xxhash64("__id", "__mark")).dropDuplicates(["__id", "__mark"]).join(asked, ["__id", "__mark"])
    return scratch.keep(texts.mapInArrow(lean(_digests), "__id long, __mark long, __start int, __n int, __digest binary"))


SPAN = ["__id", "__mark", "__start", "__size", "__source", "__source_mark", "__source_start"]


def _first(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of each key that several documents hold, the smallest document and a place of it there."""
    place = [F.min("__id").alias("__source"), F.min_by("__mark", "__id").alias("__source_mark"), F.min_by("__start", "__id").alias("__source_start"), F.max("__id").alias("__last")]
    return rows.groupBy(*key).agg(*place)


def _compacted(rows: DataFrame) -> DataFrame:
    """Joins nonbranching paths: rows are chunks (__path_id) that several documents hold, with their source; returns SPAN of those that are not the source.

    Two chunks become one path if each occurrence of the first is followed by the second, and each of the second preceded by the first.
    Both are then held by the same documents, and have the same source.
    """
    in_doc = Window.partitionBy("__id", "__mark").orderBy("__start")
    follows = F.lead("__start").over(in_doc) == F.col("__start") + F.col("__size")
    led = F.lag("__start").over(in_doc) + F.lag("__size").over(in_doc) == F.col("__start")
    rows = rows.withColumns({"__next": F.when(follows, F.lead("__path_id").over(in_doc)), "__prev": F.when(led, F.lag("__path_id").over(in_doc))})
    only = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c))
    degrees = rows.groupBy("__path_id").agg(only("__next").alias("__only_next"), only("__prev").alias("__only_prev"))
    later = rows.where("__source < __id").join(degrees, "__path_id")
    joined = (F.col("__only_prev") == F.col("__prev")) & (F.lag("__only_next").over(in_doc) == F.col("__path_id"))
    runs = later.withColumn("__breaks", F.when(joined, 0).otherwise(1)).withColumn("__run", F.sum("__breaks").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy("__id", "__mark", "__run").agg(
        F.min("__start").alias("__first"), F.sum("__size").cast("int").alias("__size"), F.min("__source").alias("__source"), F.min_by("__source_mark", "__start").alias("__source_mark"), F.min_by("__source_start", "__start").alias("__source_start")
    )
    return whole.withColumnRenamed("__first", "__start").select(*SPAN)


def _runs_of_edges(rows: DataFrame) -> DataFrame:
    """SPAN of single edges that follow each other here and in their source."""
    by = ["__id", "__mark", "__source", "__source_mark", "__shift"]
    rows = rows.withColumn("__shift", F.col("__start") - F.col("__source_start"))
    rows = rows.withColumn("__run", F.col("__start") - F.row_number().over(Window.partitionBy(*by).orderBy("__start")))
    return rows.groupBy(*by, "__run").agg(F.min("__start").alias("__start"), F.count("*").cast("int").alias("__size"), F.min("__source_start").alias("__source_start")).select(*SPAN)


def _repeats(named: DataFrame, chunks: DataFrame, k: int, hash_bits: int, scratch: Scratch) -> DataFrame:
    """SPAN of the windows that a smaller document holds too, going by hashes."""
    paths = scratch.keep(_first(chunks, ["__core", "__path"]))
    several = scratch.keep(paths.where("__source < __last").drop("__last"))
    rows = scratch.keep(chunks.join(several, ["__core", "__path"]).withColumn("__path_id", F.xxhash64("__core", "__path")).drop("__core", "__path"))
    settled = scratch.keep(_compacted(rows))
    scratch.drop(rows, several)

    # cores with paths of several sources: where the graph branches, edges are looked up one by one, in one document for each path
    branching = scratch.keep(paths.groupBy("__core").agg(F.min("__source").alias("lo"), F.max("__source").alias("hi")).where("lo < hi").select("__core"))
    sources = scratch.keep(paths.join(branching, "__core", "left_semi").select("__core", "__path", F.col("__source").alias("__id")))
    scratch.drop(paths)
    places = KeySet(sources.select(F.xxhash64("__core", "__path", "__id").alias("h")))
    found = named.mapInArrow(lean(_chunks(k, True, hash_bits)), CHUNK + ", __edges array<long>")
    found = places.filtered(found, F.xxhash64("__core", "__path", "__id")).join(sources, ["__core", "__path", "__id"], "left_semi")
    edges = scratch.keep(found.select("__core", "__id", "__mark", F.col("__start").alias("__at"), F.posexplode("__edges").alias("__place", "__edge")).select("__core", "__edge", "__id", "__mark", (F.col("__at") + F.col("__place")).alias("__start")))
    firsts = scratch.keep(_first(edges, ["__core", "__edge"]).where("__source < __last").drop("__last"))
    single = edges.join(firsts, ["__core", "__edge"]).where("__source < __id")
    out = scratch.keep(settled.unionByName(_runs_of_edges(single.drop("__core", "__edge"))))
    scratch.drop(settled, edges, firsts, sources, branching)
    return out


def _unlike(named: DataFrame, spans: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """The spans whose words differ from those at the source's coordinates."""
    n = (F.col("__size") + (k - 1)).cast("int").alias("__n")
    here = spans.select("__id", "__mark", "__start", n)
    there = spans.select(F.col("__source").alias("__id"), F.col("__source_mark").alias("__mark"), F.col("__source_start").alias("__start"), n)
    known = _words_at(named, here.union(there), scratch)
    told = spans.withColumn("__n", n).join(known, ["__id", "__mark", "__start", "__n"], "left")
    of_source = known.select(F.col("__id").alias("__source"), F.col("__mark").alias("__source_mark"), F.col("__start").alias("__source_start"), "__n", F.col("__digest").alias("__wanted"))
    told = told.join(of_source, ["__source", "__source_mark", "__source_start", "__n"], "left")
    found = scratch.keep(told.where(~F.coalesce(F.col("__digest") == F.col("__wanted"), F.lit(False))).select("__id", "__mark", "__start", "__size"))
    scratch.drop(known)
    return found


def _spans(named: DataFrame, k: int, hash_bits: int, scratch: Scratch) -> DataFrame:
    """__id, __mark, __spans: the windows to remove from each document, as (start, number of windows)."""
    cores = named.mapInArrow(lean(_cores(k, hash_bits)), "__core long, __lo long, __hi long")
    shared = scratch.keep(cores.groupBy("__core").agg(F.min("__lo").alias("lo"), F.max("__hi").alias("hi")).where("lo < hi").select("__core"))
    chunks = scratch.keep(KeySet(shared).filtered(named.mapInArrow(lean(_chunks(k, False, hash_bits)), CHUNK), F.col("__core")))
    scratch.drop(shared)
    scratch.sweep()
    doubtful, trusted = None, chunks
    while True:
        spans = _repeats(named, trusted, k, hash_bits, scratch)
        unlike = _unlike(named, spans, k, scratch)
        if not unlike.limit(1).count():
            break
        # hashes of different words have met: the cores around are settled by their words
        wrong = unlike.select("__id", "__mark", F.col("__start").alias("__from"), (F.col("__start") + F.col("__size")).alias("__to"))
        cores = trusted.join(wrong, ["__id", "__mark"]).where("__start < __to and __start + __size > __from").select("__core").distinct()
        doubtful = scratch.keep(cores if doubtful is None else cores.union(doubtful))
        trusted = scratch.keep(chunks.join(doubtful, "__core", "left_anti"))
    spans = spans.select("__id", "__mark", "__start", "__size")
    if doubtful is not None:
        windows = chunks.join(doubtful, "__core", "left_semi").select("__id", "__mark", F.explode(F.sequence("__start", F.col("__start") + F.col("__size") - 1)).alias("__start"), F.lit(k).alias("__n"))
        words = _words_at(named, windows, scratch)
        first = scratch.keep(words.groupBy("__digest").agg(F.min("__id").alias("__source"), F.max("__id").alias("__last")).where("__source < __last"))
        spans = spans.union(words.join(first, "__digest").where("__source < __id").select("__id", "__mark", "__start", F.lit(1).alias("__size")))
    span = F.struct(F.col("__start").alias("start"), F.col("__size").alias("size"))
    return spans.groupBy("__id", "__mark").agg(F.collect_list(span).alias("__spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, columns: list[str] | None = None, hash_bits: int = 64) -> DataFrame:
    """Removes every word that is covered by a window of k words which also starts in a document with a smaller id.

    Windows are the edges of a de Bruijn graph over words. They are bucketed by their core (see Paths), and edges that
    follow each other with the same core are taken as chunks, so that Spark handles short paths, not edges.
    1. Chunks of cores that one document alone holds are dropped, through a bit set that follows the number of cores.
    2. Chunks that are equal in all words are joined on core and path hash, with the smallest document as their source. Their
       degrees, the chunks before and behind them in all documents, are counted, and paths that don't branch are compacted.
    3. Cores whose chunks differ between documents, the branching places, are resolved edge by edge.
    4. Each span is verified against its source by coordinates: 128 bits of the words here and there. Where they differ, which takes
       a collision of 64-bit hashes, the cores around are settled by the words of their windows instead.
    5. The spans of a document are applied to its words; documents without any are not shuffled for it.

    Returns the input's columns (or those in `columns`) plus n_words, n_removed, spans (array of word ranges, stop excluded) and
    kept_text (words kept, joined by one space); input columns with these names are replaced. Ids are whole numbers. Documents
    with a null id neither lose words nor make others lose them. Rows that repeat an id don't remove each other's words.
    Null and empty texts have no words. An empty table gives an empty table. `hash_bits` is there for tests.
    """
    if k <= CORE:
        raise ValueError(f"k must be above {CORE}")
    added = ["n_words", "n_removed", "spans", "kept_text"]
    kept = [c for c in (docs.columns if columns is None else columns) if c not in added]
    own = [F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("__mark"), F.col(text_col).cast("string").alias("__text")]
    with bound_batches(docs.sparkSession), Scratch(docs.sparkSession) as scratch:
        spans = checkpointed(_spans(docs.select(*own).where("__id is not null"), k, hash_bits, scratch))
    whole = docs.select(*own, *[F.col(c).alias(f"__c{i}") for i, c in enumerate(kept)])
    others = [f"__c{i}" for i in range(len(kept))]
    held = KeySet(spans.select(F.xxhash64("__id", "__mark").alias("h")))
    marked = held.marked(whole, F.xxhash64("__id", "__mark"), "__open")
    joined = marked.where("__open").join(spans, ["__id", "__mark"], "left").select("__text", "__spans", *others)
    joined = joined.unionByName(marked.where("not __open").select("__text", F.lit(None).cast(joined.schema["__spans"].dataType).alias("__spans"), *others))
    schema = joined.select(*others).schema.add("n_words", "long").add("n_removed", "long").add("spans", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType()))).add("kept_text", "string")
    return joined.mapInArrow(lean(_cut(k, others)), schema).withColumnsRenamed(dict(zip(others, kept)))
