"""MinHash near-duplicates with sequential Bayesian verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import wordhash
from seqloom.llm.common import KeySet, Scratch, bound_batches, checkpointed, lean, quick_key, without
from seqloom.llm.graph import components


@dataclass(frozen=True)
class Settings:
    """Shingles of `words` words, similar from `percent` on; signatures of `n_hashes` in `bands`, compared `batch` at a time with at
    most `miss` as the chance to lose a pair; blocks of `block` rows. `key_bits` is there for tests."""

    words: int = 5
    percent: int = 80
    n_hashes: int = 128
    bands: int = 32
    batch: int = 16
    miss: float = 1e-6
    block: int = 512
    seed: int = 3
    key_bits: int = 64

    @property
    def least(self) -> list[int]:
        return least_matches(self.batch, self.n_hashes, self.percent / 100, self.miss)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles; of its whole word sequence if that is shorter."""
    for at, to in wordhash.in_parts(texts):
        data, offsets = wordhash.buffers(texts[at:to])
        starts, ends, first = wordhash.find_words(data, offsets)
        words = wordhash.hash_words(data, starts, ends, lower=True)
        runs = wordhash.hash_runs(words, k)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            else:
                yield wordhash.hash_runs(words[a:b], int(b - a)) if b > a else runs[:0]


def set_keys(values: np.ndarray, key_bits: int = 64) -> tuple[int, int]:
    """Two hashes of a whole set, 128 bits together; the first is cut to `key_bits`."""
    one, two = np.bitwise_xor.reduce(wordhash.mixed(values + np.uint64(7))), wordhash.mixed(values).sum(dtype=np.uint64)
    pair = np.array([one, two], np.uint64)
    n = np.uint64(len(values))
    first = wordhash.mixed(wordhash.mixed(pair[:1]) + pair[1:] + n) & np.uint64((1 << key_bits) - 1)
    second = wordhash.mixed(wordhash.mixed(pair[1:] + n) ^ pair[:1])
    return int(first.view(np.int64)[0]), int(second.view(np.int64)[0])


def multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(values: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 2048) -> np.ndarray:
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), step):
        hashed = values[at : at + step, None] * a
        hashed += b
        hashed >>= np.uint64(32)
        np.minimum(out, hashed.min(axis=0).astype(np.uint32), out=out)
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """sigs: (documents, bands, hashes of a band)."""
    keys = np.broadcast_to(np.arange(1, sigs.shape[1] + 1, dtype=np.uint64), sigs.shape[:2])
    for i in range(sigs.shape[2]):
        keys = wordhash.mixed(keys * wordhash.WORD_STEP + sigs[:, :, i])
    return keys.view(np.int64)


def least_matches(batch: int, n_hashes: int, similarity: float, miss: float) -> list[int]:
    """For each number of hashes compared (batch, 2 * batch, ...) the fewest matches that keep a pair.

    With m of n equal and a uniform prior the similarity is Beta(m + 1, n - m + 1); a pair is dropped when the
    posterior probability of at least `similarity` is below `miss`.
    """
    out = []
    for n in range(batch, n_hashes + 1, batch):
        total, m = 0.0, 0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return out


def _sketch(k: int, n_hashes: int, seed: int, key_bits: int, carried: list[str]):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers(n_hashes, seed)
        for batch in batches:
            sizes, keys, checks, sigs = [], [], [], []
            for values in shingle_sets(batch.column("__text"), k):
                key, check = set_keys(values, key_bits) if len(values) else (None, None)
                sizes.append(len(values)), keys.append(key), checks.append(check)
                sigs.append(signature(values, a, b).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(sigs, pa.binary())],
                names=[*carried, "__n", "__key", "__check", "__sig"],
            )

    return sketch


def _place(bands: int):
    """A row for each class and band: its bucket."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.repeat(batch.column("__key").to_numpy(), bands)
            sigs = np.frombuffer(b"".join(batch.column("__sig").to_pylist()), np.uint32).reshape(batch.num_rows, bands, -1)
            band = np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(band), pa.array(band_keys(sigs).ravel())], names=["__key", "__band", "__bucket"])

    return place


def _bayes(batch: int, least: list[int]):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            left, right = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint32).reshape(rows.num_rows, -1) for c in ("__sig_a", "__sig_b"))
            alive, matches = np.arange(rows.num_rows), np.zeros(rows.num_rows, np.int64)
            for i, need in enumerate(least):
                part = slice(i * batch, (i + 1) * batch)
                matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= need]
            yield pa.RecordBatch.from_arrays([rows.column(c).take(pa.array(alive)) for c in ("a", "b")], names=["a", "b"])

    return prune


def _sides(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, bool]:
    rows = rows.combine_chunks()
    sigs = np.frombuffer(b"".join(rows.column("__sig").to_pylist()), np.uint32).reshape(rows.num_rows, -1)
    chunk, lo, hi = (rows.column(c).to_numpy() for c in ("__chunk", "__lo", "__hi"))
    return rows, sigs, np.flatnonzero(chunk == lo[0]), np.flatnonzero(chunk == hi[0]), lo[0] == hi[0]


def _likely(sigs: np.ndarray, x: np.ndarray, y: np.ndarray, batch: int, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (x, y) that stay likely after each batch."""
    matches = np.zeros(len(x), np.int64)
    for i, need in enumerate(least):
        part = slice(i * batch, (i + 1) * batch)
        matches += (sigs[x, part] == sigs[y, part]).sum(axis=1)
        alive = matches >= need
        x, y, matches = x[alive], y[alive], matches[alive]
    return x, y


def _settle(batch: int, least: list[int], percent: int):
    """Judges all pairs of a block on full sets, and returns links that join what they join."""

    def settle(rows: pa.Table) -> pa.Table:
        rows, sigs, lefts, rights, same = _sides(rows)
        keys, labels = rows.column("__key").to_numpy(), rows.column("__label").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("__set")]
        sizes = np.array([len(v) for v in sets])
        known, places = np.unique(np.concatenate(sets), return_inverse=True)
        places = np.split(places, np.cumsum(sizes)[:-1])
        marked, parent, links = np.zeros(len(known), bool), {}, []

        def root(v: int) -> int:
            while v in parent:
                v = parent[v]
            return v

        roots = labels.copy()
        for at, x in enumerate(lefts):
            others = rights[at + 1 :] if same else rights
            others = others[roots[others] != roots[x]]
            _, others = _likely(sigs, np.full(len(others), x), others, batch, least)
            if not len(others):
                continue
            marked[places[x]] = True
            shared = np.add.reduceat(marked[np.concatenate([places[y] for y in others])], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
            marked[places[x]] = False
            for y in others[100 * shared >= percent * (sizes[x] + sizes[others] - shared)]:
                one, two = root(labels[x]), root(labels[y])
                if one != two:
                    parent[two] = one
                    links.append((min(keys[x], keys[y]), max(keys[x], keys[y])))
            if parent:
                found, back = np.unique(labels, return_inverse=True)
                roots = np.array([root(v) for v in found])[back]
        return pa.table({c: pa.array([k[i] for k in links], pa.int64()) for i, c in enumerate(("a", "b"))})

    return settle


def _needed(batch: int, least: list[int], strip: int = 32):
    """The rows of a block that have a likely partner of another label in it: the only ones whose full sets are fetched."""

    def needed(rows: pa.Table) -> pa.Table:
        rows, sigs, lefts, rights, same = _sides(rows)
        labels, found = rows.column("__label").to_numpy(), np.zeros(rows.num_rows, bool)
        for at in range(0, len(lefts), strip):
            x, y = (g.ravel() for g in np.meshgrid(lefts[at : at + strip], rights, indexing="ij"))
            apart = (labels[x] != labels[y]) & ((x < y) if same else True)
            x, y = _likely(sigs, x[apart], y[apart], batch, least)
            found[x] = found[y] = True
        return rows.filter(pa.array(found))

    return needed


def _blocks(batch: int, least: list[int], bands: int, strip: int = 32):
    """The likely pairs of a block of one bucket that no common group has judged, each in the first band that it shares."""

    def compare(rows: pa.Table) -> pa.Table:
        rows, sigs, lefts, rights, same = _sides(rows)
        keys, labels, groups, band = (rows.column(c).to_numpy() for c in ("__key", "__label", "__group", "__band"))
        a, b = [keys[:0]], [keys[:0]]
        for at in range(0, len(lefts), strip):
            x, y = (g.ravel() for g in np.meshgrid(lefts[at : at + strip], rights, indexing="ij"))
            apart = (labels[x] != labels[y]) & (groups[x] != groups[y]) & ((x < y) if same else True)
            x, y = _likely(sigs, x[apart], y[apart], batch, least)
            first = (sigs[x] == sigs[y]).reshape(len(x), bands, sigs.shape[1] // bands).all(axis=2).argmax(axis=1)
            x, y = x[first == band[0]], y[first == band[0]]
            a.append(np.minimum(keys[x], keys[y])), b.append(np.maximum(keys[x], keys[y]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return compare


def _sets(k: int, key_bits: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [v for v in shingle_sets(batch.column("__text"), k) if len(v)]
            keys = [set_keys(v, key_bits) for v in found]
            columns = [pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64()), pa.array([v.tobytes() for v in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["__key", "__check", "__set"])

    return sets


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for x, y in zip(rows.column("__set_a"), rows.column("__set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return confirm


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of word shingles of at least `percent` / 100; options are Settings.

    Texts are lower-cased (A-Z) and split at ASCII white space. Documents with equal shingle sets are one class from the start; classes
    are told apart by 128 bits of their sets' hashes (a 64-bit key, and a second hash that parts classes whose keys meet).
    Classes that share a band of their signatures are candidates. Groups are not paired off: first every bucket names a leader, its
    members' pairs with their leaders are pruned by signature batches under the posterior bound, and each member is confirmed
    on full sets with one leader, and with others only where that leaves them apart. Buckets whose members are still in
    several components are settled in blocks of `block` by `block` signatures: first the members that share a smallest
    neighbour, once for all their buckets, then what is left bucket by bucket. Full sets are fetched for rows that pass the bound only.
    So all pairs that share a band and could join two components are judged, and none of a group's pairs is written out but
    those that join something. With the default 32 bands of 4 a pair at 0.8 shares a band but for 5 in 10**8 cases.

    Returns one row per input row: id_col, n_shingles, component_id (smallest id in the component), kept (id = component_id).
    Null, empty and blank texts have no shingles, are linked with nothing and are kept. Fewer words than a shingle:
    the whole sequence counts as one. Rows that repeat an id and set are kept together. Null ids lose to any other; a
    component of null ids has component_id null and keeps its rows. Empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    with bound_batches(docs.sparkSession), Scratch(docs.sparkSession) as scratch:
        sizes, component = _classes(rows, Settings(**options), scratch)
        full = sizes.where("__n > 0")
        smallest = full.groupBy("__key").agg(F.min("__id").alias("__first")).join(component, "__key", "left")
        smallest = scratch.keep(smallest.withColumn("component", F.coalesce("component", "__key")))
        first = smallest.groupBy("component").agg(F.min("__first").alias("component_id"))
        # both sides of the join with the rows are plain exchanges, so that a hot class can be split
        named = scratch.keep(smallest.join(first, "component").select("__key", "component_id"))
        some = full.join(named, "__key").select("__id", "__n", "component_id")
        none = sizes.where("__n = 0").select("__id", "__n", F.col("__id").alias("component_id"))
        return checkpointed(some.union(none).select(F.col("__id").alias(id_col), F.col("__n").alias("n_shingles"), "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept")))


def _classes(rows: DataFrame, by: Settings, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows: __id, __text and others. Returns their columns but the text with __n and __key (the class), and __key, component of linked classes."""
    carried = [c for c in rows.columns if c != "__text"]
    schema = rows.select(*carried).schema.add("__n", "long").add("__key", "long").add("__check", "long").add("__sig", "binary")
    sketches = scratch.keep(rows.mapInArrow(lean(_sketch(by.words, by.n_hashes, by.seed, by.key_bits, carried)), schema))

    def of_classes() -> DataFrame:
        by_key = sketches.where("__n > 0").groupBy("__key").agg(F.min("__id").alias("__first"), F.min("__check").alias("__lo"), F.max("__check").alias("__hi"))
        return scratch.keep(by_key)

    classes, apart = of_classes(), lambda df: df
    if classes.where("__lo < __hi").limit(1).count():
        # keys of different sets have met (about once in 10**19 pairs): all but one of the sets get another key, from both hashes
        met = scratch.keep(classes.where("__lo < __hi").select(F.col("__key").alias("__met"), F.col("__lo").alias("__stays")))

        def apart(df: DataFrame) -> DataFrame:
            told = df.join(met, df["__key"] == met["__met"], "left")
            key = F.when(F.col("__check") != F.col("__stays"), F.xxhash64("__key", "__check")).otherwise(F.col("__key"))
            return told.withColumn("__key", key).select(*df.columns)

        sketches = scratch.keep(apart(sketches))
        classes = of_classes()
    distinct = scratch.keep(sketches.where("__n > 0").dropDuplicates(["__key"]).select("__key", "__sig"))

    def sets_of(keys: DataFrame) -> DataFrame:
        """__key, __set of the keys (a kept table) and of some others. One document of each class is read again; rows that share its id may repeat a key."""
        read = KeySet(scratch.keep(classes.join(keys, "__key", "left_semi").select(F.xxhash64("__first").alias("h"))))
        found = read.filtered(rows.select("__id", "__text"), F.xxhash64("__id")).select("__text").mapInArrow(lean(_sets(by.words, by.key_bits)), "__key long, __check long, __set binary")
        return scratch.keep(KeySet(keys).filtered(apart(found), F.col("__key")).select("__key", "__set"))

    labels = _labels(distinct, sets_of, by, scratch)
    return sketches.select(*carried, "__n", "__key"), labels.withColumnRenamed("node", "__key")


def _labels(distinct: DataFrame, sets_of, by: Settings, scratch: Scratch) -> DataFrame:
    """node, component of all classes that are linked with another."""
    placed = distinct.mapInArrow(lean(_place(by.bands)), "__key long, __band int, __bucket long")
    buckets = scratch.keep(placed.groupBy("__bucket").agg(F.min("__key").alias("a"), F.max("__key").alias("b"), F.count("*").alias("__size")).where("__size > 1"))
    # tables that buckets are joined with are written first: both sides are plain exchanges then, and a hot bucket can be split
    large = scratch.keep(buckets.where("__size > 2").select("__bucket"))
    members = scratch.keep(KeySet(large).filtered(placed, F.col("__bucket")).join(large, "__bucket", "left_semi"))

    leaders = buckets.where("__size > 2").select("__bucket", F.col("a").alias("__leader"))
    pairs = buckets.where("__size = 2").select("a", "b").union(members.join(leaders, "__bucket").where("__key <> __leader").select(F.col("__leader").alias("a"), F.col("__key").alias("b")))
    pairs = scratch.keep(pairs.distinct())
    likely = scratch.keep(_both(pairs, distinct, "__sig", scratch).mapInArrow(lean(_bayes(by.batch, by.least)), "a long, b long"))
    sets = sets_of(scratch.keep(likely.select(F.explode(F.array("a", "b")).alias("__key")).distinct()))

    # one leader for each member, so that its set is sent once; the other pairs only where members are still apart
    one = scratch.keep(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    joined = scratch.keep(_confirmed(one, sets, by.percent, scratch))
    led = scratch.keep(one.join(joined.select("b", F.col("a").alias("__root")), "b", "left").select(F.col("b").alias("__node"), F.col("a").alias("__judged"), "__root"))
    rest = likely.join(led, likely["b"] == led["__node"]).where("a <> __judged").select("a", "b", F.coalesce("__root", "b").alias("__root_b"))
    over = led.select("__node", F.col("__root").alias("__root_a"))
    rest = rest.join(over, rest["a"] == over["__node"], "left").where(F.coalesce("__root_a", "a") != F.col("__root_b")).select("a", "b")
    links = scratch.keep(joined.union(_confirmed(scratch.keep(rest), sets, by.percent, scratch)).distinct())
    labels = components(links, scratch)
    scratch.drop(pairs, likely, sets, large)
    scratch.sweep()

    members = _unsettled(members, labels, scratch)
    if members.limit(1).count():
        members = _grouped(members, scratch)
        found = _spread(members.select("__group", "__key", "__label").distinct(), "__group", by.block, scratch).join(distinct, "__key")
        found = scratch.keep(found.groupBy("__group", "__lo", "__hi").applyInArrow(_needed(by.batch, by.least), found.schema))
        sets = sets_of(scratch.keep(found.select("__key").distinct())).dropDuplicates(["__key"])
        found = found.join(scratch.keep(sets), "__key").groupBy("__group", "__lo", "__hi").applyInArrow(_settle(by.batch, by.least, by.percent), "a long, b long")
        links = scratch.keep(links.union(found))
        labels = components(links, scratch)
        members = _unsettled(members, labels, scratch, "__group")
    if members.limit(1).count():
        found = _spread(members, "__bucket", by.block, scratch).join(distinct, "__key")
        found = scratch.keep(found.groupBy("__bucket", "__lo", "__hi").applyInArrow(_blocks(by.batch, by.least, by.bands), "a long, b long"))
        sets = sets_of(scratch.keep(found.select(F.explode(F.array("a", "b")).alias("__key")).distinct()))
        labels = components(scratch.keep(links.union(_confirmed(found, sets, by.percent, scratch))), scratch)
    return labels


def _unsettled(members: DataFrame, labels: DataFrame, scratch: Scratch, *also: str) -> DataFrame:
    """Members of buckets that still hold several components (and several values of `also`), with their component as __label."""
    kept = ["__bucket", "__band", "__key", *also]
    rows = members.select(*kept).join(labels.withColumnRenamed("node", "__key"), "__key", "left")
    rows = scratch.keep(rows.select(*kept, F.coalesce("component", "__key").alias("__label")))
    several = [F.min(c) != F.max(c) for c in ("__label", *also)]
    mixed = rows.groupBy("__bucket").agg(*[x.alias(f"m{i}") for i, x in enumerate(several)])
    for i in range(len(several)):
        mixed = mixed.where(f"m{i}")
    return scratch.keep(rows.join(scratch.keep(mixed.select("__bucket")), "__bucket", "left_semi"))


def _grouped(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds __group: the smallest key that shares a bucket with the member."""
    smallest = scratch.keep(members.groupBy("__bucket").agg(F.min("__key").alias("__least")))
    groups = scratch.keep(members.join(smallest, "__bucket").groupBy("__key").agg(F.min("__least").alias("__group")))
    return scratch.keep(members.join(groups, "__key"))


def _spread(rows: DataFrame, by: str, block: int, scratch: Scratch) -> DataFrame:
    """Deals the rows of each group that holds several components into chunks, one copy for each chunk that its own meets (__lo, __hi)."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("__chunks"), F.min("__label").alias("lo"), F.max("__label").alias("hi"))
    spread = rows.join(scratch.keep(sizes.where("lo <> hi").select(by, "__chunks")), by)
    chunk = F.pmod(F.xxhash64("__key"), F.col("__chunks")).cast("int")
    spread = spread.select(*rows.columns, chunk.alias("__chunk"), F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)).alias("__other"))
    return spread.select(*rows.columns, "__chunk", F.least("__chunk", "__other").alias("__lo"), F.greatest("__chunk", "__other").alias("__hi"))


def _both(pairs: DataFrame, values: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """Adds the values of both ends. Those of the a's alone are written first, so that both sides of the join on a are plain exchanges and a hot a can be split."""
    of_a = scratch.keep(values.join(pairs.select(F.col("a").alias("__key")).distinct(), "__key", "left_semi").select(F.col("__key").alias("a"), F.col(name).alias(f"{name}_a")))
    of_b = values.select(F.col("__key").alias("b"), F.col(name).alias(f"{name}_b"))
    return pairs.join(of_b, "b").join(of_a, "a").select("a", "b", f"{name}_a", f"{name}_b")


def _confirmed(likely: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs whose full sets are similar enough, perhaps some of them twice."""
    return _both(likely, sets, "__set", scratch).mapInArrow(lean(_confirm(percent)), "a long, b long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each group of near-duplicates: the row with the smallest id (null last), then the smallest hash of id and text.

    Options are those of near_duplicates(). Rows without words stay, all of them. Of rows that agree in id and text one stays. Columns come back as
    they are, whatever their names. Only rows that go, and those that a bit set takes for such, are shuffled.
    """
    row = quick_key(F.col(id_col), F.col(text_col))
    spark = docs.sparkSession
    with bound_batches(spark), Scratch(spark) as scratch:
        rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), row.alias("__row"))
        sizes, component = _classes(rows, Settings(**options), scratch)
        place = F.struct(F.col("__id").isNull().alias("x"), F.col("__id").alias("y"), F.col("__row").alias("z"))
        rows = sizes.where("__n > 0").groupBy("__key", "__row").agg(F.min(place).alias("__place"), F.count("*").alias("__copies"))
        rows = scratch.keep(rows.join(component, "__key", "left").withColumn("component", F.coalesce("component", "__key")))
        first = rows.groupBy("component").agg(F.min("__place").alias("__place"))
        stays = scratch.keep(first.select(F.col("__place.z").alias("__stays")))
        told = rows.join(stays, rows["__row"] == stays["__stays"], "left")
        gone = checkpointed(told.where("__stays is null").select("__row").distinct())
        again = checkpointed(told.where("__stays is not null and __copies > 1").select("__row").distinct())
    columns = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, columns)], row.alias("__row"))
    left = without(named, "__row", gone)
    if again.limit(1).count():
        held = KeySet(again.select(F.xxhash64("__row").alias("h")))
        repeats = held.marked(left, F.xxhash64("__row"), "__again")
        once = repeats.where("__again").join(again, "__row", "left_semi").dropDuplicates(["__row"])
        others = repeats.where("__again").join(again, "__row", "left_anti").unionByName(repeats.where("not __again"))
        left = others.unionByName(once)
    return left.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, columns)])
