"""Token counts and output, substring dedup, near-duplicates, language ID against plain Python."""

import functools
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import rangecoder, wordhash
from seqloom.llm.common import Scratch
from seqloom.llm.graph import components
from seqloom.llm.langid import UNKNOWN, identify, train
from seqloom.llm.minhash import least_matches, near_duplicates, one_of_each, shingle_sets
from seqloom.llm.substring_dedup import remove_repeats
from seqloom.llm.token_counts import Encoder, count_tokens, pieces, tokenizer_path
from seqloom.llm.token_output import read_token_ids, token_digest, write_token_ids

from .conftest import ODD

WORDS = re.compile("[^\x20\x09-\x0d]+")


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


# ---- words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\raAbZé ", max_size=30)), max_size=8))
def test_words_match_regex(texts):
    array = pa.array(["skipped", *texts], pa.string())[1:]
    data, offsets = wordhash.buffers(array)
    starts, ends, first = wordhash.find_words(data, offsets)
    raw = data.tobytes()
    for i, t in enumerate(texts):
        got = [raw[a:b].decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert got == WORDS.findall(t or "")
    words = [raw[a:b] for a, b in zip(starts, ends)]
    hashes = wordhash.hash_words(data, starts, ends, step_bytes=4)
    assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(words, hashes.tolist())))


# ---- tokens


ALPHABET = ["a", "b", "Z", "é", "ÿ", "3", "'s", "'", ",", "!!", " ", "  ", "\n", "\t", "\u2003", "\xa0", "<|endoftext|>", "\U0001f600", "日", "\u0301", "_", "×"]


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join), min_size=1, max_size=4))
def test_pieces_tokenize_like_whole_texts(texts):
    encoder = Encoder(tokenizer_path(), most_pieces=5, joined=3)
    for _ in range(2):
        want = [tokenizer().encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in encoder.ids(texts)] == want
        assert encoder.counts(texts).tolist() == [len(x) for x in want]
    for t in texts:
        assert " ".join(pieces(t)) == t


def test_token_counts(make):
    got = count_tokens(make(ODD), batch_bytes=5000).collect()
    model = tokenizer()
    assert len(got) == len(ODD)
    for r in got:
        want = len(model.encode(r.text or "", add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), want, want > 1024)
    assert count_tokens(make([])).count() == 0
    assert count_tokens(make(ODD), columns=["doc_id"]).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    pieces_model = count_tokens(make(ODD), tokenizer_path("piece_bpe_32k.model")).collect()
    assert {r.n_tokens for r in pieces_model if not r.text} == {0}
    words = count_tokens(make(ODD), tokenizer_path("word_bpe_49k.json")).where("n_tokens > 1024").collect()
    assert [r.doc_id for r in words] == [8]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), max_size=60), max_size=5), st.integers(1, 4))
def test_range_coder_round_trip(lists, copies):
    blocks = [np.array(x * copies, np.uint32) for x in lists]
    assert [b.tolist() for b in rangecoder.decode_frames(rangecoder.encode_blocks(blocks, lanes=3), lanes=2)] == [b.tolist() for b in blocks]


def test_range_coder_learns_and_checks():
    draw = np.random.default_rng(0)
    block = np.tile(draw.integers(0, 50257, 300, dtype=np.uint32), 20)
    [frame] = rangecoder.encode_blocks([block])
    assert len(frame) < 2 * len(block) * 0.2
    wide = np.array([2**20 - 1, 0, 5], np.uint32)
    assert rangecoder.decode_frames(rangecoder.encode_blocks([wide], bits=20))[0].tolist() == wide.tolist()
    for at in (0, 6, 14, 18, 40, len(frame) // 2):
        bad = bytearray(frame)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rangecoder.decode_frames([bytes(bad)])
    with pytest.raises(ValueError):
        rangecoder.decode_frames([frame[:-2]])


def test_range_coder_bytes_and_time():
    """Frames are those of earlier files, and an id costs no more than 1000 ns to code and decode where 50 000 additions take 1 ms."""
    draw = np.random.default_rng(5)
    words = [draw.integers(0, 50257, draw.integers(1, 6), dtype=np.uint32) for _ in range(4000)]
    block = np.concatenate([words[int(i)] for i in draw.zipf(1.3, 400_000) % 4000])
    blocks = [block[i : i + 2048] for i in range(0, 512 * 2048, 2048)]
    took, loop = [], []
    for _ in range(3):
        start = time.thread_time()
        frames = rangecoder.encode_blocks(blocks)
        back = rangecoder.decode_frames(frames)
        took.append((time.thread_time() - start) / sum(map(len, blocks)) * 1e9)
        assert all((a == b).all() for a, b in zip(back, blocks))
        start = time.thread_time()
        for _ in range(20):
            sum(range(50_000))
        loop.append((time.thread_time() - start) * 50)
    assert zlib.crc32(b"".join(frames)) == 3710946808
    assert min(took) < 1000 * min(loop)


def test_token_files(make, spark, tmp_path):
    rows = [*ODD, *[(1000 - i, f"document {i} " * i) for i in range(60)]]
    model = tokenizer()
    for options in ({}, {"segment_ids": 100, "block_ids": 37, "lanes": 8, "partitions": 3}):
        got = sorted(token_digest(make(rows), **options).collect(), key=lambda r: r.start)
        assert len(got) == len(rows)
        order = [r.doc_id for r in got]
        assert order == sorted(order, key=lambda d: (d is not None, d))
        start, left = 0, defaultdict(list)
        for d, t, *_ in rows:
            ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            left[d].append((len(ids), zlib.crc32(ids.tobytes())))
        for r in got:
            assert r.start == start
            left[r.doc_id].remove((r.n_tokens, r.ids_crc32))
            start += r.n_tokens
    path = str(tmp_path / "ids")
    write_token_ids(make(rows), path)
    one = read_token_ids(spark, path).where("doc_id = 990").first()
    assert one.ids == [*model.encode("document 10 " * 10, add_special_tokens=False).ids, 2]
    assert token_digest(make([])).count() == 0


# ---- substring dedup


def brute_repeats(rows, k):
    words = [(d, WORDS.findall(t or "")) for d, t, *_ in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - k + 1):
            if d is not None:
                key = tuple(w[i : i + k])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "k", "vocabulary", "hash_bits"), [(1, 13, 5000, 64), (2, 6, 40, 64), (3, 5, 3, 64), (1, 13, 5000, 3), (2, 6, 40, 4)])
def test_substring_dedup(make, seed, k, vocabulary, hash_bits):
    """Few hash bits make different words meet: what is removed is the same, for spans are verified."""
    draw = random.Random(seed)
    passages = [[f"w{draw.randrange(vocabulary)}" for _ in range(draw.randrange(5, 80))] for _ in range(6)]
    rows = list(ODD)
    for i in range(120):
        words = []
        for _ in range(draw.randrange(4)):
            words += [f"w{draw.randrange(vocabulary)}" for _ in range(draw.randrange(30))]
            p = draw.choice(passages)
            a = draw.randrange(len(p))
            words += p[a : a + draw.randrange(1, 80)]
        rows.append((draw.randrange(300) if i % 10 else 20 + i, draw.choice([" ", "\n"]).join(words)))
    got = remove_repeats(make(rows), k=k, columns=["doc_id"], hash_bits=hash_bits).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=repr) == brute_repeats(rows, k)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)


def test_substring_dedup_empty(make):
    assert remove_repeats(make([])).count() == 0
    got = remove_repeats(make(ODD))
    assert set(got.columns) >= {"kept", "__key", "spans", "kept_text"} and got.count() == len(ODD)


# ---- near-duplicates


def shingles(text, k):
    words = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_near(rows, k, percent):
    sets = [shingles(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                parent[root(i)] = root(j)
    smallest = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            smallest[root(i)].append(d)
    out = []
    for i, (d, *_) in enumerate(rows):
        c = min(smallest[root(i)], default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "k", "edits", "block"), [(1, 4, 6, 512), (2, 5, 12, 16), (3, 4, 25, 7)])
def test_near_duplicates(make, seed, k, edits, block):
    draw = random.Random(seed)
    rows = list(ODD)
    for group in range(5):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(60, 260))]
        for _ in range(draw.choice([1, 3, 40])):
            words = list(base)
            for _ in range(draw.randrange(edits)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(1000)}"
            rows.append((draw.randrange(10_000) + 10, " ".join(words).title() if draw.random() < 0.5 else "\n".join(words)))
    got = near_duplicates(make(rows), words=k, block=block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute_near(rows, k, 80)
    ids = Counter(r.doc_id for r in got if r.kept and r.doc_id is not None and r.n_shingles)
    left = one_of_each(make(rows), words=k).collect()
    assert Counter(r.doc_id for r in left if r.doc_id is not None and shingles(r.text, k)) == Counter(set(ids))
    assert Counter((r.doc_id, r.text) for r in left if not shingles(r.text, k)) == Counter((d, t) for d, t, *_ in rows if not shingles(t, k))
    assert left[0].asDict().keys() >= {"__id", "__key", "kept"}


def test_near_duplicates_when_keys_meet(make):
    draw = random.Random(9)
    rows = [(i, " ".join(f"w{draw.randrange(30) if i % 3 else j}" for j in range(20))) for i in range(60)]
    got = near_duplicates(make(rows), words=4, key_bits=3).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute_near(rows, 4, 80)
    assert sorted(r.doc_id for r in one_of_each(make(rows), words=4, key_bits=3).collect()) == sorted(r.doc_id for r in got if r.kept)


def test_one_of_each_without_ids(make):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text), (None, text + " end"), (None, None), (4, "other words stand here in a row"), (4, "other words stand here in a row"), (4, "and a different text under the same id")]
    assert Counter((r.doc_id, r.text) for r in one_of_each(make(rows)).collect())[None, None] == 1
    left = Counter(r.text for r in one_of_each(make(rows)).collect() if r.text)
    assert sorted(left.values()) == [1, 1, 1] and one_of_each(make([])).count() == 0


def test_near_duplicates_empty(make):
    assert near_duplicates(make([])).count() == 0
    got = near_duplicates(make([(1, None), (2, ""), (3, "a b")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True)]


def test_bound_keeps_what_it_promises():
    least = least_matches(16, 128, 0.8, 1e-6)
    assert least == sorted(least) and least[0] < 16 * 0.5 and 128 * 0.55 < least[-1] < 128 * 0.8
    draw = np.random.default_rng(1)
    matches = (draw.random((200_000, 128)) < 0.8).reshape(200_000, 8, 16).sum(axis=2).cumsum(axis=1)
    assert (matches >= np.array(least)).all(axis=1).mean() > 0.9999


def test_whole_sets(spark):
    texts = pa.array(["A b c d e", "a B c", "", None, "x " * 50_000])
    sizes = [len(v) for v in shingle_sets(texts, 4)]
    assert sizes == [2, 1, 0, 0, 1]


def labels_of(spark, edges):
    with Scratch(spark) as scratch:
        return {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1064)] + [(5000, 5000 + i) for i in range(1, 90)]
    got = labels_of(spark, edges)
    around = defaultdict(set)
    for a, b in edges:
        if a != b:
            around[a].add(b), around[b].add(a)
    for start in around:
        seen, todo = {start}, [start]
        while todo:
            todo += [n for n in around[todo.pop()] if n not in seen and not seen.add(n)]
        assert got[start] == min(seen)
    assert set(got) == set(around)


def test_components_long_path(spark):
    ids = list(range(3000))
    random.Random(4).shuffle(ids)
    path = [*zip(ids, ids[1:]), (9001, 9000)]
    got = labels_of(spark, path)
    assert got == dict.fromkeys(ids, 0) | {9000: 9000, 9001: 9000}
    assert labels_of(spark, [(1, 1)]) == {}


# ---- language


LANGS = {"aa": "the and of to in house water", "bb": "der und die das haus wasser nicht", "cc": "que los una casa agua con por"}


def test_language(make):
    draw = random.Random(6)
    rows = []
    for i in range(240):
        lang = draw.choice(sorted(LANGS))
        rows.append((i, " ".join(draw.choice(LANGS[lang].split()).title() for _ in range(draw.randrange(3, 40))) + ", 12!", "s", lang))
    docs = make(rows)
    model = train(docs.where("doc_id % 4 <> 2"))
    got = identify(docs, model)
    assert got.where(F.col("lang_pred") != F.col("lang")).count() == 0
    assert got.where("score < 0.5 or score > 1").count() == 0
    unseen = identify(make([(1, "hous wate thee"), (2, "wassr nich"), (3, None), (4, "12 !"), (5, ""), (6, "Casas " * 40_000)]), model).collect()
    assert [r.lang_pred for r in sorted(unseen, key=lambda r: r.doc_id)] == ["aa", "bb", UNKNOWN, UNKNOWN, UNKNOWN, "cc"]
    assert {r.lang_pred for r in identify(make([(1, "½ ②"), (2, "Ⅷ 7_7")]), model).collect()} == {UNKNOWN}
    assert train(docs.repartition(9).where("doc_id % 4 <> 2")) == model
    nothing = train(docs.limit(0))
    assert {r.lang_pred for r in identify(docs, nothing).collect()} == {UNKNOWN}
    assert identify(make(ODD), model).count() == len(ODD)
    # the same in plain Python
    learned = [r for r in docs.collect() if r.doc_id % 4 != 2]
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for r in learned:
        for w in re.findall(r"[^\W\d_]+", r.text.lower()):
            words[r.lang][w] += 1
            p = f" {w} "
            for i in range(len(p) - 1):
                for n in range(1, min(4, len(p) - i) + 1):
                    grams[r.lang][p[i : i + n]] += 1

    def plain(w):
        known = {x for x in set().union(*words.values()) if sum(words[a][x] for a in LANGS) > 1}
        parts = {x for x in set().union(*grams.values()) if sum(grams[a][x] for a in LANGS) > 1}
        share = lambda c, a, x, floor: math.log(max(c[a][x] / sum(c[a].values()), floor))
        if w in known:
            return [share(words, a, w, 1e-7) for a in sorted(LANGS)]
        p, found = f" {w} ", []
        for i in range(len(p) - 1):
            longest = next((p[i : i + n] for n in range(4, 0, -1) if len(p[i : i + n]) == n and p[i : i + n] in parts), None)
            if longest is not None:
                found.append([share(grams, a, longest, 1e-6) for a in sorted(LANGS)])
        return [sum(x) / len(found) for x in zip(*found)] if found else [0.0] * len(LANGS)

    for w in ("house", "hous", "wassr", "qqq", "x", "entonces", "dasagua"):
        assert model.score([w])[0][0].tolist() == pytest.approx(plain(w)), w
    score = model.scorer(memo_words=5000)
    for text in ("hous wassr QQQ agua", "Entonces 12 dasagua", "the " * 9000 + "der"):
        total = np.sum([plain(w) for w in re.findall(r"[^\W\d_]+", text.lower())[:4]] if len(text) < 100 else [np.array(plain("the")) * 9000, plain("der")], axis=0)
        best = int(total.argmax())
        assert score(text) == (sorted(LANGS)[best], pytest.approx(1 / np.exp(total - total[best]).sum()))
