"""Token counts of whole texts."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import common, wordhash

#: Byte-level pre-tokenizers with the usual pattern always break before a space that something else than white space
#: follows, and the part from there on is tokenized as if it stood alone. For other letters than these no break is assumed.
SAFE_NEXT = "\x21-\x7eÀ-ÿ"
SAFE = re.compile(f" (?=[{SAFE_NEXT}])")
UNSAFE = re.compile(f" (?![{SAFE_NEXT}])")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str) -> list[str]:
    """Cuts a text at its safe boundaries; all pieces but the first have lost the space they begin with."""
    return text.split(" ") if UNSAFE.search(text) is None else SAFE.split(text)


class Places(dict):
    """A number for each piece in the order they are met; `new` lists those that came since it was emptied."""

    def __init__(self, *known):
        super().__init__(*known)
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = at = len(self)
        self.new.append(key)
        return at


class Encoder:
    """Token ids or counts of many texts.

    Texts are cut at safe boundaries and each different piece is encoded by the library once. Pieces are kept until there
    are `most_pieces` or `most_chars`; then the more frequent half of them stays, so the memory is bounded. New pieces go to the library
    `joined` at a time as one text: each begins with a space and holds no other, so the tokens that begin with a space tell where
    a piece begins. Tokenizers without safe boundaries get whole texts.
    """

    def __init__(self, path: str, most_pieces: int = 1 << 16, most_chars: int = 1 << 21, joined: int = 4096):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.most_pieces, self.most_chars, self.joined = most_pieces, most_chars, joined
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            self.cut, self.size = False, model.get_piece_size()
        else:
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import ByteLevel

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            before = model.pre_tokenizer
            usual = isinstance(before, ByteLevel) and not before.add_prefix_space and before.use_regex
            special = [t.content for t in model.get_added_tokens_decoder().values()]
            self.cut = usual and model.normalizer is None and not any(" " in t for t in special)
            self.size = model.get_vocab_size()
            # byte-level tokens that begin with a space
            self.begins = np.fromiter(((model.id_to_token(i) or "").startswith("\u0120") for i in range(self.size)), bool, self.size)
            # a piece with (part of) a special string is encoded alone
            self.odd = re.compile("|".join([" ", *(re.escape(t) for t in special)]))
        self.place, self.chars, self.used = Places(), 0, 0
        self.flat, self.first, self.count, self.hits = np.zeros(1 << 16, np.uint32), *(np.zeros(1 << 14, np.int64) for _ in range(3))

    def _age(self) -> None:
        """Keeps the more frequent half of the pieces, and of the characters."""
        n, keys = len(self.place), list(self.place)
        order, lengths = np.argsort(-self.hits[:n], kind="stable"), np.fromiter(map(len, keys), np.int64, n)
        kept = np.sort(order[: min(n // 2, int(np.searchsorted(np.cumsum(lengths[order]), self.most_chars // 2)))])
        count = self.count[kept]
        ends = np.cumsum(count)
        self.used, self.chars = int(count.sum()), int(lengths[kept].sum())
        self.flat[: self.used] = self.flat[np.arange(self.used) + np.repeat(self.first[kept] - (ends - count), count)]
        self.first[: len(kept)], self.count[: len(kept)], self.hits[: len(kept)] = ends - count, count, self.hits[kept] // 2
        self.place = Places(zip(map(keys.__getitem__, kept.tolist()), range(len(kept))))

    def _encoded(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces, and where each one's begin and how many they are."""
        texts = [k[1:] if k[:1] == " " else " " + k for k in keys]
        alone = [i for i, t in enumerate(texts) if t[:1] != " " or self.odd.search(t, 1)]
        rest = np.ones(len(texts), bool)
        rest[alone] = False
        rest = np.flatnonzero(rest)
        whole = np.array(self.encode(["".join([texts[i] for i in rest.tolist()])])[0], np.uint32)
        begins = np.flatnonzero(self.begins[whole])
        if len(begins) != len(rest) or (len(rest) and begins[0]):
            whole, begins, rest, alone = whole[:0], begins[:0], rest[:0], range(len(texts))
        parts = self.encode([texts[i] for i in alone]) if len(alone) else []
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = np.concatenate([whole, np.fromiter(chain.from_iterable(parts), np.uint32, int(sizes.sum()))])
        first, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        first[rest], count[rest] = begins, np.diff(np.append(begins, len(whole)))
        alone = np.array(alone, np.int64)
        first[alone], count[alone] = len(whole) + np.cumsum(sizes) - sizes, sizes
        return ids, first, count

    def _add(self, keys: list[str]) -> None:
        """Encodes pieces; the first piece of a text has a space in front of its key, which no other key has."""
        for start in range(0, len(keys), self.joined):
            part = keys[start : start + self.joined]
            ids, first, count = self._encoded(part)
            at = len(self.place) - len(keys) + start
            to, used = at + len(part), self.used + len(ids)
            while used > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while to > len(self.first):
                self.first, self.count, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.hits))
            self.flat[self.used : used] = ids
            self.first[at:to], self.count[at:to], self.hits[at:to] = self.used + first, count, 0
            self.used = used
        self.chars += sum(map(len, keys))

    def _places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all pieces, and how many pieces each text has."""
        if len(self.place) > self.most_pieces or self.chars > self.most_chars:
            self._age()
        keys, sizes = [], []
        for text in texts:
            parts = pieces(text)
            parts[0] = " " + parts[0]
            keys += parts
            sizes.append(len(parts))
        found = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))
        if self.place.new:
            self._add(self.place.new)
            self.place.new = []
        n = len(self.place)
        self.hits[:n] += np.bincount(found, minlength=n)
        return found, np.array(sizes, np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        if not self.cut:
            return np.array([len(x) for x in self.encode(texts)], np.int64)
        if not texts:
            return np.zeros(0, np.int64)
        places, sizes = self._places(texts)
        return np.add.reduceat(self.count[places], np.cumsum(sizes) - sizes)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cut:
            return [np.array(x, np.uint32) for x in self.encode(texts)]
        if not texts:
            return []
        places, sizes = self._places(texts)
        count = self.count[places]
        ends = np.cumsum(count)
        flat = self.flat[np.arange(ends[-1]) + np.repeat(self.first[places] - (ends - count), count)]
        return np.split(flat, ends[np.cumsum(sizes) - 1][:-1])


def by_bytes(texts: pa.Array, batch_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about batch_bytes of UTF-8 each, one text at least; a null has none."""
    return wordhash.in_parts(texts, batch_bytes)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text", limit: int = 1024, columns: list[str] | None = None, batch_bytes: int = 1 << 20) -> DataFrame:
    """The input's columns (or the ones named) plus n_bytes (UTF-8), n_tokens and over_limit; input columns with these names are replaced.

    Texts go through Arrow batches and only lengths come back. They are encoded in batches of about `batch_bytes`, cut at
    boundaries where the tokenizer breaks anyway (byte-level .json files only; other models take whole texts), so a long text is
    many short pieces and a piece that was met before costs a look-up. A null text counts as empty: 0 bytes, 0 tokens.
    Special strings inside texts are read as the library does by default.
    """
    path = tokenizer or tokenizer_path()
    kept = [c for c in (docs.columns if columns is None else columns) if c not in {"n_bytes", "n_tokens", "over_limit", "__text"}]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            column = batch.column("__text")
            lengths = [encoder.counts([t or "" for t in column.slice(at, to - at).to_pylist()]) for at, to in by_bytes(column, batch_bytes)]
            names = [c for c in batch.schema.names if c != "__text"]
            found = pa.array(np.concatenate([np.zeros(0, np.int64), *lengths]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], found], names=[*names, "__n"])

    rows = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(kept)], F.col(text_col).cast("string").alias("__text"))
    rows = rows.withColumn("__bytes", F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long"))
    out = rows.mapInArrow(common.lean(count), rows.drop("__text").schema.add("__n", "long"))
    return out.select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)],
        F.col("__bytes").alias("n_bytes"),
        F.col("__n").alias("n_tokens"),
        (F.col("__n") > limit).alias("over_limit"),
    )
