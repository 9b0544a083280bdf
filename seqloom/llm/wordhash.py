"""Hashes of words and of runs of words, over whole Arrow string columns at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of 64-bit finalisers (the public MurmurHash3 constants) and of the polynomials below.
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BYTE_STEP, WORD_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, as a new array."""
    x = x ^ (x >> np.uint64(33))
    x *= MIX_1
    x ^= x >> np.uint64(33)
    x *= MIX_2
    x ^= x >> np.uint64(33)
    return x


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def powers(step: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), step, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8), offsets - first


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and for each text the number of words before it."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[0] = cut[-1] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, step_bytes: int = 1 << 19) -> np.ndarray:
    """One 64-bit hash per word, in steps that bound the memory."""
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, total[at] + step_bytes, "right")) - 1)
        n, first = lengths[at:to], total[at:to] - total[at]
        place = np.arange(int(total[to] - total[at])) - np.repeat(first, n)
        letters = data[np.repeat(starts[at:to], n) + place]
        values = BYTE[LOWER[letters] if lower else letters]
        values *= powers(BYTE_STEP, int(n.max()))[place]
        out[at:to] = np.add.reduceat(values, first)
        at = to
    return mixed(out + lengths.astype(np.uint64) * WORD_STEP)


def hash_runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i : i + k] for each i that has k words from it on; runs may cross texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for weight, i in zip(powers(WORD_STEP, k + 1)[1:], range(k)):
        out += words[i : i + n] * weight
    return mixed(out)


def in_parts(texts: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about most_bytes of text each, one row at least."""
    sizes = np.cumsum(np.diff(buffers(texts)[1]))
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most_bytes, "right")))
        yield at, to
        at = to
