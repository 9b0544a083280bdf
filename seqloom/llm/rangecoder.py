"""Adaptive context-mixing range coder for token ids.

Three models predict the next id of a block. Order 2 and order 1 each name the id that last followed the same two ids or
the same one, with a confidence that grows while it is right. Order 0 knows how often each id of the block has come so far. Their
shares of the next id's probability are mixed from how often predictions of the same confidences have been right in
this block; what is left covers ids that are new. The mixture drives a carry-less range coder, one step per id.
Order 0 is brought up to date at fixed places, the rest after each id. Every block starts from nothing and carries the
CRC-32 of its ids. All arithmetic is on integers, so any machine decodes the same. Blocks are coded side by side, one
numpy lane each.

Frame of a block (little endian): magic, bits per id (uint8), ids (uint32), payload bytes (uint32), CRC-32 of the ids as
uint32 (uint32), payload of 16-bit words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

HEADER = "<4sBIII"
HEADER_BYTES = struct.calcsize(HEADER)
MAGIC = b"SLR2"
SLOTS_1, SLOTS_2 = 4096, 8192
#: Parts of a step's whole, and what new ids keep of it at least, as a power of two above the number of ids.
WHOLE, SPARE = 1 << 24, 2
WORD, TOP, BOTTOM, LAST, LOW_MASK = np.uint64(16), np.uint64(1 << 48), np.uint64(1 << 32), np.uint64(1 << 16), np.uint64((1 << 32) - 1)
SURE = 7
LEAST_HIT, MOST_HIT = 64, 3968
ID_MASK = (1 << 28) - 1
HASH_1, HASH_2 = 0x9E3779B1, 0x85EBCA6B
SHIFTS, MASKS = np.array([[13], [15]]), np.array([[SLOTS_1 - 1], [SLOTS_2 - 1]])
#: Steps that the encoder prepares at once, and lanes that the decoder sorts at once.
STEPS, SORTED_LANES = 64, 64


def places(longest: int) -> list[int]:
    """Where order 0 is brought up to date: closer together at first."""
    out, at = [], 32
    while at < longest:
        out.append(at)
        at += max(32, at // 4)
    return out


def _grown() -> np.ndarray:
    """How often predictions of a kind have been right, of 4096: the next value in states 0 (not tried), 1 (wrong), 2 (right).

    A state's line begins at state << 12. Kinds that predict nothing stay 0.
    """
    hit = np.arange(4096)
    out = np.stack([hit, hit + (-hit >> 5), hit + ((4096 - hit) >> 5)])
    out[1:] = np.clip(out[1:], LEAST_HIT, MOST_HIT)
    out[:, 0] = 0
    return out.ravel()


GROWN = _grown()


class Mixer:
    """The models of all lanes. In pairs, order 1 comes first, then order 2.

    `next` has what last followed an id, or two ids, as confidence << 28 | id; `hits` how often predictions of the same confidences were right.
    """

    def __init__(self, lanes: int, bits: int):
        self.bits, self.mixed, lane = bits, WHOLE - (1 << (bits + SPARE)), np.arange(lanes, dtype=np.int64)
        self.next = np.zeros(lanes * (SLOTS_1 + SLOTS_2), np.int32)
        self.bases = np.stack([lane * SLOTS_1, lane * SLOTS_2 + lanes * SLOTS_1])
        hits1, hits2 = np.full((lanes, 8), 1024, np.int64), np.full((lanes, 8, 8), 1024, np.int64)
        hits1[:, 0], hits2[:, 0] = 0, 0
        self.hits = np.concatenate([hits1.ravel(), hits2.ravel()])
        self.hit_bases = np.stack([lane * 8, lane * 64 + lanes * 8])
        self.seen = 0
        self.old = np.zeros(lanes, np.int64)  # share of ids that aren't new, of 65536

    def learn(self, seen: int, distinct: np.ndarray) -> None:
        """Order 0 now counts the first `seen` ids, among which `distinct` differ."""
        self.seen = seen
        self.old[: len(distinct)] = (seen << 16) // (seen + distinct)

    def at(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Places in `next` after the ids one step and two steps back; pairs are the last axis but one."""
        hashed = np.empty((*one.shape[:-1], 2, one.shape[-1]), np.int64)
        hashed[..., 0, :] = one
        hashed[..., 0, :] *= HASH_1
        hashed[..., 1, :] = two
        hashed[..., 1, :] *= HASH_2
        hashed[..., 1, :] += hashed[..., 0, :]
        hashed >>= SHIFTS
        hashed &= MASKS
        hashed += self.bases[:, : one.shape[-1]]
        return hashed

    def kinds(self, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `hits` of predictions as `next` has them, and whether both orders name the same id."""
        sure = now >> 28
        at = self.hit_bases[:, : now.shape[-1]] + sure[..., :1, :]
        at[..., 1, :] += sure[..., 1, :] << 3
        same = ((now[..., 0, :] ^ now[..., 1, :]) & ID_MASK) == 0
        same &= sure[..., 1, :] > 0
        return at, same

    def share(self, hit: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, ...]:
        """The line of a step: order 2, order 1, order 0 (whole units of its counts), new ids. Order 1 has no part where both name the same."""
        a2 = hit[..., 1, :] * self.mixed
        a2 >>= 12
        rest = self.mixed - a2
        a12 = hit[..., 0, :] * ~same
        a12 *= rest
        a12 >>= 12
        rest -= a12
        a12 += a2
        if not self.seen:
            return a2, a12, a12, np.zeros_like(a12), (WHOLE - a12) >> self.bits
        rest *= self.old[: rest.shape[-1]]
        rest >>= 16
        rest //= self.seen
        known = rest * self.seen
        known += a12
        new = WHOLE - known
        new >>= self.bits
        return a2, a12, known, rest, new


def _followed(now: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What `next` has after the step, and its old confidence << 28 where it was right, else 0. first: the step's id with confidence 1.

    The confidence that was right grows, another begins at 1.
    """
    right = now - first
    right += 1 << 28
    right *= (right & ID_MASK) == 0
    then = np.minimum(right, (SURE - 1) << 28)
    then += first
    return then, right


def _states(right: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Lines of GROWN for the step; order 1 was not tried where order 2 was right or both name the same."""
    state = (right > 0).astype(np.int64)
    untried = state[..., 1, :].astype(bool)
    untried |= same
    state += 1
    state[..., 0, :] *= ~untried
    state <<= 12
    return state


def _moves(low: np.ndarray, span: np.ndarray) -> Iterator[np.ndarray]:
    """Lanes that must move a word, until none must; a sound block needs few turns. Shortens the span of lanes that straddle."""
    at, lo, sp = None, low, span
    for _ in range(8):
        must = (lo ^ (lo + sp)) < TOP
        short = sp < BOTTOM
        short &= ~must
        if short.any():
            cut = np.flatnonzero(short)
            sp[cut] = (np.uint64(0) - lo[cut]) & LOW_MASK
            if at is not None:
                span[at[cut]] = sp[cut]
            must |= short
        found = must.nonzero()[0]
        if not len(found):
            return
        at = found if at is None else at[found]
        yield at
        lo, sp = low[at], span[at]
    raise ValueError("block is damaged")


def _filled(lengths: np.ndarray) -> list[int]:
    """For each step the number of lanes that have an id there; lengths don't increase."""
    return np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left").tolist()


def _step(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Moves out the words that both ends of a lane's span have in common, and returns their numbers."""
    ends = low + span
    ends ^= low
    words = (ends < TOP).view(np.uint8) + (ends < BOTTOM).view(np.uint8)
    words += (ends < LAST).view(np.uint8)
    bits = words.astype(np.uint64)
    bits <<= np.uint64(4)
    low <<= bits
    span <<= bits
    return words


def _placed(blocks: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids by step and lane, with two steps of 0 before them; places of ids in a table of `width` different ids for each lane; width."""
    ids, places, width = np.zeros((longest + 2, len(blocks)), np.int32), np.zeros((longest, len(blocks)), np.int32), 0
    for i, b in enumerate(blocks):
        keys = b.astype(np.uint16) if int(b.max()) < 1 << 16 else b  # sorted by radix
        order = keys.argsort(kind="stable")
        keys = keys[order]
        ids[2 : len(b) + 2, i], places[order, i] = b, np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]]))
        width = max(width, int(places[order[-1], i]) + 1)
    places += np.arange(len(blocks), dtype=np.int32) * np.int32(width)
    return ids, places, width


def _encode(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    """blocks: longest first. Only what the step before decides goes step by step; the rest is prepared for some steps at once."""
    lanes, longest = len(blocks), len(blocks[0])
    ids, dense, width = _placed(blocks, longest)
    filled = _filled(np.array([len(b) for b in blocks]))
    counts, before = np.zeros(lanes * width, np.int32), np.zeros(lanes * width, np.int32)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out: list[list[bytes]] = [[] for _ in range(lanes)]
    mixer, marks, counted = Mixer(lanes, bits), set(places(longest)), 0
    cuts = sorted({*range(0, longest, STEPS), *marks, longest})
    for begin, end in zip(cuts, cuts[1:]):
        n, steps = filled[begin], list(enumerate(filled[begin:end]))
        if begin in marks:
            counts += np.bincount(dense[counted:begin, :n].ravel(), minlength=lanes * width).astype(np.int32)
            by_lane = counts.reshape(lanes, width)
            before = (np.cumsum(by_lane, axis=1, dtype=np.int32) - by_lane).ravel()
            mixer.learn(begin, np.count_nonzero(by_lane[:n], axis=1))
            counted = begin
        value = ids[begin + 2 : end + 2, :n]
        first, at = value + np.int32(1 << 28), mixer.at(ids[begin + 1 : end + 1, :n], ids[begin:end, :n])
        now, right = np.zeros(at.shape, np.int32), np.zeros(at.shape, np.int32)
        for i, m in steps:
            place = at[i, :, :m]
            now[i, :, :m] = named = mixer.next.take(place)
            mixer.next[place], right[i, :, :m] = _followed(named, first[i, :m])
        at, same = mixer.kinds(now)
        hit, state = np.zeros(at.shape, np.int64), _states(right, same)
        for i, m in steps:
            place = at[i, :, :m]
            hit[i, :, :m] = was = mixer.hits.take(place)
            mixer.hits[place] = GROWN.take(was + state[i, :, :m])
        a2, a12, known, unit, new = mixer.share(hit, same)
        start, size = known + value * new, new
        if mixer.seen:
            place = dense[begin:end, :n]
            times = counts.take(place)
            old = (times > 0) & (unit > 0)
            start, size = np.where(old, a12 + unit * before.take(place), start), np.where(old, unit * times, size)
        is1 = (right[:, 0] > 0) & ~same & (a12 > a2)
        start, size = np.where(is1, a2, start), np.where(is1, a12 - a2, size)
        is2 = (right[:, 1] > 0) & (a2 > 0)
        start, size = np.where(is2, 0, start).view(np.uint64), np.where(is2, a2, size).view(np.uint64)
        lows, words, late = np.zeros(start.shape, "<u8"), np.zeros(start.shape, np.uint8), []
        for i, m in steps:
            lo, sp = low[:m], span[:m]
            sp >>= np.uint64(24)
            lo += sp * start[i, :m]
            sp *= size[i, :m]
            lows[i, :m] = lo
            words[i, :m] = _step(lo, sp)
            if sp.min() < BOTTOM:
                for move in _moves(lo, sp):
                    late += [(lane, i, word) for lane, word in zip(move.tolist(), (lo[move] >> np.uint64(48)).tolist())]
                    lo[move] <<= WORD
                    sp[move] <<= WORD
        words = words.T
        made = lows.view("<u2").reshape(*start.shape, 4)[:, :, 3:0:-1].transpose(1, 0, 2)[words[:, :, None] > np.arange(3)]
        ends = np.cumsum(words, dtype=np.int64).reshape(words.shape)
        last = ends[:, -1].copy()
        if late:
            made = np.insert(made, [ends[lane, i] for lane, i, _ in late], [word for _, _, word in late])
            last += np.cumsum(np.bincount([lane for lane, _, _ in late], minlength=n))
        for lane, (a, b) in enumerate(zip([0, *last.tolist()], last.tolist())):
            out[lane].append(made[a:b].tobytes())
    tails = low.astype("<u8").view("<u2").reshape(lanes, 4)[:, ::-1]
    return [b"".join([*parts, tail.tobytes()]) for parts, tail in zip(out, tails)]


def _decode(payloads: list[bytes], lengths: np.ndarray, bits: int) -> np.ndarray:
    """lengths: not increasing. Returns ids (longest, lanes)."""
    lanes, longest, width = len(payloads), int(lengths[0]), max(len(p) for p in payloads) // 2 + 8
    windows = np.zeros((lanes, width), np.uint64)  # four words from each on
    for i, p in enumerate(payloads):
        words = np.zeros(len(p) // 2 + 3, np.uint64)
        words[: len(p) // 2] = np.frombuffer(p, "<u2")
        for shift in range(4):
            windows[i, : len(p) // 2] |= words[shift : shift + len(p) // 2] << np.uint64(48 - 16 * shift)
    windows, used = windows.ravel(), np.arange(lanes, dtype=np.int64) * width
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    mixer, marks, ids = Mixer(lanes, bits), iter(places(longest)), np.zeros((longest + 2, lanes), np.int32)
    mark, most, highest = next(marks, -1), np.uint64(WHOLE - 1), np.uint64((1 << bits) - 1)
    kind = np.uint16 if bits <= 16 else np.uint32
    run = head = known_id = row = None
    for t, n in enumerate(_filled(lengths)):
        if t == mark:
            run, head, known_id, row = np.empty(n * t, np.int32), [], [], np.arange(n, dtype=np.int64) * t
            distinct = np.empty(n, np.int64)
            for a in range(0, n, SORTED_LANES):
                b = min(a + SORTED_LANES, n)
                known = np.sort(np.ascontiguousarray(ids[2 : t + 2, a:b].T, kind), axis=1, kind="stable")
                differs = np.ones(known.shape, bool)
                differs[:, 1:] = known[:, 1:] != known[:, :-1]
                distinct[a:b] = differs.sum(axis=1)
                np.cumsum(differs, dtype=np.int32, out=run[a * t : b * t])
                run[a * t : b * t] += sum(map(len, head)) - 1
                head.append(np.flatnonzero(differs) + a * t)
                known_id.append(known.ravel()[head[-1] - a * t].astype(np.int64))
            head, known_id = np.concatenate([*head, [n * t]]), np.concatenate(known_id)
            mixer.learn(t, distinct)
            mark = next(marks, -1)
        lo, sp = low[:n], span[:n]
        at = mixer.at(ids[t + 1, :n], ids[t, :n])
        now = mixer.next.take(at)
        place, same = mixer.kinds(now)
        hit = mixer.hits.take(place)
        a2, a12, old, unit, new = mixer.share(hit, same)
        sp >>= np.uint64(24)
        goal = windows.take(used[:n], mode="clip")
        goal -= lo
        goal //= sp
        goal = np.minimum(goal, most).view(np.int64)
        value = np.minimum((goal - old).view(np.uint64) // new.view(np.uint64), highest).view(np.int64)
        start, size = value * new, new
        start += old
        if mixer.seen:
            rank = goal - a12
            rank //= np.maximum(unit, 1)
            np.maximum(rank, 0, out=rank)
            np.minimum(rank, mixer.seen - 1, out=rank)
            rank += row[:n]
            of = run.take(rank)
            begins = head.take(of)
            times = head.take(of + 1)
            times -= begins
            times *= unit
            begins -= row[:n]
            begins *= unit
            begins += a12
            is0 = goal < old
            value, start, size = np.where(is0, known_id.take(of), value), np.where(is0, begins, start), np.where(is0, times, size)
        named, is1 = now & ID_MASK, goal < a12
        value, start, size = np.where(is1, named[0], value), np.where(is1, a2, start), np.where(is1, a12 - a2, size)
        is2 = goal < a2
        value, start, size = np.where(is2, named[1], value), np.where(is2, 0, start), np.where(is2, a2, size)
        lo += sp * start.view(np.uint64)
        sp *= size.view(np.uint64)
        used[:n] += _step(lo, sp)
        if sp.min() < BOTTOM:
            for move in _moves(lo, sp):
                used[move] += 1
                lo[move] <<= WORD
                sp[move] <<= WORD
        ids[t + 2, :n] = value
        mixer.next[at], right = _followed(now, ids[t + 2, :n] + np.int32(1 << 28))
        hit += _states(right, same)
        mixer.hits[place] = GROWN.take(hit)
    return ids[2:]


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def head_of(frame: bytes) -> tuple:
    """magic, bits, ids, payload bytes, checksum."""
    if len(frame) < HEADER_BYTES or frame[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    return struct.unpack_from(HEADER, frame)


def encode_blocks(blocks: list[np.ndarray], bits: int = 16, lanes: int = 512) -> list[bytes]:
    """One frame per block of ids; ids are below 2 ** bits, bits from 8 to 20."""
    if not 8 <= bits <= 20:
        raise ValueError("bits is 8 to 20")
    frames: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    for at in range(0, len(order), lanes):
        part = order[at : at + lanes]
        full = [i for i in part if len(blocks[i])]
        coded = dict(zip(full, _encode([blocks[i] for i in full], bits))) if full else {}
        for i in part:
            payload = coded.get(i, b"")
            frames[i] = struct.pack(HEADER, MAGIC, bits, len(blocks[i]), len(payload), crc_of(blocks[i])) + payload
    return frames


def decode_frames(frames: list[bytes], lanes: int = 512) -> list[np.ndarray]:
    """The ids of each frame; raises ValueError where a frame is damaged."""
    heads = [head_of(f) for f in frames]
    if any(len(f) != HEADER_BYTES + h[3] or h[3] % 2 for f, h in zip(frames, heads)):
        raise ValueError("block has a wrong length")
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(frames)
    for bits in sorted({h[1] for h in heads}):
        order = sorted((i for i, h in enumerate(heads) if h[1] == bits and h[2]), key=lambda i: -heads[i][2])
        for at in range(0, len(order), lanes):
            part = order[at : at + lanes]
            with np.errstate(all="ignore"):  # a damaged block may divide by nothing before its checksum tells
                ids = _decode([frames[i][HEADER_BYTES:] for i in part], np.array([heads[i][2] for i in part]), bits)
            for lane, i in enumerate(part):
                out[i] = ids[: heads[i][2], lane].astype(np.uint32)
    for h, ids in zip(heads, out):
        if crc_of(ids) != h[4]:
            raise ValueError("block has a wrong checksum")
    return out
