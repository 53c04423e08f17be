"""Cutting texts into tokenizer pieces and merging the distinct ones, on flat numpy arrays.

Shared by the byte-level encoder and by packing. A slice of texts is one array of code points; where pieces begin
follows from the classes of neighbouring characters. Distinct pieces are found by a rolling hash and then compared
byte by byte, and each is merged once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: The characters with Unicode's White_Space property, as inclusive ranges.
WHITE_SPACE = ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
               (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Pieces of up to so many bytes are merged in matrices; the rare longer ones (text without any break) one by one
#: with a heap, which takes the same merges in the same order.
LONG_PIECE = 256
MATRIX_ROWS = 8192
#: Bytes whose hashes are worked out at a time: eight bytes and more are held for each of them.
BLOCK_BYTES = 1 << 16
NO_RANK = np.int32(2**31 - 1)
FREE = np.int64(-1)


@functools.cache
def character_classes() -> np.ndarray:
    import regex
    points = np.arange(0x110000, dtype="<u4")
    points = points[(points < 0xD800) | (points >= 0xE000)]
    every, table = points.tobytes().decode("utf-32-le"), np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(pattern, every):
            table[points[run.start():run.end()]] = kind
    for first, last in WHITE_SPACE:
        table[first:last + 1] = SPACE
    return table


@dataclass
class Slice:
    """Some texts end to end: code points, which of them begin a text, and their UTF-8 bytes."""
    points: np.ndarray
    first: np.ndarray
    lengths: np.ndarray
    raw: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Slice:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.zeros(len(points) + 1, bool)
        first[np.concatenate(([0], lengths.cumsum()))] = True
        return cls(points, first, lengths, np.frombuffer(joined.encode(), np.uint8))

    def byte_place(self, at: np.ndarray) -> np.ndarray:
        """Byte offsets of the code points at the rising places ``at``, of which the first is the beginning and the last the
        end. Only one byte is held for a code point."""
        p = self.points
        if len(self.raw) == len(p):
            return at
        size = np.ones(len(p), np.uint8)
        for least in (0x80, 0x800, 0x10000):
            size += p >= least
        return np.concatenate(([0], np.add.reduceat(size, at[:-1], dtype=np.int64).cumsum()))


def _contractions(s: Slice, kind: np.ndarray, free: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Places of apostrophes that begin a piece with the letters after them, by the number of those letters.
    ``free``: where an apostrophe would begin a piece."""
    p, n = s.points, len(s.points)
    at = np.flatnonzero((p == ord("'")) & free)
    at = at[at + 1 < n]
    at = at[~s.first[at + 1] & (kind[at + 1] == LETTER)]
    one = np.isin(p[at + 1], [ord(c) for c in "stmd"])
    pair = at[~one & (at + 2 < n)]
    pair = pair[~s.first[pair + 2]]
    pair = pair[np.isin(p[pair + 1].astype(np.int64) << 32 | p[pair + 2],
                        [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
    return [(at[one], 1), (pair, 2)]


def _join_contractions(s: Slice, kind: np.ndarray, begins: np.ndarray, free: np.ndarray) -> None:
    for at, letters in _contractions(s, kind, free):
        begins[at + 1] = False
        begins[at + 1 + letters] = True


def spaced_pieces(s: Slice) -> np.ndarray:
    """Beginnings of pieces (and the end): contractions, runs of letters, numbers or others with a space before
    them, and other white space, of which the last character before a text stands apart."""
    kind, n = character_classes()[s.points], len(s.points)
    begins = s.first.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    spaces = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~s.first[1:n]) if n else np.zeros(0, int)
    joined = s.points[spaces] == 32
    begins[spaces] = True
    begins[spaces[joined] + 1] = False
    alone = begins[:n] & (kind == OTHER)
    _join_contractions(s, kind, begins, alone)
    return np.flatnonzero(begins)


def unspaced_pieces(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings of pieces (and the end), and which are white space, to be dropped: contractions, runs of letters,
    single numbers, runs of others."""
    kind, n = character_classes()[s.points], len(s.points)
    begins = s.first.copy()
    begins[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    _join_contractions(s, kind, begins, begins[:n] & (kind == OTHER))
    at = np.flatnonzero(begins)
    return at, kind[at[:-1]] == SPACE


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a number and of its inverse modulo 2**64, ``size`` of them or more. Only those of a usual block are kept."""
    return _usual_powers() if size <= BLOCK_BYTES else _computed_powers(size)


@functools.cache
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _computed_powers(BLOCK_BYTES)


def _computed_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
    up[1:], down[1:] = np.uint64(base), np.uint64(pow(base, -1, 2**64))
    return np.cumprod(up), np.cumprod(down)


_SPREAD = np.random.default_rng(7).integers(1, 2**63, 256, np.int64).astype(np.uint64)


def _blocks(starts: np.ndarray, ends: np.ndarray) -> list[slice]:
    """Pieces that lie within ``BLOCK_BYTES`` together, or one that is longer, so that what is held for each byte is held for
    a block at a time."""
    found, at = [], 0
    while at < len(starts):
        beyond = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, side="right")))
        found.append(slice(at, beyond))
        at = beyond
    return found


def _like(raw: np.ndarray, starts: np.ndarray, others: np.ndarray, length: np.ndarray) -> bool:
    """Whether the bytes from ``starts`` on are those from ``others`` on, over the lengths given."""
    step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return bool((raw[np.repeat(starts, length) + step] == raw[np.repeat(others, length) + step]).all())


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the number of its text among the distinct ones; for each of those, its first piece."""
    hashes, blocks = np.empty(len(starts), np.uint64), _blocks(starts, ends)
    for some in blocks:
        # A hash does not depend on where its piece lies, so powers are counted from the block's first byte.
        s, e = starts[some] - starts[some.start], ends[some] - starts[some.start]
        up, down = _powers(int(e[-1]))
        here = _SPREAD[raw[starts[some.start]:ends[some.stop - 1]]] * up[:e[-1]]
        sums = np.add.reduceat(here, np.column_stack((s, e)).ravel()[:-1])[::2]
        hashes[some] = sums * down[s] + (e - s).astype(np.uint64)
    codes, found = pd.factorize(hashes)
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    length = ends - starts
    same = length == length[first][codes]
    if same.all():
        same = np.array([_like(raw, starts[some], starts[first[codes[some]]], length[some]) for some in blocks])
    if same.all():
        return codes, first
    texts = [raw[a:b].tobytes() for a, b in zip(starts, ends)]     # two texts of one hash: compare them all
    codes, _ = pd.factorize(pd.Series(texts, dtype=object))
    first = np.empty(codes.max() + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


class PairTable:
    """Id of the token that two neighbouring tokens merge into, by hashing with linear probing. Lower ids merge
    first."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.ranks_of = pairs
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, FREE), np.full(size, NO_RANK, np.int32)
        slots, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            free = self.keys[slots[waiting]] == FREE
            _, first = np.unique(slots[waiting], return_index=True)
            placed = np.zeros(len(waiting), bool)
            placed[first] = True
            placed &= free
            at = waiting[placed]
            self.keys[slots[at]], self.ranks[slots[at]] = keys[at], ranks[at]
            waiting = waiting[~placed]
            slots[waiting] = (slots[waiting] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NO_RANK where the two do not merge. Padding is -1, in which no stored key ends."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slots = self._slot(keys)
        held = self.keys[slots]
        found = np.where(held == keys, self.ranks[slots], NO_RANK)
        probing = np.nonzero((held != keys) & (held != FREE))
        while len(probing[0]):
            slot = (slots[probing] + 1) & (len(self.keys) - 1)
            slots[probing], key, held = slot, keys[probing], self.keys[slot]
            hit, going = held == key, (held != key) & (held != FREE)
            found[tuple(p[hit] for p in probing)] = self.ranks[slot[hit]]
            probing = tuple(p[going] for p in probing)
        found[(left < 0) | (right < 0)] = NO_RANK
        return found


def merge_matrix(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Merges every row of ``ids`` (padded with -1) until no pair is left: each round, every row its leftmost pair
    of minimum rank. The result has the rows' tokens at their left, and -1 behind."""
    out, rows = np.full(ids.shape, -1, np.int32), np.arange(len(ids))
    ids = np.ascontiguousarray(ids.T)                       # one token place a line: all steps run along the rows
    ranks = pairs.find(ids[:-1], ids[1:])
    while len(rows):
        at = ranks.argmin(0) if len(ranks) else np.zeros(len(rows), np.int64)
        best = ranks[at, np.arange(len(rows))] if len(ranks) else np.full(len(rows), NO_RANK)
        ended = best == NO_RANK
        if ended.any():
            out[rows[ended], :len(ids)] = ids[:, ended].T
            going = ~ended
            rows, ids, ranks, at, best = rows[going], ids[:, going], ranks[:, going], at[going], best[going]
            if not len(rows):
                break
        each, line = np.arange(len(rows)), np.arange(len(ids) - 1)[:, None]
        ids = np.where(line <= at, ids[:-1], ids[1:])
        ids[at, each] = best
        if len(ids) == 1:
            ranks = ranks[:0]
            continue
        ranks = np.where(line[:-1] < at, ranks[:-1], ranks[1:])
        before, after = np.flatnonzero(at > 0), np.flatnonzero(at < len(ids) - 1)
        ranks[at[before] - 1, before] = pairs.find(ids[at[before] - 1, before], best[before])
        ranks[at[after], after] = pairs.find(best[after], ids[at[after] + 1, after])
    return out


def merge_long(ids: list, pairs: PairTable) -> list[int]:
    """The same merges for one long piece: a heap of (rank, place) over a linked list of tokens."""
    following, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))

    def rank(i):
        return pairs.ranks_of.get((ids[i], ids[following[i]])) if following[i] < len(ids) else None

    heap = [(r, i) for i in range(len(ids)) if (r := rank(i)) is not None]
    heapify(heap)
    while heap:
        r, i = heappop(heap)
        if ids[i] is None or rank(i) != r:
            continue
        gone = following[i]
        ids[i], following[i] = r, following[gone]
        if following[i] < len(ids):
            before[following[i]] = i
        ids[gone] = None
        for j in (before[i], i):
            if j >= 0 and (r := rank(j)) is not None:
                heappush(heap, (r, j))
    return [x for x in ids if x is not None]


def merged(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, pairs: PairTable,
           first_ids: Callable[[np.ndarray, np.ndarray], np.ndarray],
           whole: dict[bytes, int] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006 (never changed)
    """Ids of all pieces end to end, and how many each has. ``first_ids`` gives a byte's id before any merge, told
    which bytes end a piece; ``whole`` lists the pieces that are one token though merges do not lead there."""
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    codes, first = distinct(raw, starts, ends)
    u_start, u_size = starts[first], (ends - starts)[first]
    counts, parts = np.zeros(len(first), np.int64), []
    bucket = (u_size + 1) // 2                                  # widths go up in steps of two bytes
    order = np.argsort(np.where(u_size > LONG_PIECE, 1 << 40, bucket), kind="stable")
    cuts = np.flatnonzero(np.diff(np.where(u_size > LONG_PIECE, 1 << 40, bucket)[order])) + 1
    placed = []
    for group in np.split(order, cuts):
        if u_size[group[0]] > LONG_PIECE:
            for one in group.tolist():
                here = slice(u_start[one], u_start[one] + u_size[one])
                last = np.zeros(u_size[one], bool)
                last[-1] = True
                ids = merge_long(first_ids(raw[here], last).tolist(), pairs)
                parts.append(np.array(ids, np.int32))
                counts[one] = len(ids)
                placed.append(np.array([one]))
            continue
        width = int(bucket[group[0]]) * 2
        for some in np.split(group, range(MATRIX_ROWS, len(group), MATRIX_ROWS)):
            place, size = np.arange(width), u_size[some][:, None]
            ids = first_ids(raw[np.minimum(u_start[some][:, None] + place, len(raw) - 1)], place == size - 1)
            ids = merge_matrix(np.where(place < size, ids, -1).astype(np.int32), pairs)
            there = ids >= 0
            counts[some] = there.sum(1)
            parts.append(ids[there])
            placed.append(some)
    flat, placed = np.concatenate(parts), np.concatenate(placed)
    offset = np.empty(len(first), np.int64)
    offset[placed] = np.cumsum(counts[placed]) - counts[placed]
    if whole:
        flat, extra = list(flat), {raw[a:a + b].tobytes(): i for i, (a, b) in enumerate(zip(u_start, u_size))}
        for text, token in whole.items():
            if (i := extra.get(text)) is not None:
                offset[i], counts[i] = len(flat), 1
                flat.append(token)
        flat = np.array(flat, np.int32)
    sizes = counts[codes]
    index = np.repeat(offset[codes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return flat[index].astype("<u4"), sizes
