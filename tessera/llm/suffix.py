"""Suffix-array deduplication: bytes covered by a long string that also starts elsewhere go.

Which suffixes meet in a shard is decided by anchors. A window begins at any byte and ends LENGTH bytes or WORDS words
later, whichever comes first; its anchor is the place in it whose GRAM-byte hash is least. Equal strings of LENGTH bytes
have equal windows, and equal windows have equal anchors, so only windows whose anchor's hash occurs again can repeat.
Consecutive windows with one anchor are a segment. Segments that occur again as a whole are repeated; of the rest, and of
one copy of those, the suffixes are sorted by shards of anchor hashes.

Of a shard's parts only what lies between windows whose hashes occur again in the shard is sorted, as many parts share a
gram and no window. A shard is sorted by induced sorting on disk: suffixes whose first byte is greater than the next (or
that precede one like it) are pushed, in the order of the suffix behind them, to a queue of their first byte, from the
least byte to the greatest; then the others likewise in reverse. What is pushed is a tuple of a suffix and of its common
prefix with the one pushed before it to that queue: one byte more than the least common prefix that was scanned between
both. Neighbours in the order whose common prefix reaches a window's length hold the same window; no hash is trusted
there. Queues are files read in blocks (short ones stay in memory), and a shard's text, types, windows and marks are files
too. The seeds, which start the first pass, are put in order by sorting their substrings the same way and then by doubling
their names.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, arrow_bytes, bounded_batches, in_slices, mix64, remove, words_of, written

#: A passage of another document counts from WORDS words on (or LENGTH bytes, if these are fewer). A gram may not be longer
#: than the shortest window: 2 * WORDS - 1 bytes.
LENGTH, WORDS, GRAM = 400, 51, 96
SLICE, PIECE = 50_000, 8_000_000
BLOCK, STRETCH = 1 << 17, 1 << 20
#: Tuples of a queue in memory; a shard has some 500 queues.
HELD = 32768
#: Bits of the filter of repeated anchors: BITS_EACH an anchor, MOST_BITS (16 MB) at most, which bounds its broadcast.
BITS_EACH, MOST_BITS = 16, 2**27

_LUT = [mix64(np.arange(256, dtype=np.uint64) + np.uint64(1000 * i)) for i in (1, 2)]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def _grown(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (_BASE, _INVERSE)]
    return _powers


class Hashes:
    """Hashes of any part of some bytes."""

    def __init__(self, x: np.ndarray, lut: np.ndarray) -> None:
        power, self.inverse = _grown(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(lut[x] * power[: len(x)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def windows(x: np.ndarray, offsets: np.ndarray, length: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of texts: the end of the window that begins there (0 if none fits into its text), and whether a word
    begins there. words 0: windows of `length` bytes only."""
    n = len(x)
    end = np.arange(length, n + length, dtype=np.int32)
    begins, cuts = np.zeros(n, bool), offsets.tolist()
    if not words:
        for a, b in zip(cuts[:-1], cuts[1:]):
            end[max(a, b - length + 1) : b] = 0
        return end, begins
    starts, ends, counts = words_of(x, offsets)
    begins[starts] = True
    # bytes up to a word's end have as many words behind them as that word: theirs end with the same word
    last = np.full(len(ends) + 1, n + length, np.int32)
    last[: max(0, len(ends) - words + 1)] = ends[words - 1 :]
    upon = np.repeat(last, np.diff(ends, prepend=0, append=n))
    at = 0
    for a, b, count in zip(cuts[:-1], cuts[1:], counts.tolist()):
        at += count
        by_bytes, by_words = max(a, b - length + 1), int(ends[at - words]) if count >= words else a  # where either stops to fit
        if by_words < by_bytes:
            upon[by_words:by_bytes] = n + length
        else:
            end[by_bytes:by_words] = n + length
        upon[max(by_bytes, by_words) : b] = 0
    return np.minimum(end, upon), begins


_LEVEL = np.zeros(1, np.int8)


def _levels(n: np.ndarray) -> np.ndarray:
    """The binary logarithm of each of n, rounded down; -1 for 0."""
    global _LEVEL
    most = int(n.max(initial=0))
    if len(_LEVEL) <= most:
        _LEVEL = (np.frexp(np.arange(2 * most + 2).astype(float))[1] - 1).astype(np.int8)
    return _LEVEL[n]


def _least(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The least of values[start : start + n] for each pair, n from 1 on."""
    out = np.empty(len(start), values.dtype)
    if not len(start):
        return out
    level = _levels(n)
    table, buffers = values, (np.empty_like(values), np.empty_like(values))
    for k, some in enumerate(np.bincount(level).tolist()):
        if k:
            half = 1 << (k - 1)
            to = buffers[k % 2]
            table = np.minimum(table[:-half], table[half:], out=to[: len(table) - half])
        if some == len(start):
            return np.minimum(table[start], table[start + n - (1 << k)])
        if some:
            own = np.flatnonzero(level == k)
            s = start[own]
            out[own] = np.minimum(table[s], table[s + n[own] - (1 << k)])
    return out


def segments(x: np.ndarray, offsets: np.ndarray, length: int = LENGTH, words: int = WORDS, gram: int = GRAM):
    """Of texts: (text, first window, last window, end, has, begins, anchor hash, two hashes) of their segments; places are
    in x. end: of the bytes that count, `length` from the last window's begin if the text is so long. has: a word begins
    at one of its windows; begins: at its first."""
    empty = np.zeros(0, np.uint64)
    none = *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, bool), np.zeros(0, bool), empty, empty, empty
    gram = min(gram, length, 2 * words - 1) if words else min(gram, length)
    if len(x) < gram:
        return none
    end, begins = windows(x, offsets, length, words)
    fits = np.flatnonzero(end).astype(np.int32)
    if not len(fits):
        return none
    one = Hashes(x, _LUT[0])
    n_grams = len(x) - gram + 1
    with np.errstate(over="ignore"):
        grams = mix64((one.sums[gram:] - one.sums[:n_grams]) * one.inverse[:n_grams])
    packed = (grams & ~np.uint64(2**24 - 1)) | np.arange(n_grams, dtype=np.uint64)
    least = _least(packed, fits, (end if len(fits) == len(x) else end[fits]) - np.int32(gram - 1) - fits)
    # a new segment: another anchor, windows left out between, or another text
    new = np.r_[True, (least[1:] != least[:-1]) | (fits[1:] - fits[:-1] != 1)]
    new[np.searchsorted(fits, offsets[:-1])[np.isin(offsets[:-1], fits)]] = True
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(fits)] - 1
    s0, s1 = fits[first].astype(np.int64), fits[last].astype(np.int64)
    anchor = (least[first] & np.uint64(2**24 - 1)).astype(np.int64)
    text = np.searchsorted(offsets, s0, side="right") - 1
    stop = np.minimum(s1 + length, offsets[text + 1])
    seen = np.r_[0, np.cumsum(begins)]
    has = seen[s1 + 1] > seen[s0]
    inner = mix64((end[s1] - s0).astype(np.uint64))  # where the last window ends is a part of what must be equal
    return text, s0, s1, stop, has, begins[s0], grams[anchor], one.of(s0, stop) ^ inner, Hashes(x, _LUT[1]).of(s0, stop)


def _over(data: np.ndarray, offsets: np.ndarray, length: int, words: int):
    """segments() of a batch, slice by slice; long texts in pieces that overlap by more than the longest window and the
    bytes that count behind it. Places are in the text."""
    for lo, hi in in_slices(np.diff(offsets).tolist(), SLICE):
        base, size = int(offsets[lo]), int(offsets[hi] - offsets[lo])
        if hi - lo > 1 or size <= PIECE:
            off = offsets[lo : hi + 1] - base
            text, s0, s1, stop, *rest = segments(data[base : base + size], off, length, words)
            yield lo + text, s0 - off[text], s1 - off[text], stop - off[text], *rest
            continue
        for piece in range(0, size, PIECE):
            before = min(piece, 1)  # one byte more tells whether a word begins
            x = data[base + piece - before : base + min(size, piece + PIECE + length)]
            text, s0, s1, stop, has, begins, *rest = segments(x, np.array([0, len(x)]), length, words)
            # windows from this piece's begin to the next one's; a segment that is cut there goes on in the next piece
            yield from _cut(x, text, s0, s1, stop, has, begins, rest, before, min(PIECE, size - piece), piece - before, lo, length, words)


def _cut(x, text, s0, s1, stop, has, begins, rest, least, most, shift, place, length, words):
    """The segments that lie within [least, least + most) of a piece x of a long text; cut ones are described anew."""
    inside = (s0 >= least) & (s1 < least + most)
    yield place + text[inside], s0[inside] + shift, s1[inside] + shift, stop[inside] + shift, has[inside], begins[inside], *(r[inside] for r in rest)
    crossing = np.flatnonzero(~inside & (s1 >= least) & (s0 < least + most))
    if not len(crossing):
        return
    end, word = windows(x, np.array([0, len(x)]), length, words)
    seen = np.r_[0, np.cumsum(word)]
    a, b = np.maximum(s0[crossing], least), np.minimum(s1[crossing], least + most - 1)
    upon = np.minimum(b + length, len(x))
    one, two = (Hashes(x, lut).of(a, upon) for lut in _LUT)
    yield place + text[crossing], a + shift, b + shift, upon + shift, seen[b + 1] > seen[a], word[a], rest[0][crossing], one ^ mix64((end[b] - a).astype(np.uint64)), two


# ---- sorting a shard on disk ------------------------------------------------------------------------------------------


class Queue:
    """Tuples of a position and, with a depth, its common prefix with the one put before it; in files, in the order in
    which they are put. Those of a queue that has less than HELD stay in memory."""

    def __init__(self, path: str, kind: type, carries: bool) -> None:
        self.paths, self.kinds = (path, f"{path}.prefix")[: 1 + carries], (kind, np.int16)
        self.n, self.held, self.held_n = 0, [], 0

    def put(self, *values: np.ndarray) -> None:
        self.held.append([v.astype(k) for v, k in zip(values, self.kinds)])
        self.held_n += len(values[0])
        self.n += len(values[0])
        if self.held_n >= HELD:
            self.flush()

    def flush(self) -> None:
        if self.held:
            for path, parts in zip(self.paths, zip(*self.held)):
                with open(path, "ab") as f:
                    np.concatenate(parts).tofile(f)
            self.held, self.held_n = [], 0

    def get(self, start: int, n: int) -> tuple[np.ndarray, np.ndarray | None]:
        if self.held_n == self.n:  # nothing is in files
            if len(self.held) > 1:
                self.held = [[np.concatenate(parts) for parts in zip(*self.held)]]
            found = [v[start : start + n] for v in self.held[0]]
            return found[0].astype(np.int64), found[1].copy() if len(found) > 1 else None
        self.flush()
        found = [np.fromfile(p, k, n, offset=np.dtype(k).itemsize * start) for p, k in zip(self.paths, self.kinds)]
        return found[0].astype(np.int64), found[1] if len(found) > 1 else None

    def drop(self) -> None:
        self.held = []
        for path in self.paths:
            if os.path.exists(path):
                os.remove(path)

    def forward(self):
        """Blocks from the first on, those put meanwhile included."""
        at = 0
        while at < self.n:
            block = self.get(at, min(BLOCK, self.n - at))
            at += len(block[0])
            yield block

    def backward(self, first: int = 0):
        """Blocks from the last on; prefixes are those with the one that comes before in this direction, `first` at first."""
        at, behind = self.n, first
        while at:
            n = min(BLOCK, at)
            p, prefix = self.get(at - n, n)
            if prefix is not None:
                prefix, behind = np.r_[np.int16(behind), prefix[:0:-1]], int(prefix[0])
            yield p[::-1], prefix
            at -= n


def _kind(t: np.ndarray) -> type:
    return np.int32 if len(t) < 2**31 else np.int64


def _run(t: np.ndarray, p: int, most: int) -> int:
    """How often the letter at p stands there in a row, `most` at most."""
    x = np.asarray(t[p : p + most])
    other = np.flatnonzero(x != x[0])
    return int(other[0]) if len(other) else len(x)


def _induce(t: np.ndarray, is_l: np.ndarray, seeds: dict[int, Queue], folder: str, name: str, depth: int = 0):
    """Queues of the suffixes by first letter: of the first type in order, of the second in reverse order; and, by letter,
    the common prefix of its last suffix of the first type and its first one of the second (0 if one is missing).

    With a depth, tuples carry common prefixes, up to it.
    """
    made: tuple[dict[int, Queue], dict[int, Queue]] = ({}, {})
    # by letter: the least common prefix scanned since something was pushed to its queue; -1: nothing was
    since = np.full((2, int(t.max()) + 1), -1, np.int16)

    def push(block: np.ndarray, prefix: np.ndarray | None, second: bool) -> None:
        at = np.flatnonzero(block > 0)
        at = at[is_l[block[at] - 1] != second]
        low = since[int(second)]
        if not len(at):
            if prefix is not None:
                np.minimum(low, prefix.min(), out=low)
            return
        p = block[at] - 1
        ch = t[p]
        order = np.argsort(ch, kind="stable")
        p, ch, at = p[order], ch[order], at[order]
        new = np.r_[True, ch[1:] != ch[:-1]]
        cuts = np.flatnonzero(new)
        values = [p]
        if prefix is not None:
            before = np.r_[-1, at[:-1]]
            before[cuts] = -1
            between = _least(prefix, before + 1, at - before)
            between[cuts] = np.minimum(between[cuts], low[ch[cuts]])
            values.append(np.minimum(between + np.int16(1), depth))
            np.minimum(low, prefix.min(), out=low)
            tail = np.r_[np.minimum.accumulate(prefix[::-1])[::-1], np.int16(depth)]  # the least from a place to the end
            last = np.r_[cuts[1:], len(p)] - 1
            low[ch[last]] = tail[at[last] + 1]
        for s, e in zip(cuts, np.r_[cuts[1:], len(p)]):
            c = int(ch[s])
            if c not in made[second]:
                made[second][c] = Queue(f"{folder}/{name}{int(second)}-{c}", _kind(t), depth > 0)
            made[second][c].put(*(v[s:e] for v in values))

    def meeting(p: int, q: int) -> int:
        """The common prefix of a suffix of the first type and one of the second with the same letter: the shorter run."""
        return min(_run(t, p, depth), _run(t, q, depth))

    letters, middle = range(int(t.max()) + 1), {}
    for c in letters:
        last = None
        for block, prefix in made[0][c].forward() if c in made[0] else ():
            push(block, prefix, False)
            last = int(block[-1])
        for block, prefix in seeds[c].forward() if c in seeds else ():
            if depth and last is not None:
                prefix = np.r_[np.int16(meeting(last, int(block[0]))), prefix[1:]]
                last = None
            push(block, prefix, False)
    for c in reversed(letters):
        last = None
        for block, prefix in made[1][c].forward() if c in made[1] else ():
            push(block, prefix, True)
            last = int(block[-1])
        if c in made[0]:
            if depth and last is not None:
                middle[c] = meeting(int(made[0][c].get(made[0][c].n - 1, 1)[0][0]), last)
            for block, prefix in made[0][c].backward(middle.get(c, 0)):
                push(block, prefix, True)
    return made[0], made[1], middle


def _types(t: np.ndarray, out: np.ndarray) -> None:
    """Whether each suffix is greater than the one behind it; 0 is an end and counts as less. From the end, in blocks."""
    behind, b = False, len(t)
    while b:
        a = max(0, b - BLOCK)
        x = t[a : b + 1]
        change = np.flatnonzero(x[1:] != x[:-1])
        runs = np.diff(np.r_[-1, change, len(x) - 1])  # a run of equal letters goes by the letter behind it
        out[a:b] = (np.repeat(np.r_[x[change] > x[change + 1], behind], runs) & (x > 0))[: b - a]
        behind, b = bool(out[a]), a


def _agree(t: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """In how many letters t agrees from p and from q on, `most` at most, which may not reach beyond p's text. Four letters
    at a time, in blocks of pairs."""
    four = np.ndarray((len(t) - 3,), np.uint64, t, 0, (2,))
    out = np.zeros(len(p), p.dtype)
    for a in range(0, len(p), BLOCK):
        live, k = np.flatnonzero(most[a : a + BLOCK]) + a, 0
        while len(live):
            other = four[p[live] + k] ^ four[q[live] + k]
            out[live] = k + (other & np.uint64(0xFFFF) == 0) + (other & np.uint64(0xFFFFFFFF) == 0).astype(int) + (other & np.uint64(0xFFFFFFFFFFFF) == 0) + (other == 0)
            k += 4
            live = live[(other == 0) & (k < most[live])]
    return np.minimum(out, most)


def _seed_prefixes(t: np.ndarray, order: np.ndarray, left: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes, up to depth, of neighbours in the order of the seeds (0 for the first). left: letters to the text's
    end. place: each one's place in the order of the text.

    If the next seed of the text has the neighbour that lies as far on, its prefix is that much shorter; only the first
    seeds of such chains are compared letter by letter.
    """
    n = len(order)
    before, by_text, prefix, rest = np.full(n, -1, order.dtype), np.empty(n, order.dtype), np.zeros(n, order.dtype), np.empty(n, order.dtype)
    by_text[place] = order
    before[place[1:]] = order[:-1]
    open_ = before >= 0
    rest[place] = left
    while open_.any():
        at = np.flatnonzero(open_)
        apart = by_text[at] - before[at]
        head = np.r_[True, (np.diff(at) != 1) | (np.diff(apart) != 0)]
        own = at[head]
        prefix[own] = _agree(t, by_text[own], before[own], rest[own])
        of = own[np.cumsum(head) - 1]
        known = prefix[of] - (by_text[at] - by_text[of])
        done = head | (known > 0)
        prefix[at[done]] = np.where(head[done], prefix[at[done]], known[done])
        open_[at[done]] = False
    return np.minimum(prefix[place], depth)


def suffix_order(t: np.ndarray, folder: str, depth: int):
    """Blocks of (positions, common prefixes with the one before) of t (letters; 0 ends a text, the last is followed by
    three more) in suffix order; order and prefixes are right up to `depth` letters."""
    is_l = np.asarray(np.lib.format.open_memmap(f"{folder}/types.npy", "w+", bool, (len(t),)))
    _types(t, is_l)
    seed = (np.flatnonzero(~is_l[1:] & is_l[:-1]) + 1).astype(_kind(t))
    if not len(seed):
        return
    ends = np.flatnonzero(t == 0)

    def queues(positions: np.ndarray, name: str, *prefix: np.ndarray) -> dict[int, Queue]:
        letters = t[positions]
        by = np.argsort(letters, kind="stable")
        cuts = np.flatnonzero(np.diff(letters[by], prepend=-1))
        out: dict[int, Queue] = {}
        for a, e in zip(cuts, np.r_[cuts[1:], len(positions)]):
            c = int(letters[by[a]])
            out[c] = q = Queue(f"{folder}/{name}-{c}", _kind(t), len(prefix) > 0)
            q.put(*(v[by[a:e]] for v in (positions, *prefix)))
        return out

    is_seed = np.asarray(np.lib.format.open_memmap(f"{folder}/seeds.npy", "w+", bool, (len(t),)))
    is_seed[seed] = True
    # substrings from seed to seed, sorted by a first run with seeds in any order
    seeds = queues(seed, "seed")
    l, s, _ = _induce(t, is_l, seeds, folder, "a")
    order = [b[is_seed[b]] for c in sorted(s) for b, _ in s[c].backward()]
    for q in (*l.values(), *s.values(), *seeds.values()):
        q.drop()
    order = np.concatenate(order).astype(_kind(t)) if order else np.zeros(0, _kind(t))
    order = np.r_[ends[is_seed[ends]].astype(_kind(t)), order[t[order] > 0]]
    place = np.searchsorted(seed, order).astype(_kind(t))
    # equal neighbours: as long as each other, and equal letter by letter
    size = np.diff(seed, append=_kind(t)(len(t) - 3))[place]
    left = (ends[np.searchsorted(ends, order)] - order).astype(_kind(t))
    size, inner = np.minimum(size, left), t[order[1:]] > 0
    same = inner & (size[1:] == size[:-1]) & (left[1:] >= size[1:])
    pair = np.flatnonzero(same)
    same[pair] = _agree(t, order[pair + 1], order[pair], size[pair + 1]) == size[pair + 1]
    # the substring holds the next seed's letter too; what ends a text is equal to nothing
    after, other = order[pair + 1] + size[pair + 1], order[pair] + size[pair]
    same[pair] &= (t[after] == t[other]) & (t[after] > 0)
    # a name is the place of the first of those with the same substring
    first = np.flatnonzero(np.r_[True, ~same])
    size = np.diff(np.r_[first, len(order)])
    rank = np.zeros(len(seed), _kind(t))
    rank[place] = np.repeat(first, size)
    active = np.sort(place[np.repeat(size > 1, size)])
    del order, size, left, inner, same, pair, after, other, place, first
    k = 1
    while 2 * k < depth and len(active):  # names of 2k substrings, of two letters at least, from names of k; where names are shared
        behind = active + k
        key = rank[active].astype(np.uint64) << np.uint64(32)
        some = np.flatnonzero(behind < len(rank))
        key[some] |= (rank[behind[some]] + 1).astype(np.uint64)
        by = np.argsort(key)
        key, active = key[by], active[by]
        old, new = np.r_[True, key[1:] >> np.uint64(32) != key[:-1] >> np.uint64(32)], np.r_[True, key[1:] != key[:-1]]
        place = np.arange(len(key))
        start = np.maximum.accumulate(np.where(new, place, 0))
        rank[active] += (start - np.maximum.accumulate(np.where(old, place, 0))).astype(rank.dtype)
        alone = new & np.r_[new[1:], True]
        active = np.sort(active[~alone])
        k *= 2
    place = np.argsort(rank, kind="stable").astype(_kind(t))
    del rank
    order = seed[place]
    prefix = _seed_prefixes(t, order, (ends[np.searchsorted(ends, order)] - order).astype(_kind(t)), place, depth)
    l, s, middle = _induce(t, is_l, queues(order, "sorted", prefix), folder, "b", depth)
    for c in sorted({*l, *s}):
        if c:
            if c in l:
                yield from l[c].forward()
            if c in s:
                yield from s[c].backward(middle.get(c, 0))


#: Letters of bytes: white space comes first, so that suffixes that begin with the same whole words are neighbours.
_LETTER = np.empty(256, np.uint16)
_LETTER[np.r_[np.flatnonzero(IS_SPACE), np.flatnonzero(~IS_SPACE)]] = np.arange(1, 257)


def _again(keys: np.ndarray) -> np.ndarray:
    """Whether each of keys occurs more than once."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def _parts(folder: str, begin: np.ndarray, size: np.ndarray) -> None:
    """Leaves only the parts [begin, begin + size) of the files of a shard's letters and windows, each with a 0 behind it."""
    for name, tail in (("text", 3), ("windows", 0)):
        kind = np.uint16 if tail else np.int16
        whole = np.asarray(np.memmap(f"{folder}/{name}", kind, "r"))
        with open(f"{folder}/{name}.parts", "wb") as f:
            f.write(np.zeros(1, kind).tobytes())
            for a, b in in_slices((size + 1).tolist(), STRETCH):
                ends = np.cumsum(size[a:b] + 1)
                of = np.repeat(begin[a:b] - np.r_[0, ends[:-1]], size[a:b] + 1)
                of += np.arange(len(of))
                out = whole[of]
                out[ends - 1] = 0
                f.write(out.tobytes())
            f.write(np.zeros(tail, kind).tobytes())
        del whole
        os.replace(f"{folder}/{name}.parts", f"{folder}/{name}")


def _shard(pieces, length: int, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each of the pieces (bytes, number of windows, whether a word begins at the first, document, whether several
    documents hold it): the places at which a string of `length` bytes starts that starts elsewhere too; and whether a
    window at which a word begins is held by another document.

    Pieces meet by one gram; most that have it in common differ around it. What is sorted of a piece is from its first to
    its last window whose hash occurs again in the shard, so that equal windows are never parted. Sorting holds arrays of the seeds (every third byte of the text or so) in memory, some 30 bytes a byte of the text as
    measured; all else is in files.
    """
    folder = tempfile.mkdtemp(prefix="suffix-")
    try:
        offsets, document, many, keys, places = [1], [], [], [], []
        with open(f"{folder}/text", "wb") as text, open(f"{folder}/windows", "wb") as own:
            text.write(np.zeros(1, np.uint16).tobytes())
            own.write(np.zeros(1, np.int16).tobytes())
            held: list[tuple] = []

            def write() -> None:
                x, off = np.frombuffer(b"".join(h[0] for h in held), np.uint8), np.cumsum([0, *(len(h[0]) for h in held)])
                wide = np.zeros(len(x), np.int16)
                if len(x):
                    hashes = Hashes(x, _LUT[0])
                    end, word = windows(x, off, length, words)
                    of = np.repeat(np.arange(len(held)), np.diff(off))
                    if words:
                        far = np.arange(len(x)) - off[of]
                        n, begins = np.array([h[1] for h in held])[of], np.array([h[2] for h in held], bool)[of]
                        at = np.flatnonzero(word & (end > 0) & (far < n) & ((far > 0) | begins))
                        wide[at] = end[at] - at
                    # strings of `length` bytes and the shorter ones of these windows
                    upon = np.arange(len(x)) + length
                    upon = np.where(upon <= off[of + 1], upon, 0)
                    for ends in (upon, np.where((wide > 0) & (wide < length), end, 0)):
                        at = np.flatnonzero(ends)
                        keys.append(hashes.of(at, ends[at]))
                        places.append((at + of[at]).astype(np.int64) + offsets[-1])
                ends = off[1:]  # a zero goes behind each piece
                text.write(np.insert(_LETTER[x], ends, 0).tobytes())
                own.write(np.insert(wide, ends, 0).tobytes())
                offsets.extend((offsets[-1] + np.cumsum(np.diff(off) + 1)).tolist())
                held.clear()

            size = 0
            for piece in pieces:
                held.append(piece)
                document.append(piece[3])
                many.append(piece[4])
                size += len(piece[0])
                if size > STRETCH:
                    write()
                    size = 0
            if held:
                write()
            text.write(b"\0" * 6)
        held_by = np.zeros(len(document), bool)
        starts = [np.zeros(0, np.int64)] * len(document)
        if not keys:
            return starts, held_by
        offsets, document, many = np.array(offsets), np.array(document, np.int64), np.array(many, bool)
        at = np.sort(np.concatenate(places)[_again(np.concatenate(keys))])
        del keys, places
        if not len(at):
            return starts, held_by
        live = np.searchsorted(offsets, at, side="right") - 1
        new = np.flatnonzero(np.diff(live, prepend=-1))
        live, begin, last = live[new], at[new], at[np.r_[new[1:], len(at)] - 1]
        first = begin - offsets[live]
        size = np.minimum(last + length, offsets[live + 1] - 1) - begin
        _parts(folder, begin, size)
        offsets, document, many = np.cumsum(np.r_[1, size + 1]), document[live], many[live]
        t, wide = (np.asarray(np.memmap(f"{folder}/{n}", k, "r")) for n, k in (("text", np.uint16), ("windows", np.int16)))  # plain views: slices cost less
        mark = np.asarray(np.lib.format.open_memmap(f"{folder}/marks.npy", "w+", bool, (len(t),)))
        shared = np.zeros(len(document), bool)
        before, last, low = -1, -1, 0  # the suffix before, the last one with a window of its own, the least prefix since
        for p, prefix in suffix_order(t, folder, length):
            hit = np.flatnonzero(prefix >= length)
            mark[p[hit]] = mark[np.where(hit > 0, p[hit - 1], before)] = True
            before = int(p[-1])
            if not words:
                continue
            at = np.flatnonzero(wide[p])
            if not len(at):
                low = min(low, int(prefix.min()))
                continue
            common = np.minimum.reduceat(prefix[: at[-1] + 1], np.r_[0, at[:-1] + 1])
            common[0] = min(common[0], low)
            q = np.r_[last, p[at]]
            own = wide[q]
            same = np.flatnonzero((common >= own[1:]) & (own[:-1] == own[1:]) & (q[:-1] >= 0))
            a, b = np.searchsorted(offsets, q[same], side="right") - 1, np.searchsorted(offsets, q[same + 1], side="right") - 1
            other = (document[a] != document[b]) | many[a] | many[b]
            shared[a[other]] = shared[b[other]] = True
            last, low = int(q[-1]), int(prefix[at[-1] + 1 :].min(initial=length))
        held_by[live] = shared
        for i, skipped, s, e in zip(live.tolist(), first.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            starts[i] = skipped + np.flatnonzero(mark[s : e - 1])
        return starts, held_by
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def repeated_starts(texts, length: int = LENGTH) -> list[np.ndarray]:
    """For each text (bytes) of a shard, the places at which a string of `length` bytes starts that starts elsewhere too."""
    return _shard(((x, 0, False, 0, False) for x in texts), length, 0)[0]


# ---- over documents ---------------------------------------------------------------------------------------------------


def _bits(hashes: DataFrame) -> np.ndarray:
    """A bit array with a bit for each hash (h)."""
    bits = min(MOST_BITS, max(2**16, 2 ** int(np.ceil(np.log2(max(1, hashes.count()) * BITS_EACH)))))
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = hashes.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out


def _ranges(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The unions of [s, s + length) for sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return list(zip(starts[np.r_[0, cut]].tolist(), (starts[np.r_[cut - 1, len(starts) - 1]] + length).tolist()))


def _columns(names: str, *lists):
    """An Arrow batch of columns `name type`, from arrays in parts."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    named = [n.split(" ") for n in names.split(", ")]
    flat = [np.concatenate(v) if len(v) and isinstance(v[0], np.ndarray) else v for v in lists] if lists else [[] for _ in named]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(flat, named)], names=[n for n, _ in named])


SEGMENT = "uid long, did long, s0 long, w long, size int, has boolean, begins boolean, h long, x long, y long"
PART = "h long, uid long, did long, s0 long, w long, begins boolean, single boolean, many boolean, part binary"
FOUND = "uid long, did long, s long, e long, shared boolean"


def repeated_ranges(rows: DataFrame, length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """(uid, did, s, e, shared), written: ranges of bytes to remove, of rows (uid, did, _text); they may overlap, and empty
    ones only say whether a window at which a word begins is held by another document too (shared)."""
    spark = rows.sparkSession

    def parts(batches):
        for b in batches:
            uid, did = (b.column(i).to_numpy() for i in (0, 1))
            out = [[] for _ in range(10)]
            for text, s0, s1, stop, has, begins, h, x, y in _over(*arrow_bytes(b.column(2)), length, words):
                for o, v in zip(out, (uid[text], did[text], s0, s1 - s0, stop - s0, has, begins, h.view(np.int64), x.view(np.int64), y.view(np.int64))):
                    o.append(v)
            yield _columns(SEGMENT, *out)

    every = written(rows.mapInArrow(parts, SEGMENT), "segments")
    anchors = written(every.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "anchors")
    shared = spark.sparkContext.broadcast(_bits(anchors))
    remove(anchors)

    def again(batches):
        import pyarrow as pa

        bits = shared.value
        for b in batches:
            h = b.column(7).to_numpy().view(np.uint64)
            at = (h & np.uint64(len(bits) * 64 - 1)).astype(np.int64)
            yield b.filter(pa.array((bits[at >> 6] >> (h & np.uint64(63))) & np.uint64(1) == 1))

    found = written(every.mapInArrow(again, SEGMENT), "found")
    remove(every)
    same = ["h", "x", "y", "w", "size"]
    kinds_of = found.groupBy(*same).agg(F.count("*").alias("n"), (F.min("uid") != F.max("uid")).alias("many"), F.min(F.struct("uid", "did", "s0", "begins")).alias("one"))
    kinds_of = written(kinds_of, "kinds")
    whole = found.join(kinds_of.filter("n > 1").select(*same, "many"), same)
    ranges = whole.select("uid", "did", F.col("s0").alias("s"), (F.col("s0") + F.when(F.col("size") >= length, F.col("size")).otherwise(0)).alias("e"), (F.col("many") & F.col("has")).alias("shared"))
    mixed = kinds_of.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h")
    wanted = kinds_of.join(mixed, "h", "left_semi").select("one.uid", "one.did", F.struct("h", "one.s0", "w", "size", "one.begins", (F.col("n") == 1).alias("single"), "many").alias("p"))
    lists = wanted.groupBy("uid", "did").agg(F.collect_list("p").alias("ps"))  # parts of one text

    def cut(batches):
        for b in batches:
            data, offsets = arrow_bytes(b.column(2))
            out = []
            for i, ps in enumerate(b.column(3).to_pylist()):
                t = data[offsets[i] : offsets[i + 1]]
                u, d = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                out += [(p["h"], u, d, p["s0"], p["w"], p["begins"], p["single"], p["many"], t[p["s0"] : p["s0"] + p["size"]].tobytes()) for p in ps]
            yield _columns(PART, *map(list, zip(*out)))

    # a row a text that holds parts; rows that repeat a text and id hold the same parts
    pieces = rows.dropDuplicates(["uid", "did"]).join(lists, ["uid", "did"]).mapInArrow(cut, PART)

    def sort(batches):
        meta = []

        def parts_of():
            for b in batches:
                meta.append([b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 6)])
                data, offsets = arrow_bytes(b.column(8))
                for i, (w, begins, uid, many) in enumerate(zip(*(b.column(c).to_pylist() for c in (4, 5, 1, 7)))):
                    yield data[offsets[i] : offsets[i + 1]].tobytes(), w + 1, begins, uid, many

        starts, held = _shard(parts_of(), length, words)
        at = []
        if meta:
            uid, did, s0, single = (np.concatenate(c) for c in zip(*meta))
            for i, x in enumerate(starts):
                own = _ranges(x, length) if single[i] else []
                at += [(int(uid[i]), int(did[i]), int(s0[i]) + s, int(s0[i]) + e, bool(held[i])) for s, e in own]
                if held[i] and not own:
                    at.append((int(uid[i]), int(did[i]), 0, 0, True))
        yield _columns(FOUND, *map(list, zip(*at)))

    partitions = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # a task's queues take some 24 bytes a letter of disk
    sorted_ranges = pieces.repartition(partitions, "h").mapInArrow(sort, FOUND)
    out = written(ranges.filter("e > s or shared").unionByName(sorted_ranges), "ranges")
    remove(found, kinds_of)
    return out


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col(key), raw).alias("uid"), F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("did"), raw.alias("_text"), F.col(key).alias("_id"))


def without_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, n_bytes, spans, kept, shares): for each document its length in bytes, the maximal runs [start, end) of bytes
    that are covered by a string of `length` bytes that starts elsewhere too, in this or another document, what is left,
    and whether a passage of `words` words (or `length` bytes, if these are fewer) is in another document too, removed or
    not. words 0: the last is false.

    Null text: empty. Rows that repeat a document are copies of each other, and not another document. Null key: a document
    like others. Empty table: no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = _keyed(docs, key, text)
    ranges = repeated_ranges(rows.select("uid", "did", "_text"), length, words)
    ranges = ranges.groupBy("uid", "did").agg(F.collect_set(F.when(F.col("e") > F.col("s"), F.struct("s", "e"))).alias("rs"), F.max("shared").alias("shared"))  # of one text
    joined = rows.join(ranges, ["uid", "did"], "left").select("_id", "_text", "rs", F.coalesce("shared", F.lit(False)).alias("shared"))

    def remove(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            data, offsets = arrow_bytes(b.column(1))
            spans, kept = [], []
            for i, rs in enumerate(b.column(2).to_pylist()):
                t, merged, out, last = data[offsets[i] : offsets[i + 1]].tobytes(), [], [], 0
                for r in sorted((r["s"], r["e"]) for r in rs or ()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append(list(r))
                for s, e in merged:
                    out.append(t[last:s])
                    last = e
                spans.append([{"start": s, "end": e} for s, e in merged])
                kept.append(b"".join([*out, t[last:]]))
            cols = [b.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), b.column(3)]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "n_bytes", "spans", "kept", "shares"])

    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(remove, f"`{key}` {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, shares boolean")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of without_repeats(), and shares as 0 or 1."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        key, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("shares").cast("int").alias("shares_passage")
    )
