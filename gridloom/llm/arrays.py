"""Ragged numpy building blocks shared by the text operators.

A *block* is a run of texts laid end to end as one array of code points, with
``bounds`` giving where each text begins.  Everything here works on whole
blocks at once; a block is bounded in characters, so memory does not follow
the size of an Arrow batch (a single longer text forms a block of its own).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

U64 = np.uint64
#: Characters in a block, unless a single text is longer.
BLOCK_CHARS = 250_000
_BASE = 0x9E3779B97F4A7C15 | 1
_NONE = np.iinfo(np.int32).max


def blocks(texts: Iterable[str | None], chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Group texts (null: empty) into lists of at most ``chars`` characters."""
    held, n = [], 0
    for text in texts:
        text = text or ""
        if held and n + len(text) > chars:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts end to end, and len(texts) + 1 bounds."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), bounds


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser: a bijection on 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = 1 << (n - 1).bit_length()
            self.up = self._series(_BASE, n)
            self.down = self._series(pow(_BASE, -1, 1 << 64), n)

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, U64)
        out[0] = 1
        return np.multiply.accumulate(out)


_POWERS = _Powers()


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [starts, ends) of ``values``: equal spans, equal hashes.  Spans made for it can share one, so whoever needs identity compares (``number_spans``)."""
    n = len(values)
    _POWERS.grow(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(mix(values.astype(U64) + U64(1)) * _POWERS.up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _POWERS.down[starts] + (ends - starts).astype(U64))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that lay the ranges [start, start + length) end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - before, lengths) + np.arange(total)


def offsets(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def utf8_length(cps: np.ndarray) -> np.ndarray:
    return 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)


class PairTable:
    """(left, right) symbol pairs to (rank, merged symbol): open addressing, looked up a whole array at a time."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift = U64(64 - bits)
        self.keys = np.full((1 << bits) + 64, -1, np.int64)
        self.rank = np.full(len(self.keys), _NONE, np.int32)
        self.merged = np.zeros(len(self.keys), np.int32)
        key = self._key(left, right)
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            wins = np.zeros(len(at), bool)
            wins[first] = True
            wins &= free
            self.keys[at[wins]] = key[todo[wins]]
            self.rank[at[wins]] = rank[todo[wins]]
            self.merged[at[wins]] = merged[todo[wins]]
            todo, at = todo[~wins], at[~wins] + 1
            if len(at) and at.max() >= len(self.keys):
                pad = 1024
                self.keys = np.concatenate([self.keys, np.full(pad, -1, np.int64)])
                self.rank = np.concatenate([self.rank, np.full(pad, _NONE, np.int32)])
                self.merged = np.concatenate([self.merged, np.zeros(pad, np.int32)])

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(U64) * U64(_BASE)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (the largest int32: no such pair) and merged symbols; negative symbols pair with nothing."""
        key = self._key(left, right)
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        seen = self.keys[at]
        open_ = np.flatnonzero((seen != key) & (seen != -1))
        while len(open_):
            at[open_] += 1
            seen = self.keys[at[open_]]
            open_ = open_[(seen != key[open_]) & (seen != -1)]
        return np.where(self.keys[at] == key, self.rank[at], _NONE).astype(np.int32), self.merged[at]


#: Words of more symbols than this are merged one by one with a queue: rounds over arrays would cost their square.
LONG_WORD = 1024


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, pairs: PairTable, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte-pair merging of many words at once; returns the surviving symbols and the new lengths.

    Each round finds every word's lowest pair rank and merges it: all its
    occurrences from the left (``every``), or its leftmost one.  Words without
    a pair leave the arrays, the rest is compacted, until none is left.  Words
    over LONG_WORD symbols take the same merges through a queue.
    """
    words = len(lengths)
    out_len = lengths.astype(np.int64).copy()
    out = symbols.astype(np.int64).copy()
    start = offsets(lengths)
    for w in np.flatnonzero(lengths > LONG_WORD):
        done = _merge_long(out[start[w] : start[w + 1]], pairs)
        out_len[w] = len(done)
        out[start[w] : start[w] + len(done)] = done
    live = np.flatnonzero((lengths > 1) & (lengths <= LONG_WORD))
    n = lengths[live].astype(np.int64)
    sym = out[ragged(start[live], n)]
    rank = new = None
    while len(live):
        begin = np.cumsum(n) - n
        last = begin + n - 1
        if rank is None:
            rank, new = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
            rank[:-1], new[:-1] = pairs.find(sym[:-1], sym[1:])
            rank[last] = _NONE
        best = np.minimum.reduceat(rank, begin)
        done = best == _NONE
        if done.any():
            ended = live[done]
            out_len[ended] = n[done]
            out[ragged(start[ended], n[done])] = sym[ragged(begin[done], n[done])]
            keep = np.repeat(~done, n)
            sym, rank, new = sym[keep], rank[keep], new[keep]
            live, n, best = live[~done], n[~done], best[~done]
            if not len(live):
                break
            begin = np.cumsum(n) - n
        word = np.repeat(np.arange(len(live)), n)
        hit = np.flatnonzero(rank == best[word])
        if every:
            joined = np.zeros(len(hit), bool)
            joined[1:] = hit[1:] == hit[:-1] + 1
            at = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(joined, 0, at))
            hit = hit[(at - run) % 2 == 0]
        else:
            owner = word[hit]
            first = np.ones(len(hit), bool)
            first[1:] = owner[1:] != owner[:-1]
            hit = hit[first]
        sym[hit] = new[hit]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        n = n - np.bincount(word[hit], minlength=len(live))
        place = hit - np.arange(len(hit))  # of the merged symbols after compaction
        sym, rank, new = sym[keep], rank[keep], new[keep]
        last = np.cumsum(n) - 1
        ends = np.zeros(len(sym), bool)
        ends[last] = True
        stale = np.zeros(len(sym), bool)
        stale[place] = True
        stale[place[place > 0] - 1] = True
        rank[stale] = _NONE
        fresh = np.flatnonzero(stale & ~ends)
        rank[fresh], new[fresh] = pairs.find(sym[fresh], sym[fresh + 1])
    return out[ragged(start[:-1], out_len)] if words else out, out_len


def _merge_long(symbols: np.ndarray, pairs: PairTable) -> list[int]:
    """The same merges for one long word: a queue of (rank, place) over a linked list."""
    sym = symbols.tolist()
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranks, new = pairs.find(symbols[:-1], symbols[1:])
    queue = [(r, i, sym[i], sym[i + 1], m) for i, (r, m) in enumerate(zip(ranks.tolist(), new.tolist(), strict=True)) if r != _NONE]
    heapq.heapify(queue)
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def look(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in known:
            r, m = pairs.find(np.array([a]), np.array([b]))
            known[a, b] = int(r[0]), int(m[0])
        return known[a, b]

    gone = [False] * n
    while queue:
        _, i, a, b, m = heapq.heappop(queue)
        j = after[i]
        if gone[i] or j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i], gone[j], after[i] = m, True, after[j]
        if after[j] < n:
            before[after[j]] = i
            r, to = look(m, sym[after[j]])
            if r != _NONE:
                heapq.heappush(queue, (r, i, m, sym[after[j]], to))
        if before[i] >= 0:
            r, to = look(sym[before[i]], m)
            if r != _NONE:
                heapq.heappush(queue, (r, before[i], sym[before[i]], m, to))
    return [s for s, dead in zip(sym, gone, strict=True) if not dead]


def equal_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each span of ``a`` equals the span of ``b`` of the same length, symbol by symbol."""
    out = np.ones(len(lengths), bool)
    differs = a[ragged(a_starts, lengths)] != b[ragged(b_starts, lengths)]
    if differs.any():
        out[np.searchsorted(np.cumsum(lengths), np.flatnonzero(differs), "right")] = False
    return out


def number_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each span, place of the first span of each number, hash of each number): equal spans, and no others, share a number.

    Spans are brought together by their hashes and then compared symbol by
    symbol; those that share a hash with a different span are numbered by
    their symbols themselves.  Numbers from ``len(hash)`` on are of such spans.
    """
    codes, hashes = pd.factorize(span_hash(values, starts, ends))
    first = np.full(len(hashes), -1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    lead, lengths = first[codes], ends - starts
    again = np.flatnonzero((lead != np.arange(len(codes))) & (lengths == lengths[lead]))
    wrong = np.concatenate([again[~equal_spans(values, starts[again], values, starts[lead[again]], lengths[again])], np.flatnonzero(lengths != lengths[lead])])
    if len(wrong):
        known: dict[bytes, int] = {}
        more = []
        for i in np.sort(wrong).tolist():
            code = known.setdefault(values[starts[i] : ends[i]].tobytes(), len(hashes) + len(known))
            if code == len(hashes) + len(more):
                more.append(i)
            codes[i] = code
        first = np.concatenate([first, np.array(more, np.int64)])
    return codes, first, hashes


class WordStore:
    """Words met so far in this worker, each with a ragged row of ids.

    Words are looked up by hash and then compared symbol by symbol; a word
    that shares its hash with another one is kept under its symbols.  The
    store is emptied when it holds ``most`` words or ``symbols`` symbols, so
    its memory is bounded whatever the vocabulary of the corpus; emptied words
    are merged again.
    """

    def __init__(self, most: int = 500_000, symbols: int = 1 << 23) -> None:
        self.most, self.symbols = most, symbols
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, U64), np.zeros(0, np.int64)
        self.ids, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.text, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.clashes: dict[bytes, int] = {}

    def rows(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, make) -> np.ndarray:
        """The slot of each span of ``values``: ``make(first)`` gives (ids, lengths) of new words by the places of spans that hold them."""
        codes, first, hashes = number_spans(values, starts, ends)
        if len(self.start) + len(first) > self.most or len(self.text) > self.symbols:
            self.clear()
        plain, size = len(hashes), (ends - starts)[first]
        slot = np.full(len(first), -1, np.int64)
        own = np.ones(len(first), bool)  # kept under its hash, unless another word has it
        own[plain:] = False
        if len(self.hashes):
            at = np.searchsorted(self.hashes, hashes)
            at[at == len(self.hashes)] = 0
            met = np.flatnonzero(self.hashes[at] == hashes)
            there = self.slots[at[met]]
            long = self.begin[there + 1] - self.begin[there] == size[met]
            same = long.copy()
            same[long] = equal_spans(values, starts[first[met[long]]], self.text, self.begin[there[long]], size[met[long]])
            slot[met[same]] = there[same]
            own[met[~same]] = False
        odd = np.flatnonzero(~own)
        if len(odd):
            said = [values[starts[i] : ends[i]].astype(np.uint32).tobytes() for i in first[odd].tolist()]
            slot[odd] = [self.clashes.get(b, -1) for b in said]
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            ids, lengths = make(first[fresh])
            slot[fresh] = len(self.start) - 1 + np.arange(len(fresh))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size[fresh])])
            self.text = np.concatenate([self.text, values[ragged(starts[first[fresh]], size[fresh])].astype(np.uint32)])
            for i, b in zip(odd.tolist(), said if len(odd) else [], strict=True):
                self.clashes[b] = int(slot[i])
            new = fresh[own[fresh]]
            new = new[np.argsort(hashes[new])]
            at = np.searchsorted(self.hashes, hashes[new])
            self.hashes, self.slots = np.insert(self.hashes, at, hashes[new]), np.insert(self.slots, at, slot[new])
        return slot[codes]
