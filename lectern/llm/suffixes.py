"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays inside a task."""
from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The end of the text is smaller than any symbol."""
    n = len(s)
    small = np.zeros(n, dtype=bool)
    if n > 1:
        step = np.sign(s[1:].astype(np.int16) - s[:-1].astype(np.int16))
        differs = np.where(step != 0, np.arange(n - 1), n - 1)
        following = np.minimum.accumulate(differs[::-1])[::-1]
        small[:-1] = np.append(step, -1)[following] > 0
    return small


def _deal(s: np.ndarray, entries: np.ndarray, queues: list[list[np.ndarray]]) -> None:
    """Appends entries to the queues of their symbols, in order."""
    symbols = s[entries]
    order = np.argsort(symbols, kind="stable")
    entries, symbols = entries[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for part, symbol in zip(np.split(entries, cuts), symbols[np.concatenate([[0], cuts])], strict=True):
        queues[symbol].append(part)


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes from that of the leftmost-smaller ones, bucket by bucket.

    A bucket's entries put their left neighbours into the queues of other buckets, or of the same bucket for a run of
    one symbol, which is another wave of it. Every suffix is moved once in each of the two scans.
    """
    n, none = len(s), np.empty(0, dtype=np.int64)
    seeds: list[list[np.ndarray]] = [[] for _ in range(256)]
    if len(lms):
        _deal(s, lms, seeds)
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    large[s[n - 1]].append(np.array([n - 1]))  # the end of the text comes first of all and induces the last suffix
    buckets: list[np.ndarray] = [none] * 256
    for c in range(256):
        wave, done = np.concatenate(large[c]) if large[c] else none, []
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            same = s[before] == c
            if not same.all():
                _deal(s, before[~same], large)
            wave = before[same]
        buckets[c] = np.concatenate(done) if done else none
        if seeds[c]:
            before = np.concatenate(seeds[c])
            before = before[before > 0] - 1
            if len(before):
                _deal(s, before, large)
    little: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    for c in range(255, -1, -1):
        wave, done = np.concatenate(little[c]) if little[c] else none, []
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            before = before[small[before]]
            same = s[before] == c
            if not same.all():
                _deal(s, before[~same], little)
            wave = before[same]
        before = buckets[c][::-1]
        before = before[before > 0] - 1
        before = before[small[before]]
        if len(before):
            _deal(s, before, little)
        out.extend([np.concatenate(done), buckets[c][::-1]] if done else [buckets[c][::-1]])
    return np.concatenate(out)[::-1]


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A number for each leftmost-smaller substring (in text order), equal for equal ones, from their sorted order."""
    ends = np.append(lms[1:], len(s) - 1)  # a substring ends where the next begins
    width = np.zeros(len(s), dtype=np.int64)
    width[lms] = ends - lms + 1
    a, b = order[:-1], order[1:]
    differs = width[a] != width[b]
    active, k = np.flatnonzero(~differs), 0
    while len(active):
        apart = s[a[active] + k] != s[b[active] + k]
        differs[active[apart]] = True
        k += 1
        active = active[~apart]
        active = active[width[a[active]] > k]
    # The last one ends with the text, so no other one equals it.
    last = len(lms) - 1
    differs |= (a == lms[last]) | (b == lms[last])
    names = np.zeros(len(s), dtype=np.int64)
    names[order] = np.concatenate([[0], np.cumsum(differs)])
    return names[lms]


def _recurse(ranks: np.ndarray, step: int) -> np.ndarray:
    """The order of the suffixes of a string of numbers: equal numbers are told apart by what follows ``step`` later."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    if ranks[order[-1]] == n - 1:
        return order
    behind = np.zeros(n, dtype=np.int64)
    behind[:max(n - step, 0)] = ranks[step:] + 1
    pairs = ranks * np.int64(n + 1) + behind
    order = np.argsort(pairs, kind="stable")
    fresh = np.empty(n, dtype=np.int64)
    fresh[order] = np.concatenate([[0], np.cumsum(np.diff(pairs[order]) != 0)])
    return _recurse(fresh, step * 2)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of a byte array in lexicographic order."""
    if len(s) == 0:
        return np.empty(0, dtype=np.int64)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        rough = _induce(s, small, lms)
        mark = np.zeros(len(s), dtype=bool)
        mark[lms] = True
        names = _names(s, lms, rough[mark[rough]])
        lms = lms[_recurse(names, 1)]
    return _induce(s, small, lms)


def common_prefixes(s: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous, length), by position in the text: the suffix before it in ``order`` (-1: none) and what they share.

    Only where the symbols to the left differ is a prefix measured; elsewhere it is one less than that of the position
    to the left.
    """
    n = len(s)
    previous = np.full(n, -1, dtype=np.int64)
    previous[order[1:]] = order[:-1]
    left = previous - 1
    measured = np.ones(n, dtype=bool)
    inner = np.flatnonzero((np.arange(n) > 0) & (previous > 0))
    measured[inner] = s[inner - 1] != s[left[inner]]
    measured[np.flatnonzero(previous >= 0)[:1]] = True
    at = np.flatnonzero(measured)
    other, length = previous[at], np.zeros(len(at), dtype=np.int64)
    active = np.flatnonzero(other >= 0)
    padded = np.concatenate([s, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    room = n - np.maximum(at, other)  # up to the end of the later one
    while len(active):
        k = length[active]
        x = eight[at[active] + k] ^ eight[other[active] + k]
        equal = x == 0
        length[active[equal]] += 8
        rest, x = active[~equal], x[~equal]
        zeros = np.zeros(len(x), dtype=np.int64)
        for _ in range(7):  # equal bytes before the first that differs
            still = (x & np.uint64(0xFF)) == 0
            zeros += still
            x = np.where(still, x >> np.uint64(8), x)
        length[rest] += zeros
        active = active[equal]
        active = active[length[active] < room[active]]
    length = np.minimum(length, room)
    length[other < 0] = 0
    owner = np.maximum.accumulate(np.where(measured, np.arange(n), 0))
    known = np.zeros(n, dtype=np.int64)
    known[at] = length
    shared = np.maximum(known[owner] - (np.arange(n) - owner), 0)
    shared[previous < 0] = 0
    return previous, shared
