"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller or larger than the next one; the leftmost smaller ones' substrings are sorted by one
round of inducing and named; if names repeat, the string of names is sorted recursively; from the order of the
leftmost smaller suffixes one more round induces all. Where buckets are large, as in the bytes themselves, a round handles
a bucket at a time with array operations; where they are many and small, as in strings of names, a suffix at a time.
"""

from __future__ import annotations

import numpy as np

#: Buckets of this many suffixes on average, or more, are handled by array operations.
PER_BUCKET = 64


def smaller_types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; s ends with a least symbol that is there once."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(nearest, n - 2)] > 0
    return out


def _deal(out: list[list[np.ndarray]], at: np.ndarray, symbols: np.ndarray) -> None:
    """Appends positions to their symbols' buckets, in order."""
    if not len(at):
        return
    order = np.argsort(symbols, kind="stable")
    at, symbols = at[order], symbols[order]
    cut = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    for c, part in zip(symbols[np.concatenate(([0], cut))].tolist(), np.split(at, cut), strict=True):
        out[c].append(part)


def _induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The order of all suffixes from that of the leftmost smaller ones; s has a small type."""
    none = np.zeros(0, np.int64)
    seeded: list[list[np.ndarray]] = [[] for _ in range(k)]
    _deal(seeded, seeds, s[seeds])
    large: list[list[np.ndarray]] = [[] for _ in range(k)]
    for c in range(k):
        waves, now = [], np.concatenate(large[c]) if large[c] else none
        large[c] = []
        while len(now):
            waves.append(now)
            before = now[now > 0] - 1
            before = before[~small[before]]
            here = s[before] == c
            _deal(large, before[~here], s[before[~here]])
            now = before[here]
        for part in seeded[c]:
            before = part[part > 0] - 1
            before = before[~small[before]]
            _deal(large, before, s[before])
        large[c] = waves
    lower: list[list[np.ndarray]] = [[] for _ in range(k)]
    out: list[np.ndarray] = []
    for c in range(k - 1, -1, -1):
        waves, now = [], np.concatenate(lower[c]) if lower[c] else none
        lower[c] = []
        while len(now):
            waves.append(now)
            before = now[now > 0] - 1
            before = before[small[before]]
            here = s[before] == c
            _deal(lower, before[~here], s[before[~here]])
            now = before[here]
        for part in reversed(large[c]):
            before = part[::-1]
            before = before[before > 0] - 1
            before = before[small[before]]
            _deal(lower, before, s[before])
        out += waves
        out += [part[::-1] for part in reversed(large[c])]
    order = np.concatenate(out)[::-1]
    return order if len(order) == len(s) else np.concatenate(([len(s) - 1], order))


def _induce_each(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """The same for many small buckets, a suffix at a time."""
    n = len(s)
    size = np.bincount(s, minlength=k)
    ends = np.cumsum(size)
    # of the suffix one before each: its bucket if it is larger, or smaller, than the next one, else -1; and -1 for a place not filled yet
    before_large, before_small = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    before_large[1:n] = np.where(small[:-1], -1, s[:-1])
    before_small[1:n] = np.where(small[:-1], s[:-1], -1)
    order = np.full(n, n, np.int64)
    by_bucket = np.argsort(s[seeds], kind="stable")
    of = s[seeds][by_bucket]
    last = np.searchsorted(of, of, side="right")
    order[ends[of] - last + np.arange(len(of))] = seeds[by_bucket]  # at the ends of their buckets
    order, head, bucket = order.tolist(), (ends - size).tolist(), before_large.tolist()
    for i in order:  # the list is filled ahead of the place
        c = bucket[i]
        if c >= 0:
            at = head[c]
            order[at] = i - 1
            head[c] = at + 1
    tail, bucket = ends.tolist(), before_small.tolist()
    for i in reversed(order):
        c = bucket[i]
        if c >= 0:
            at = tail[c] - 1
            order[at] = i - 1
            tail[c] = at
    return np.array(order, np.int64)


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """s: numbers below k; the last is 0 and the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = smaller_types(s)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce if n >= PER_BUCKET * k else _induce_each
    s = s.astype(np.int16 if k < 1 << 15 else np.int32)
    is_left = np.zeros(n, bool)
    is_left[leftmost] = True
    first = induce(s, small, leftmost, k)
    ordered = first[is_left[first]]
    following = np.full(n, n - 1, np.int64)
    following[leftmost[:-1]] = leftmost[1:]
    a, b = ordered[:-1], ordered[1:]
    size_a, size_b = following[a] - a + 1, following[b] - b + 1
    same = size_a == size_b
    same[a == n - 1] = False
    of = np.flatnonzero(same)
    if len(of):
        size = size_a[of]
        begin = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(begin, size)
        same[of] = np.logical_and.reduceat(s[np.repeat(a[of], size) + step] == s[np.repeat(b[of], size) + step], begin)
    names = np.concatenate(([0], np.cumsum(~same)))
    if len(names) and names[-1] + 1 < len(ordered):
        named = np.zeros(n, np.int64)
        named[ordered] = names
        ordered = leftmost[suffix_array(named[leftmost], int(names[-1]) + 1)]
    return induce(s, small, ordered, k)


def permuted_prefixes(s: np.ndarray, order: np.ndarray, most: int, every: int = 16) -> np.ndarray:
    """For each position its suffix's common prefix with the suffix before it in order, no more than `most`.

    Every 16th position is compared from its start; the others begin at the bound that the one before leaves,
    as a prefix is shorter by one at most from a position to the next. Positions are compared eight symbols at a time.
    s: bytes as numbers below 256 with what ends them, so that a word of eight is one comparison.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate((s.astype(np.uint8), np.zeros(most + 16, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + most + 8]
    words = np.ascontiguousarray(words).view("<u8").ravel()
    prefix = np.zeros(n, np.int64)
    for start in range(0, every):
        at = np.arange(start, n, every)
        if start:
            prefix[at] = np.maximum(prefix[at - 1] - 1, 0)
        at = at[(before[at] >= 0) & (prefix[at] < most)]
        while len(at):
            differ = words[at + prefix[at]] ^ words[before[at] + prefix[at]]
            whole = differ == 0
            low = differ[~whole]
            prefix[at[~whole]] += (np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64)) // 8
            prefix[at[whole]] += 8
            at = at[whole]
            at = at[prefix[at] < most]
    return np.minimum(prefix, most)
