"""Suffix arrays by induced sorting, and permuted common prefixes, of one bounded shard.

``suffix_array`` classifies suffixes, sorts the leftmost-smaller substrings by inducing them from their
starts, names them, sorts the string of names recursively and induces the whole order from that. Over a small
alphabet a bucket's suffixes are induced together in numpy; the recursion's names are too many for
that and go one by one, and there the substrings, which are short, are sorted a few characters at a time instead. ``common_prefixes`` computes, for each position, how far its suffix agrees with the one before it in order,
comparing only where the preceding characters differ and deriving the rest.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is a unique smallest sentinel."""
    n = len(t)
    out = np.ones(n, bool)
    if n > 1:
        differs = np.flatnonzero(t[:-1] != t[1:])
        after = np.repeat(differs, np.diff(differs, prepend=-1))  # the last two differ
        out[:-1] = t[after] < t[after + 1]
    return out


def _starts(small: np.ndarray) -> np.ndarray:
    """Leftmost-smaller positions."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _spread(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by character, the number of each item among those of its character, the characters, and their counts."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    counts = np.diff(np.append(first, len(c)))
    return order, np.arange(len(c)) - np.repeat(first, counts), c[first].astype(np.int64), counts


def _induce(t: np.ndarray, small: np.ndarray, sorted_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffix array that the order of the leftmost-smaller suffixes induces."""
    ends = np.cumsum(size)
    begins = ends - size
    sa = np.full(len(t), -1, np.int64)
    starts_of = np.bincount(t[sorted_starts], minlength=len(size))
    order, number, chars, counts = _spread(t[sorted_starts])
    sa[np.repeat(ends[chars] - counts, counts) + number] = sorted_starts[order]

    head = begins.copy()

    def larger(block: np.ndarray) -> None:
        j = block - 1
        j = j[j >= 0]
        j = j[~small[j]]
        if len(j):
            order, number, chars, counts = _spread(t[j])
            sa[np.repeat(head[chars], counts) + number] = j[order]
            head[chars] += counts

    used = np.flatnonzero(size)
    for c in used:
        at = begins[c]
        while at < head[c]:
            block, at = sa[at : head[c]], head[c]
            larger(block)
        if starts_of[c]:
            larger(sa[ends[c] - starts_of[c] : ends[c]])

    tail = ends.copy()

    def smaller(block: np.ndarray) -> None:
        j = block[::-1] - 1
        j = j[j >= 0]
        j = j[small[j]]
        if len(j):
            order, number, chars, counts = _spread(t[j])
            sa[np.repeat(tail[chars] - 1, counts) - number] = j[order]
            tail[chars] -= counts

    for c in used[::-1]:
        at = ends[c]
        while at > tail[c]:
            block, at = sa[tail[c] : at], tail[c]
            smaller(block)
        if head[c] > begins[c]:
            smaller(sa[begins[c] : head[c]])
    sa[0] = len(t) - 1
    return sa


def _induce_each(t: np.ndarray, small: np.ndarray, sorted_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """As ``_induce``, suffix by suffix, for large alphabets."""
    n = len(t)
    # by place: the character before it if the suffix from there is larger, or smaller, than the next one, else -1; the last entry is for -1, no suffix yet
    before_larger = [-1, *np.where(small[:-1], -1, t[:-1]).tolist(), -1]
    before_smaller = [-1, *np.where(small[:-1], t[:-1], -1).tolist(), -1]
    ends = np.cumsum(size)
    head, tail = (ends - size).tolist(), ends.tolist()
    sa = [-1] * n
    for i, c in zip(sorted_starts[::-1].tolist(), t[sorted_starts[::-1]].tolist(), strict=True):
        tail[c] -= 1
        sa[tail[c]] = i
    # both loops meet what they put in
    for i in sa:
        c = before_larger[i]
        if c >= 0:
            at = head[c]
            sa[at] = i - 1
            head[c] = at + 1
    tail = ends.tolist()
    for i in reversed(sa):
        c = before_smaller[i]
        if c >= 0:
            tail[c] = at = tail[c] - 1
            sa[at] = i - 1
    sa[0] = n - 1
    return np.array(sa, np.int64)


def _names(t: np.ndarray, starts: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings in text order, equal ones alike, and how many there are."""
    length = np.append(np.diff(starts), 1) + 1
    rank_of = np.empty(len(t), np.int64)
    rank_of[starts] = np.arange(len(starts))
    rank = rank_of[ordered]
    a, b = ordered[:-1], ordered[1:]
    la, lb = length[rank[:-1]], length[rank[1:]]
    same = la == lb
    live = np.flatnonzero(same)
    step = 0
    while len(live):
        equal = t[a[live] + step] == t[b[live] + step]
        same[live[~equal]] = False
        step += 1
        live = live[equal]
        live = live[la[live] > step]
    name = np.concatenate([[0], np.cumsum(~same)])
    out = np.empty(len(starts), np.int64)
    out[rank] = name
    return out, int(name[-1]) + 1


def _names_each(t: np.ndarray, small: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, int]:
    """As ``_names``, without an order to start from, for large alphabets. Characters go with their types, which tell where a
    substring ends: none begins another, and those that agree so far end together."""
    length = np.append(np.diff(starts), 0) + 1
    typed = np.append(t.astype(np.uint64) * np.uint64(2) + small, np.uint64(0))
    bits = int(typed.max()).bit_length()
    step = max(1, 64 // bits)
    rank = np.zeros(len(starts), np.int64)  # how many are before those that agree so far
    live, at = np.arange(len(starts)), 0
    while len(live):
        key = np.zeros(len(live), np.uint64)
        for k in range(at, at + step):
            here = np.where(k < length[live], starts[live] + k, len(t))
            key = key << np.uint64(bits) | typed[here]
        order = np.lexsort((key, rank[live])) if at else np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        old = rank[live]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        first = group | np.concatenate([[True], key[1:] != key[:-1]])
        place, number = np.arange(len(live)), np.cumsum(first) - 1
        begin = np.flatnonzero(first)
        rank[live] = old + begin[number] - np.maximum.accumulate(np.where(group, place, 0))
        at += step
        live = live[(np.diff(np.append(begin, len(live)))[number] > 1) & (length[live] > at)]
    order = np.argsort(rank, kind="stable")
    name = np.concatenate([[0], np.cumsum(np.diff(rank[order]) > 0)])
    out = np.empty(len(starts), np.int64)
    out[order] = name
    return out, int(name[-1]) + 1


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order. The last character must be the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(t)
    starts = _starts(small)
    size = np.bincount(t)
    few = len(size) * 64 <= n or len(size) <= 256
    if few:
        ordered = _induce(t, small, starts, size)
        is_start = np.zeros(n, bool)
        is_start[starts] = True
        names, kinds = _names(t, starts, ordered[is_start[ordered]])
    else:
        names, kinds = _names_each(t, small, starts)
    ordered = starts[suffix_array(names) if kinds < len(starts) else np.argsort(names)]
    return (_induce if few else _induce_each)(t, small, ordered, size)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the suffix before it in order (-1: none) and the length that they share."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    left, prior = t[np.maximum(i - 1, 0)], t[np.maximum(before - 1, 0)]
    fresh = np.flatnonzero((before <= 0) | (i == 0) | (left != prior))
    words = np.concatenate([t.astype(np.uint64), np.zeros(8, np.uint64)])
    for k in (1, 2, 4):  # eight characters from each position
        words = words | np.append(words[k:], np.zeros(k, np.uint64)) << np.uint64(8 * k)
    share = np.zeros(n, np.int64)
    live = fresh[before[fresh] >= 0]
    while len(live):
        x, y = live + share[live], before[live] + share[live]
        differ = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
        equal = (differ == 0) & (np.maximum(x, y) < n)
        low = differ & (~differ + np.uint64(1))
        short = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        share[live] += np.where(equal, 8, short)
        live = live[equal]
    last = np.zeros(n, np.int64)
    last[fresh] = fresh
    last = np.maximum.accumulate(last)
    return before, np.maximum(share[last] - (i - last), 0)
