"""Suffix arrays by the difference cover of three, with array passes only.

Suffixes at positions 1 and 2 mod 3 are sorted by their first three letters and named; if
names repeat, the string of names is sorted the same way.  The others are sorted by their
first letter and the rank behind it, and merged in: a suffix of the third kind compares with
one of the first by (letter, rank) and with one of the second by (letter, letter, rank).

Tuples are sorted as one machine word with their place in its low bits (a plain sort of
words takes a seventh of an argsort's time); tuples that are too wide for that take a pass
for each part that fits, the last letters first.
"""

from __future__ import annotations

import numpy as np


def _wide(parts: list[tuple[np.ndarray, int]], low: int = 0) -> np.ndarray:
    """One word of the parts (values, bits), the first uppermost, above `low` free bits."""
    word = parts[0][0].astype(np.uint64)
    for values, bits in parts[1:]:
        word <<= np.uint64(bits)
        word |= values.astype(np.uint64)
    if low:
        word <<= np.uint64(low)
    return word


def ordered(parts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The places of tuples in their order (equal ones by place), which differ from the one before, and the sorted tuples as words where they fit one."""
    n = len(parts[0][0])
    low = max(1, (n - 1).bit_length())
    mask = np.uint64((1 << low) - 1)
    todo, order = list(parts), None
    while todo:
        some = [todo.pop()]
        while todo and sum(bits for _, bits in some) + todo[-1][1] + low <= 64:
            some.insert(0, todo.pop())
        word = _wide(some if order is None else [(values[order], bits) for values, bits in some], low)
        word |= np.arange(n, dtype=np.uint64)
        word.sort()
        at = (word & mask).astype(np.int32)
        order = at if order is None else order[at]
    new = np.ones(n, bool)
    if sum(bits for _, bits in parts) + low <= 64:
        word >>= np.uint64(low)
        new[1:] = word[1:] != word[:-1]
        return order, new, word
    new[1:] = False
    for values, _ in parts:
        v = values[order]
        new[1:] |= v[1:] != v[:-1]
    return order, new, None


def suffix_array(s: np.ndarray, top: int | None = None) -> np.ndarray:
    """The order of the suffixes of s (integers from 1 to `top`)."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int32)
    x = np.zeros(n + 4, np.int32)
    x[:n] = s
    bits = int(x.max() if top is None else top).bit_length()
    n0, n1, n2 = -(-n // 3), n // 3 + (n % 3 > 0), n // 3  # a suffix of the end alone, at n, keeps the two halves apart
    at = lambda d: np.concatenate([x[1 + d :: 3][:n1], x[2 + d :: 3][:n2]])
    order, new, _ = ordered([(at(0), bits), (at(1), bits), (at(2), bits)])
    count = int(new.sum())
    if count < len(order):
        names = np.empty(len(order), np.int32)
        names[order] = np.cumsum(new, dtype=np.int32)
        order = suffix_array(names, count)
    one = order < n1
    third = np.where(one, order, order - np.int32(n1))  # the place among those of its kind
    cover = 3 * third + np.where(one, np.int32(1), np.int32(2))
    rank = np.zeros(n + 4, np.int32)
    rank[cover] = np.arange(1, len(cover) + 1, dtype=np.int32)
    width = len(cover).bit_length()
    if n % 3 == 1:
        inside = cover < n
        cover, third, one = cover[inside], third[inside], one[inside]
    # the third kind, by letter and rank
    rest, _, key = ordered([(x[0:n:3], bits), (rank[1 : n + 1 : 3], width)])
    if key is None:
        key = _wide([(x[0:n:3], bits), (rank[1 : n + 1 : 3], width)])[rest]
    before = np.searchsorted(_wide([(x[1 : n + 1 : 3], bits), (rank[2 : n + 2 : 3], width)])[third[one]], key)
    # words of (letter, letter, rank) for the third kind, then for the second; letters too wide for a word are named by pairs
    pairs = [(np.concatenate([x[0:n:3], x[2:n:3]]), bits), (np.concatenate([x[1 : n + 1 : 3], x[3 : n + 1 : 3]]), bits)]
    if 2 * bits + width > 64:
        by, new, _ = ordered(pairs)
        names = np.empty(len(by), np.int32)
        names[by] = np.cumsum(new, dtype=np.int32)
        pairs = [(names, len(by).bit_length())]
    words = _wide([*pairs, (np.concatenate([rank[2 : n + 2 : 3], rank[4 : n + 2 : 3]]), width)])
    before += np.searchsorted(words[n0:][third[~one]], words[:n0][rest])
    before += np.arange(len(rest))
    out = np.empty(n, np.int32)
    out[before] = 3 * rest
    free = np.ones(n, bool)
    free[before] = False
    out[free] = cover
    return out
