"""Elias-Fano sequences and a two-level n-gram trie made of them, queried by arrays.

A non-decreasing sequence keeps its low bits packed and its high bits in unary, so a value
costs about 2 + log2(universe / length) bits.  A successor search selects the zeros around
the bucket of the wanted high part and halves that bucket.

The trie's first level has the contexts and pointers to their children, the second the
children of one context after another.  Children are stored plus the largest value so far,
which makes the whole level one monotone sequence; a query adds the same base for its
context and looks for the successor there.  Levels are plain arrays that can be saved to a
folder and memory-mapped.
"""

from __future__ import annotations

import os

import numpy as np

_ONE = np.uint64(1)


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word."""
    place, w, k = np.zeros(len(words), np.uint64), words.copy(), k.astype(np.uint64).copy()
    for width in (32, 16, 8, 4, 2, 1):
        low = w & np.uint64((1 << width) - 1)
        n = np.bitwise_count(low).astype(np.uint64)
        up = k >= n
        k = np.where(up, k - n, k)
        w = np.where(up, w >> np.uint64(width), low)
        place += np.where(up, np.uint64(width), np.uint64(0))
    return place.astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of numbers below 2 ** 63."""

    names = ("low", "high", "zeros", "ones", "shape")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.low, self.high, self.zeros, self.ones, shape = (arrays[n] for n in self.names)
        self.n, self.bits = int(shape[0]), int(shape[1])

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        v, n = values.astype(np.uint64), len(values)
        universe = int(v[-1]) + 1 if n else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        length = (int(place[-1]) if n else 0) + 2
        flags = np.zeros(-(-length // 64) * 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(count)])
        return cls({"low": low, "high": high, "zeros": np.arange(len(ones)) * 64 - ones, "ones": ones, "shape": np.array([n, bits])})

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        behind = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, _ONE)), np.uint64(0))
        return ((self.low[word] >> shift) | behind) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.bits)) | self.low_of(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Places of the first values that are at least x (n if none)."""
        x = x.astype(np.uint64)
        part, rest = (x >> np.uint64(self.bits)).astype(np.int64), x & np.uint64((1 << self.bits) - 1)
        out = np.full(len(x), self.n, np.int64)
        inside = np.flatnonzero(part < int(self.zeros[-1])) if self.n else np.zeros(0, np.int64)
        p, rest = part[inside], rest[inside]
        # the bucket of p lies between the zeros p - 1 and p
        low = np.where(p > 0, self._zero(np.maximum(p - 1, 0)) + 1 - p, 0)
        high = self._zero(p) - p
        todo = np.flatnonzero(low < high)
        while len(todo):  # dense buckets are halved, not stepped through
            middle = (low[todo] + high[todo]) >> 1
            less = self.low_of(middle) < rest[todo]
            low[todo] = np.where(less, middle + 1, low[todo])
            high[todo] = np.where(less, high[todo], middle)
            todo = todo[low[todo] < high[todo]]
        out[inside] = low
        return out

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) zero."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + _select_in_word(~self.high[word], k - self.zeros[word])


class Trie:
    """Codes of (context, child) pairs: contexts ascending, children ascending within one."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, children: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.children, self.codes = contexts, pointers, children, codes

    @classmethod
    def of(cls, contexts: np.ndarray, first: np.ndarray, children: np.ndarray, codes: np.ndarray) -> "Trie":
        """first: where each context's children begin (one more than contexts)."""
        size = np.diff(first)
        last = np.cumsum(children[first[1:] - 1] + 1) if len(size) else np.zeros(0, np.int64)
        base = np.repeat(np.concatenate([[0], last[:-1]]) if len(size) else last, size)
        return cls(EliasFano.of(contexts), EliasFano.of(first), EliasFano.of(children + base), codes.astype(np.uint8))

    def save(self, folder: str) -> None:
        for name in ("contexts", "pointers", "children"):
            for part, array in getattr(self, name).arrays.items():
                np.save(os.path.join(folder, f"{name}.{part}.npy"), array)
        np.save(os.path.join(folder, "codes.npy"), self.codes)

    @classmethod
    def mapped(cls, folder: str) -> "Trie":
        """The trie in a folder, its levels memory-mapped."""
        load = lambda name: np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r")
        levels = [EliasFano({part: load(f"{name}.{part}") for part in EliasFano.names}) for name in ("contexts", "pointers", "children")]
        return cls(*levels, load("codes"))

    def context(self, contexts: np.ndarray) -> np.ndarray:
        """Places of the contexts, -1 where the trie doesn't have one."""
        at = self.contexts.successor(contexts)
        found = at < self.contexts.n
        found[found] = self.contexts.get(at[found]) == contexts[found].astype(np.uint64)
        return np.where(found, at, -1)

    def codes_of(self, place: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Codes of children below the contexts at `place` (as context() gives them); 0 where there is none."""
        out = np.zeros(len(place), np.uint8)
        known = np.flatnonzero(place >= 0)
        p, inverse = np.unique(place[known], return_inverse=True)
        a, b = self.pointers.get(p).astype(np.int64), self.pointers.get(p + 1).astype(np.int64)
        base = np.where(a > 0, self.children.get(np.maximum(a - 1, 0)).astype(np.int64) + 1, 0)
        wanted = (child[known] + base[inverse]).astype(np.uint64)
        at = self.children.successor(wanted)
        inside = np.flatnonzero(at < b[inverse])
        same = self.children.get(at[inside]) == wanted[inside]
        hit = inside[same]
        out[known[hit]] = self.codes[at[hit]]
        return out
