"""Token ids of whole texts, a block at a time.

A byte-level BPE cuts a text into pieces by a fixed pattern and merges inside pieces only,
so equal pieces have equal ids.  The cuts are found with array passes over the code points,
and equal pieces of a block are found by Arrow.  The merges of the tokenizers file are then
applied to all distinct pieces at once: the pieces of most symbols take one merge each, that
of the least rank and leftmost among equals, and join those of one symbol less.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from quern.llm import common as C

#: Longer pieces (in bytes) go to the tokenizer itself.
LONGEST = 40
_OTHER_SPACE, _SPACE, _LETTER, _NUMBER, _REST = range(5)
#: The code points of \s besides the plain space.
_SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    if not _kinds:
        table = np.full(0x110000, _REST, np.uint8)
        for k in range(0x110000):
            c = unicodedata.category(chr(k))[0]
            if c in "LN":
                table[k] = _LETTER if c == "L" else _NUMBER
        table[list(_SPACES)] = _OTHER_SPACE
        table[32] = _SPACE
        _kinds.append(table)
    return _kinds[0]


#: What may follow an apostrophe in a piece of its own.
_ONE, _TWO = "stmd", ("re", "ve", "ll")


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of documents that begin at first[:-1]."""
    n = len(points)
    start = np.zeros(n, bool)
    if not n:
        return start
    kind = kinds()[points]
    space = kind <= _SPACE
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 9, kind[:-1]
    before[begins[:-1]] = 9
    start |= ~space & (before != kind) & (before != _SPACE)
    after_space = np.flatnonzero(~space & (before == _SPACE))
    start[after_space - 1] = True
    start |= space & (begins[:-1] | (before > _SPACE))
    # of a run of spaces before a word, the last is apart
    last = space.copy()
    last[:-1] &= ~space[1:] & ~begins[1:-1]
    last[-1] = False
    start |= last
    # an apostrophe that begins a piece takes the end of a contraction with it
    at = np.flatnonzero(start & (points == 39))
    if len(at):
        end = first[np.searchsorted(first, at, "right")]
        letter = lambda k: np.where(at + k < end, points[np.minimum(at + k, n - 1)], 0)
        one, two = letter(1), letter(2)
        size = np.isin(one, [ord(c) for c in _ONE]).astype(np.int64)
        for a, b in _TWO:
            size[(one == ord(a)) & (two == ord(b))] = 2
        at, size, end = at[size > 0], size[size > 0], end[size > 0]
        start[at + 1] = False
        behind = at + 1 + size
        start[behind[behind < end]] = True
    return start


class Merges:
    """The merges of a byte-level BPE as a hash table of pairs; ids are below 2 ** 16."""

    NONE = np.int32((1 << 31) - 1)

    def __init__(self, path: str, bits: int = 18):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if max(vocab.values()) >= 1 << 16 or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("not a plain byte-level BPE of fewer than 65,536 ids")
        # the printable stand-ins of bytes: those of a printable byte are itself, the others follow from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(printable)]
        stands = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.of_byte = np.array([vocab[stands[b]] for b in range(256)], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.zeros(1 << bits, np.uint32), np.full(1 << bits, self.NONE, np.int32)
        todo, slot = np.arange(len(keys)), self.slot(keys)
        while len(todo):  # the first of those that want a free slot gets it
            free = np.flatnonzero(self.ranks[slot] == self.NONE)
            _, own = np.unique(slot[free], return_index=True)
            won = free[own]
            self.keys[slot[won]], self.ranks[slot[won]] = keys[todo[won]], todo[won]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE for those that don't merge."""
        keys = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        slot = self.slot(keys)
        out = self.ranks[slot]
        todo = np.flatnonzero((self.keys[slot] != keys) & (out != self.NONE))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            found = self.ranks[slot]
            out[todo] = found
            on = (self.keys[slot] != keys[todo]) & (found != self.NONE)
            todo, slot = todo[on], slot[on]
        return out

    def apply(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces data[begin:begin + size], piece by piece, and how many each has."""
        count = np.ones(len(size), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(-size, kind="stable")
        lengths = -size[order]
        longest = int(size.max(initial=0))
        which = np.zeros(0, np.int64)
        x, r = np.zeros((0, longest), np.int32), np.zeros((0, max(longest - 1, 0)), np.int32)
        for n in range(longest, 0, -1):
            new = order[np.searchsorted(lengths, -n, "left") : np.searchsorted(lengths, -n, "right")]
            if len(new):
                fresh = self.of_byte[data[begin[new][:, None] + np.arange(n)]]
                x = np.concatenate([x, fresh])
                r = np.concatenate([r, self.rank(fresh[:, :-1].ravel(), fresh[:, 1:].ravel()).reshape(len(new), n - 1)])
                which = np.concatenate([which, new])
            if not len(which):
                x, r = x[:, : n - 1], r[:, : max(n - 2, 0)]
                continue
            if n == 1:
                done.append((which, x))
                count[which] = 1
                break
            j = r.argmin(1)
            least = r[np.arange(len(r)), j]
            on = least != self.NONE
            if not on.all():
                done.append((which[~on], x[~on]))
                count[which[~on]] = n
                which, x, r, j, least = which[on], x[on], r[on], j[on], least[on]
            row = np.arange(len(x))
            x[row, j] = self.made[least]
            x = np.where(np.arange(n - 1) <= j[:, None], x[:, :-1], x[:, 1:])
            r = np.where(np.arange(n - 2) < j[:, None], r[:, :-1], r[:, 1:])
            some = np.flatnonzero(j > 0)
            r[some, j[some] - 1] = self.rank(x[some, j[some] - 1], x[some, j[some]])
            some = np.flatnonzero(j < n - 2)
            r[some, j[some]] = self.rank(x[some, j[some]], x[some, j[some] + 1])
        first = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.uint32)
        for w, ids in done:
            out[first[w][:, None] + np.arange(ids.shape[1])] = ids
        return out, count


class Tokens:
    """Ids by a tokenizers file, one tokenizer per worker."""

    _made: dict[str, "Tokens"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = Merges(path)

    @classmethod
    def of(cls, path: str) -> "Tokens":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By the tokenizer itself: ids in a row, and how many of each text."""
        ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        count = np.array([len(x) for x in ids], np.int64)
        return np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum())), count

    def of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row, and how many of each."""
        flat = C.Flat(pieces)
        size = np.diff(flat.off)
        long = np.flatnonzero(size > LONGEST)
        if not len(long):
            return self.merges.apply(flat.data, flat.off[:-1], size)
        short = np.flatnonzero(size <= LONGEST)
        ids, few = self.merges.apply(flat.data, flat.off[short], size[short])
        more, many = self.encode([p.decode("utf-8") for p in pieces.take(pa.array(long)).to_pylist()])
        count = np.empty(len(size), np.int64)
        count[short], count[long] = few, many
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.uint32)
        out[C.take_spans(first[short], first[short] + few)] = ids
        out[C.take_spans(first[long], first[long] + many)] = more
        return out, count

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and each text's first (n + 1 values)."""
        flat = C.Flat(texts)
        try:
            points = np.frombuffer(flat.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        except UnicodeDecodeError:
            ids, count = self.encode([bytes(flat.data[a:b]).decode("utf-8", "replace") for a, b in zip(flat.off[:-1], flat.off[1:], strict=True)])
            return ids, np.concatenate([[0], np.cumsum(count)])
        byte = np.append(np.flatnonzero((flat.data & 0xC0) != 0x80), len(flat.data))
        begin = byte[:-1][piece_starts(points, np.searchsorted(byte, flat.off))]
        ends = np.append(begin, len(flat.data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat.data))])
        which, distinct = C.encoded(pieces)
        first = np.searchsorted(begin, flat.off)
        if not len(begin):
            return np.zeros(0, np.uint32), first
        ids, count = self.of_pieces(distinct)
        a = (np.cumsum(count) - count)[which]
        size = count[which]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        return ids[C.take_spans(a, a + size)], total[first]
