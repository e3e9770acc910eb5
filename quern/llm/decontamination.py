"""Benchmark decontamination with one Aho-Corasick automaton over the test items.

Texts are normalised (A-Z lower-cased, words of letters, digits and non-ASCII characters,
single spaces).  A window is WIDTH consecutive words of an item, or all words of a shorter
item.  The automaton holds seeds: runs of a few words at such a stride through every item
that each window has a whole one in it (of a shorter item, all its words).  A document is
scanned once; a seed found is extended to both sides for as long as document and item agree,
and if that run is as long as a window, its words are hit.  So every window is found, with a
twentieth of the nodes that all windows would take.  Offsets of the hits are mapped back to
characters of the original text.

A benchmark of more than BLOCK_WORDS words is held as several automata of that size, each
broadcast by itself and named by a digest of its items, all of which a worker keeps: its
memory follows the benchmark (some 300 bytes a word), and never the documents.

Defined results: null and empty texts, and texts without words, have no words and no hit;
an item without words has no window; an item with a null id hits words and is not listed.
Repeated items count once; repeated documents are scanned one by one.  An empty benchmark hits
nothing, an empty table gives an empty one.  Very long texts are scanned whole.  keep() passes
columns of any name on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm import common as C

WIDTH = 13
BLOCK_WORDS = 400_000

#: Lower-cases A-Z; bytes outside words become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = C.byte_table([b for b in range(256) if _TABLE[b] != 32])
#: An item: its normalised words, and the ids that have them.
Item = tuple[tuple[bytes, ...], tuple[str, ...]]
_built: dict[tuple[str, int], tuple[ahocorasick.Automaton, list]] = {}


def normalised(text: bytes) -> bytes:
    return b" ".join(text.translate(_TABLE).split())


def item_blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[tuple[str, list[Item]]]:
    """Items in blocks of about `most` words, with a digest of each block; they stream through the driver."""

    def closed(block: dict[tuple[bytes, ...], list[str]]) -> tuple[str, list[Item]]:
        items = [(words, tuple(sorted(ids))) for words, ids in sorted(block.items())]
        return hashlib.sha256(repr(items).encode()).hexdigest(), items

    block: dict[tuple[bytes, ...], list[str]] = {}
    size = 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        words = tuple(normalised((text or "").encode()).split())
        if not words:
            continue
        if words not in block:
            if size and size + len(words) > most:
                yield closed(block)
                block, size = {}, 0
            size += len(words)
        ids = block.setdefault(words, [])
        if item is not None and str(item) not in ids:
            ids.append(str(item))
    if block:
        yield closed(block)


def seeds(n: int, width: int) -> list[tuple[int, int]]:
    """(place, words) of the seeds of an item of n words: every `width` words in a row hold a whole one."""
    if n <= width:
        return [(0, n)]
    size = (width + 2) // 3
    return [(at, size) for at in range(0, n - size + 1, width - size + 1)]


def automaton(key: str, items: list[Item], width: int) -> tuple[ahocorasick.Automaton, list]:
    """The automaton of a block and the (words, [(item, place)]) of its values; it stays in the worker."""
    if (key, width) not in _built:
        places: dict[bytes, list[tuple[int, int]]] = {}
        for k, (words, _) in enumerate(items):
            for at, size in seeds(len(words), width):
                places.setdefault(b" ".join(words[at : at + size]), []).append((k, at))
        made, values = ahocorasick.Automaton(), []
        for seed, of in places.items():
            made.add_word(f" {seed.decode('latin-1')} ", len(values))
            values.append((seed.count(b" ") + 1, of))
        if values:
            made.make_automaton()
        _built[key, width] = made, values
    return _built[key, width]


def scan(texts: list[bytes], blocks: list[tuple[str, list[Item]]], width: int = WIDTH) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: its number of words, the hit runs of words [a, b), and the items found."""
    for old in _built.keys() - {(key, width) for key, _ in blocks}:  # of earlier benchmarks
        del _built[old]
    pieces = [normalised(t) for t in texts]
    whole = " " + " \n ".join(p.decode("latin-1") for p in pieces) + " "
    begin = np.cumsum([1] + [len(p) + 3 for p in pieces])[:-1]
    words_of: dict[int, tuple[list[bytes], np.ndarray]] = {}
    runs: dict[int, set[tuple[int, int]]] = {}
    found: dict[int, set[str]] = {}
    for key, items in blocks:
        made, values = automaton(key, items, width)
        if not values:
            continue
        ends, which = [], []
        for end, k in made.iter(whole):
            ends.append(end)
            which.append(k)
        # a match's last character is the space behind its last word
        for d, end, k in zip((np.searchsorted(begin, np.array(ends, np.int64) - 1, "right") - 1).tolist(), ends, which, strict=True):
            if d not in words_of:
                words_of[d] = pieces[d].split(b" "), np.flatnonzero(np.frombuffer(pieces[d], np.uint8) == 32)
            words, gaps = words_of[d]
            size, places = values[k]
            last = int(np.searchsorted(gaps, end - int(begin[d])))  # the word in front of that space
            for item, at in places:
                wanted, ids = items[item]
                a, b, x, y = last - size + 1, last + 1, at, at + size
                while a and x and words[a - 1] == wanted[x - 1]:
                    a, x = a - 1, x - 1
                while b < len(words) and y < len(wanted) and words[b] == wanted[y]:
                    b, y = b + 1, y + 1
                if b - a >= min(width, len(wanted)):
                    runs.setdefault(d, set()).add((a, b))
                    found.setdefault(d, set()).update(ids)
    out = []
    for d, p in enumerate(pieces):
        joined: list[tuple[int, int]] = []
        for a, b in sorted(runs.get(d, ())):
            if joined and a <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
            else:
                joined.append((a, b))
        out.append((p.count(b" ") + 1 if p else 0, joined, found.get(d, set())))
    return out


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Character offsets [start, end) in the original text of runs of words."""
    if not runs:
        return []
    flat = C.Flat(pa.array([text], pa.binary()))
    starts, ends, _ = flat.words(_WORD)
    points = np.cumsum((flat.data & 0xC0) != 0x80)
    return [{"start": int(points[starts[a]] - 1), "end": int(points[ends[b - 1] - 1])} for a, b in runs]


RESULT = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>, contaminated boolean"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _shared(benchmark: DataFrame) -> list:
    """The blocks as (digest, broadcast): a worker that has seen another benchmark can't take its automata for these."""
    sc = benchmark.sparkSession.sparkContext
    return [(key, sc.broadcast(items)) for key, items in item_blocks(benchmark)]


def _scanned(block: pa.RecordBatch, blocks: list, width: int):
    texts = [t or b"" for t in block.column("text").cast(pa.binary()).to_pylist()]
    found = scan(texts, [(key, b.value) for key, b in blocks], width)
    return texts, found, [sum(b - a for a, b in runs) for _, runs, _ in found]


def match(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Words, hit words, items found and their places in the original text, for every document."""
    blocks = _shared(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.in_blocks(batches):
            texts, found, hits = _scanned(block, blocks, width)
            bad = [h > 0 and 20 * h >= n for h, (n, _, _) in zip(hits, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"), pa.array([n for n, _, _ in found], pa.int64()), pa.array(hits, pa.int64()), pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string())),
                    pa.array([original_spans(t, runs) for t, (_, runs, _) in zip(texts, found, strict=True)], _SPANS), pa.array(bad, pa.bool_()),
                ],
                ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, RESULT)


def keep(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without a hit word, with all their columns. A window in a long text is as much of a leak as one in a short text, so any hit removes the document, whatever its share."""
    blocks = _shared(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.in_blocks(batches):
            yield block.filter(pa.array([not h for h in _scanned(block, blocks, width)[2]], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
