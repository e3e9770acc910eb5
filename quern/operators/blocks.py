"""Documents as rows (doc_id, lengths), the tokens of their units in order: windows and chunks by array passes, without a shuffle.

A batch is cut into blocks of BLOCK_UNITS units (a document is never cut), so a task's memory
doesn't depend on the number of documents, and grows with the longest document alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Units handled at once by one task.
BLOCK_UNITS = 1 << 17


class Block:
    """The units of some documents, flat: unit u has tokens [start[u], start[u] + n[u]) of its block, and is number ordinal[u] of document doc[u].

    first[d] and size[d] are a document's first unit and its number of units. Units without tokens are left out, as splitting.subchunks does.
    """

    def __init__(self, counts: np.ndarray, lengths: np.ndarray):
        doc = np.repeat(np.arange(len(counts)), counts)
        ordinal = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts, counts)
        some = lengths > 0
        self.doc, self.ordinal, self.n = doc[some], ordinal[some], lengths[some].astype(np.int64)
        self.end = np.cumsum(self.n)
        self.start = self.end - self.n
        self.size = np.bincount(self.doc, minlength=len(counts))
        self.first = np.cumsum(self.size) - self.size

    def local_start(self) -> np.ndarray:
        """The start of each unit in its document."""
        return self.start - self.start[self.first[self.doc]]


def cut(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of rows of these sizes, `most` in all each, or one row."""
    off, a = np.concatenate([[0], np.cumsum(sizes)]), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


def blocks(lengths: pa.Array, most: int) -> Iterator[tuple[int, Block]]:
    """(number of the first row, block) of a list column, `most` units a block or one document; a null list is empty."""
    counts = np.asarray(lengths.value_lengths().fill_null(0), np.int64)
    flat, off = np.asarray(lengths.flatten()), np.concatenate([[0], np.cumsum(counts)])
    for a, b in cut(counts, most):
        yield a, Block(counts[a:b], flat[off[a] : off[b]])


def mapped(lengths: DataFrame, found: Callable[[Block], tuple[np.ndarray, dict[str, np.ndarray]]], kinds: str) -> DataFrame:
    """(doc_id, ...): what `found` has of each block: the document of each row, and the other columns, of which kinds is the schema."""
    key = f"doc_id {lengths.schema['doc_id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at, block in blocks(batch.column("lengths"), BLOCK_UNITS):
                doc, columns = found(block)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc + at)), *map(pa.array, columns.values())], ["doc_id", *columns])

    return lengths.select("doc_id", "lengths").mapInArrow(run, f"{key}, {kinds}")


def grown(b: Block, budget: int, overhead: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) unit of each unit's window, grown left and right in turn within the budget, then on the side that has units left.

    Only units whose tokens begin within the budget of the centre's are reached; those beyond
    take their turn without being counted. The tokens of the first p places are a difference
    of sums that never falls with p, so the last place that fits is found by bisection.
    """
    i = np.arange(len(b.n))
    low, high = b.first[b.doc], b.first[b.doc] + b.size[b.doc] - 1
    m, more_left = np.minimum(i - low, high - i), i - low > high - i
    near_low = np.maximum(low, np.searchsorted(b.start, b.start - budget, "left"))
    near_high = np.minimum(high, np.searchsorted(b.start, b.start + budget, "right") - 1)

    def reached(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one_side = p > 2 * m
        left = np.where(one_side, np.where(more_left, p - m, m), (p + 1) // 2)
        right = np.where(one_side, np.where(more_left, m, p - m), p // 2)
        return np.maximum(i - left, near_low), np.minimum(i + right, near_high)

    least, most = np.zeros(len(i), np.int64), np.minimum(high - low, 2 * (budget + 1))  # beyond, both sides are out of reach
    while (least < most).any():
        p = (least + most + 1) // 2
        l, r = reached(p)
        fits = b.end[r] - b.start[l] + overhead <= budget
        least, most = np.where(fits, p, least), np.where(fits, most, p - 1)
    return reached(least)


def members(b: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, window, chunk): the units that overlap each window of `size` tokens, by document and window; chunk numbers the windows of all documents."""
    start = b.local_start()
    one, last = start // size, (start + b.n - 1) // size
    times = last - one + 1
    unit = np.repeat(np.arange(len(start)), times)
    window = np.arange(len(unit)) - np.repeat(np.cumsum(times) - times, times) + one[unit]
    new = np.ones(len(unit), bool)
    new[1:] = (b.doc[unit][1:] != b.doc[unit][:-1]) | (window[1:] != window[:-1])
    return unit, window, np.cumsum(new) - 1
