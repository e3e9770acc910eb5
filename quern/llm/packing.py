"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

Documents become pieces of at most CAPACITY tokens.  Pieces that fill a sequence are done;
the others are dealt evenly to regions of bounded size.  A region evolves on ISLANDS
islands: a solution is a set of bins, crossover injects whole well-filled bins of one
parent into the other, drops the duplicates, and best-fits the displaced pieces.  After
each epoch every island's elite migrates to its neighbour through a join.  Bins that the
best solution of a region leaves short are dealt and packed again with those of other
regions, until one region is left.

Defined results: a null or empty text is the end token alone.  Repeated rows are packed
one by one.  An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common as C
from quern.llm.tokenizing import Tokens

CAPACITY, END = 2048, 0
#: Pieces of a region, islands of a region, solutions of an island, epochs, generations in one.
REGION, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 6_000, 2, 4, 2, 5
#: A bin filled less than this is dealt again.
SHORT = 0.995


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, an end token behind its ids. tokenizer: a file on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(tokenizer)
        for block in C.in_blocks(batches, budget=2 << 20):
            ids, first = tokens.of_texts(block.column("text"))
            ids = np.insert(ids, first[1:], END)
            first = first + np.arange(len(first))
            size = np.diff(first)
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            head = size - (n - 1) * capacity
            start = np.where(k > 0, head[doc] + (k - 1) * capacity, 0)
            length = np.where(k > 0, capacity, head[doc])
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((first[doc] + start).tolist(), (first[doc] + start + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(pa.array(doc)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


# --- one region ---


class Bins:
    """Open bins by room left; the fullest with room for a piece is found in one step."""

    def __init__(self, capacity: int):
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, b: int, room: int) -> None:
        self.by_room[room].append(b)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        m = self.mask >> size
        if not m:
            return None
        room = size + (m & -m).bit_length() - 1
        b = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask ^= 1 << room
        return b, room


def best_fit(size: np.ndarray, bin_of: np.ndarray, todo: np.ndarray, capacity: int) -> np.ndarray:
    """bin_of with the pieces `todo` (in that order) put where least room is left; others stay. Bins are numbered anew."""
    out = bin_of.copy()
    rest = np.ones(len(size), bool)
    rest[todo] = False
    used, number = np.unique(out[rest], return_inverse=True)
    out[rest] = number
    filled = np.bincount(number, size[rest], len(used)).astype(np.int64)
    bins, n = Bins(capacity), len(used)
    for b, f in enumerate(filled.tolist()):
        bins.put(b, capacity - f)
    for i, s in zip(todo.tolist(), size[todo].tolist(), strict=True):
        got = bins.take(s)
        b, room = got if got else (n, capacity)
        n += not got
        out[i] = b
        bins.put(b, room - s)
    return out


def fitness(size: np.ndarray, bin_of: np.ndarray, capacity: int) -> float:
    """Fewer bins first, then fuller ones."""
    filled = np.bincount(bin_of, size) / capacity
    return float(-len(filled) + (filled**2).mean()) if len(filled) else 0.0


def crossover(size: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int, rng: np.random.Generator, part: float = 0.15) -> np.ndarray:
    """Whole well-filled bins of the giver go into the taker; its other copies of their pieces go, and pieces of bins broken open that way are fitted again."""
    filled = np.bincount(giver, size)
    full = np.argsort(-filled, kind="stable")[: max(1, len(filled) // 2)]
    chosen = rng.choice(full, max(1, int(len(full) * 2 * part)), replace=False)
    moved = np.isin(giver, chosen)
    out = taker.copy()
    broken = np.unique(taker[moved])
    left = np.bincount(taker[~moved], size[~moved], len(np.bincount(taker)))
    dissolved = broken[left[broken] < capacity / 2]
    out[moved] = giver[moved] + len(left)
    displaced = np.flatnonzero(~moved & np.isin(taker, dissolved))
    return best_fit(size, out, displaced[np.argsort(-size[displaced], kind="stable")], capacity)


def mutated(size: np.ndarray, bin_of: np.ndarray, capacity: int, rng: np.random.Generator, bins: int = 4) -> np.ndarray:
    """The emptiest bins and some others are dissolved and their pieces fitted again, largest first."""
    filled = np.bincount(bin_of, size)
    gone = np.concatenate([np.argsort(filled, kind="stable")[:bins], rng.integers(0, len(filled), bins)])
    todo = np.flatnonzero(np.isin(bin_of, gone))
    return best_fit(size, bin_of, todo[np.argsort(-size[todo], kind="stable")], capacity)


def evolve(size: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> np.ndarray:
    """The best solution of an island that starts from the elites and random best fits."""
    rng = np.random.default_rng(seed)
    least = -(-int(size.sum()) // capacity)
    members = list(elites)
    while len(members) < population:
        noise = 0.0 if not members else 0.15
        order = np.argsort(-size * (1 + noise * rng.random(len(size))), kind="stable")
        members.append(best_fit(size, np.zeros(len(size), np.int64), order, capacity))
    scored = sorted(((fitness(size, m, capacity), k, m) for k, m in enumerate(members)), reverse=True)
    for g in range(generations):
        if not len(size) or int(scored[0][2].max()) + 1 <= least:
            break
        i, j = rng.choice(len(scored), 2, replace=False)
        for a, b in ((i, j), (j, i)):
            child = mutated(size, crossover(size, scored[a][2], scored[b][2], capacity, rng), capacity, rng)
            scored.append((fitness(size, child, capacity), population * (g + 2) + len(scored), child))
        scored = sorted(scored, reverse=True)[:population]
    return scored[0][2]


# --- over the cluster ---

_ITEM = "array<struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"


def _regions(items: DataFrame, n: int, region: int, base: int) -> DataFrame:
    """(region, items): rows dealt evenly, at most `region` in one."""
    parts = max(1, -(-n // region))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, k = [], 0, 0
        number = lambda k: base + (TaskContext.get().partitionId() << 20) + k

        def made(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(batches).combine_chunks()
            struct = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns], table.schema.names)
            struct = struct.combine_chunks() if isinstance(struct, pa.ChunkedArray) else struct
            return pa.RecordBatch.from_arrays([pa.array([number(k)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct)], ["region", "items"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, region - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == region:
                    yield made(held)
                    held, rows, k = [], 0, k + 1
        if rows:
            yield made(held)

    return items.repartition(parts).mapInArrow(run, f"region bigint, items {_ITEM}")


def _evolved(epoch: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                size = np.asarray(batch.column("size")[r].values).astype(np.int64)
                elites = [np.asarray(e.values).astype(np.int64) for e in batch.column("elites")[r]]
                region, island = batch.column("region")[r].as_py(), batch.column("island")[r].as_py()
                best = evolve(size, elites, capacity, seed=(region * 31 + island * 7 + epoch) % (1 << 32))
                out.append((region, island, fitness(size, best, capacity), best.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.list_(pa.int32()))], ["region", "island", "fitness", "best"])

    return run


def _solved(regions: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """(region, best): the best solution of each region after all epochs."""
    sizes = regions.select("region", F.col("items.length").alias("size"))
    on = sizes.crossJoin(regions.sparkSession.range(islands).select(F.col("id").cast("int").alias("island")))  # a fixed number of islands
    state = on.withColumn("elites", F.array().cast("array<array<int>>"))
    schema = "region bigint, island int, fitness double, best array<int>"
    for epoch in range(epochs):
        state = state.repartition("region", "island")
        best = C.stored(state.mapInArrow(_evolved(epoch, capacity), schema))
        if epoch + 1 < epochs:  # an island goes on from its own elite and its neighbour's
            own = best.select("region", "island", F.col("best").alias("own"))
            visitor = best.select("region", ((F.col("island") + 1) % islands).alias("island"), F.col("best").alias("visitor"))
            state = on.join(own, ["region", "island"]).join(visitor, ["region", "island"]).select("region", "size", "island", F.array("own", "visitor").alias("elites"))
    return best.groupBy("region").agg(F.max_by("best", F.struct("fitness", "island")).alias("best"))


def _placed(capacity: int, short: float):
    """A row for each piece: its sequence and place there, or again = true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                items, bin_of = batch.column("items")[r].values, np.asarray(batch.column("best")[r].values).astype(np.int64)
                size = np.asarray(items.field("length"))
                order = np.argsort(bin_of, kind="stable")
                before = np.cumsum(size[order]) - size[order]
                begin = np.searchsorted(bin_of[order], np.arange(int(bin_of.max()) + 1)) if len(bin_of) else np.zeros(0, np.int64)
                offset = np.zeros(len(size), np.int64)
                offset[order] = before - before[begin][bin_of[order]]
                again = (np.bincount(bin_of, size) < short * capacity)[bin_of]
                sequence = (batch.column("region")[r].as_py() << 13) + bin_of
                yield pa.RecordBatch.from_arrays([*(items.field(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset), pa.array(again)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "again"])

    return run


_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, again boolean"


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, region: int = REGION, islands: int = ISLANDS, epochs: int = EPOCHS, short: float = SHORT) -> DataFrame:
    """Pieces of all documents with sequence_id and offset."""
    every = C.stored(pieces(documents, tokenizer, capacity))
    done = [every.where(F.col("length") == capacity).select(*_COLUMNS, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    todo, level = every.where(F.col("length") < capacity), 0
    while True:
        n = todo.count()
        regions = C.stored(_regions(todo, n, region, level << 44))
        last = n <= region or level > 30
        placed = C.stored(regions.join(_solved(regions, capacity, islands, epochs), "region").mapInArrow(_placed(capacity, 0.0 if last else short), _PLACED))
        done.append(placed.where(~F.col("again")).select(*_COLUMNS, "sequence_id", "offset"))
        if last:
            break
        left = placed.where("again").select(*_COLUMNS)
        short, todo, level = (short if left.count() < 0.7 * n else short - 0.1), left, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out
