"""Top-k retrieval and late-interaction scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import EPSILON, dot, normalized

#: Query vectors that are broadcast at once.
QUERY_BLOCK = 4_096
#: Query vectors and corpus vectors whose products a task holds at once.
QUERY_TILE, ROW_TILE = 512, 2_048


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class _Rows:
    """Some vectors with their lengths."""

    def __init__(self, x: np.ndarray):
        self.x, self.square = x, (x**2).sum(1)
        self.norm = np.linalg.norm(x, axis=1)
        if not np.isfinite(self.square).all():
            raise ValueError("vectors must be finite")
        self.unit = x / self.norm[:, None] if len(x) and self.norm.min() > EPSILON else None


class _Best:
    """The k best ids of each query vector of a tile, ties to the smaller id; of `per` consecutive ids the best one counts.

    A product of matrices only says which pairs may reach the k-th score so far. Those are scored one
    by one, so the score of a pair doesn't depend on where in a batch it stands.
    """

    def __init__(self, q: np.ndarray, k: int, metric: str, digits: int, per: int):
        self.q, self.k, self.metric, self.digits, self.per = _Rows(q), k, metric, digits, per
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(q), -np.inf)

    def _rough(self, c: _Rows) -> tuple[np.ndarray, np.ndarray]:
        """All scores, but for rounding, and how far a query's may be off."""
        q = self.q
        if self.metric == "cosine":
            if q.unit is not None and c.unit is not None and q.norm.min() * c.norm.min() >= EPSILON:
                s = q.unit @ c.unit.T
            else:
                s = q.x @ c.x.T / np.maximum(np.outer(q.norm, c.norm), EPSILON)
            scale = np.ones(len(q.x))
        else:
            s, scale = q.x @ c.x.T, q.norm * c.norm.max()
            if self.metric == "l2":
                s *= 2
                s -= q.square[:, None]
                s -= c.square[None]
                scale = 2 * scale + q.square + c.square.max()
        return s, 10.0**-self.digits + 1e-11 * scale

    def _scores(self, row: np.ndarray, at: np.ndarray, c: _Rows) -> np.ndarray:
        q, s, step = self.q, np.empty(len(row)), 1 << 14
        for i in range(0, len(row), step):
            s[i : i + step] = np.einsum("ij,ij->i", q.x[row[i : i + step]], c.x[at[i : i + step]])
        if self.metric == "cosine":
            s /= np.maximum(q.norm[row] * c.norm[at], EPSILON)
        elif self.metric == "l2":
            s = 2 * s - q.square[row] - c.square[at]
        return np.round(s, self.digits) + 0.0

    def add(self, c: _Rows, ids: np.ndarray) -> None:
        own, n = ids // self.per, len(self.least)
        rough, off = self._rough(c)
        floor = self.least - off
        mask = rough >= floor[:, None]
        if np.count_nonzero(mask) > 4 * self.k * n:  # the k-th best of these ids alone is a bound, too
            by = np.argsort(own, kind="stable")
            head = np.flatnonzero(np.diff(own[by], prepend=own[by[0]] - 1)) if self.per > 1 else by
            if len(head) > self.k:
                tops = np.maximum.reduceat(rough[:, by], head, axis=1) if self.per > 1 else rough.copy()
                tops.partition(len(head) - self.k, axis=1)
                floor = np.maximum(floor, tops[:, len(head) - self.k] - 2 * off)
                mask = rough >= floor[:, None]
        row, at = np.nonzero(mask)
        if not len(row):
            return
        row, id_, score = np.append(self.row, row), np.append(self.id, own[at]), np.append(self.score, self._scores(row, at, c))
        by = np.lexsort((id_, -score, row))
        row, id_, score = row[by], id_[by], score[by]
        if self.per > 1:
            again = np.lexsort((np.arange(len(row)), id_, row))
            first = np.ones(len(row), bool)
            first[1:] = (row[again][1:] != row[again][:-1]) | (id_[again][1:] != id_[again][:-1])
            kept = np.sort(again[first])
            row, id_, score = row[kept], id_[kept], score[kept]
        kept = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row] < self.k
        self.row, self.id, self.score = row[kept], id_[kept], score[kept]
        last = np.searchsorted(self.row, np.arange(n), "right") - 1
        self.least = np.where(np.bincount(self.row, minlength=n) == self.k, self.score[last], -np.inf)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", digits: int = 6, block: int = QUERY_BLOCK, per: int = 1) -> DataFrame:
    """(query_id, id, score, rank): for each of queries (query_id, vector) the k nearest rows of corpus (id, vector), exact.

    per: the k nearest groups of `per` consecutive ids, each by its best vector; their id is the quotient.

    Queries go out in blocks of bounded size; a task scores tiles of queries and rows and keeps the
    best k of each query so far, so its memory depends on neither table, and only k rows a query
    and task are shuffled.  Ties go to the smaller id.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    schema = "query_id bigint, id bigint, score double"
    parts: list[DataFrame] = []
    held: list[tuple[int, list[float]]] = []

    def part(rows: list[tuple[int, list[float]]]) -> DataFrame:
        ids, vectors = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
        shared = corpus.sparkSession.sparkContext.broadcast((ids, vectors))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            tiles = [_Best(q[i : i + QUERY_TILE], k, metric, digits, per) for i in range(0, len(q), QUERY_TILE)]
            for batch in batches:
                for i in range(0, batch.num_rows, ROW_TILE):
                    some = batch.slice(i, ROW_TILE)
                    c, own = _Rows(_matrix(some.column("vector"))), np.asarray(some.column("id")).astype(np.int64)
                    for tile in tiles:
                        tile.add(c, own)
            for i, tile in enumerate(tiles):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i * QUERY_TILE + tile.row]), pa.array(tile.id), pa.array(tile.score)], ["query_id", "id", "score"])

        return corpus.select("id", "vector").mapInArrow(run, schema)

    for row in queries.select("query_id", "vector").toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == block:
            parts.append(part(held))
            held = []
    if held:
        parts.append(part(held))
    if not parts or not k:
        return corpus.sparkSession.createDataFrame([], schema + ", rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    if per > 1:  # a group may lie in several tasks
        found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def sentence_maxima(candidates: DataFrame, query_tokens: DataFrame, token_vectors: DataFrame, digits: int = 6) -> DataFrame:
    """(query_id, query_token, subchunk_id, score): the best token of each candidate subchunk for each query token.

    candidates (query_id, subchunk_id), query_tokens (query_id, query_token, vector),
    token_vectors (subchunk_id, vector).  A subchunk is scored once, however many regions hold it.
    """
    rows = candidates.select("query_id", "subchunk_id").distinct().join(token_vectors.select("subchunk_id", F.col("vector").alias("d")), "subchunk_id").join(query_tokens.select("query_id", "query_token", F.col("vector").alias("q")), "query_id")
    return rows.groupBy("query_id", "query_token", "subchunk_id").agg(F.max(F.round(dot(F.col("q"), F.col("d")), digits)).alias("score"))


def region_scores(maxima: DataFrame, regions: DataFrame, digits: int = 5) -> DataFrame:
    """(query_id, region_key, score): the sum over query tokens of the best member; -inf for a region without a scored member.

    regions (query_id, region_key, start, end), members [start, end).
    """
    members = regions.select("query_id", "region_key", F.explode(F.sequence("start", F.col("end") - 1)).alias("subchunk_id"))
    best = members.join(maxima, ["query_id", "subchunk_id"]).groupBy("query_id", "region_key", "query_token").agg(F.max("score").alias("m"))
    scores = best.groupBy("query_id", "region_key").agg(F.round(F.sum(F.col("m").cast("decimal(20,6)")), digits).cast("double").alias("score"))
    return regions.select("query_id", "region_key").distinct().join(scores, ["query_id", "region_key"], "left").fillna({"score": float("-inf")})


def direct_maxsim(maxima: DataFrame) -> DataFrame:
    """(query_id, subchunk_id, score): the sum over query tokens."""
    return maxima.groupBy("query_id", "subchunk_id").agg(F.round(F.sum(F.col("score").cast("decimal(20,6)")), 5).cast("double").alias("score"))


def normalized_vectors(rows: DataFrame, column: str = "vector") -> DataFrame:
    return rows.withColumn(column, normalized(F.col(column)))
