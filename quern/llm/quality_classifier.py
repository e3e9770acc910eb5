"""Quality classifier: naive-Bayes-scaled n-gram indicators under a linear hinge-loss model.

An n-gram is a hash of one to three neighbouring words' shapes (letters by case, digits,
other bytes as they are, runs collapsed; a word equal to its predecessor is marked) or of
one or two lower-cased words.  A document is the set of its n-grams, each scaled by its
class log-count ratio, divided by the vector's length.  The linear model on top is solved
by dual coordinate descent; a sigmoid fitted on rows kept from it gives the probability.

Defined results: a null or empty text has no n-gram and gets the bias alone.  With no
labels, or one class, every score is that of the class seen (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from quern.llm import common as C
from quern.llm import linear_svm as S

#: At most this many labelled documents of each class train the model.
TRAIN_ROWS = 4_000
#: n-grams are hashed to this many places.
PLACES = 1 << 20

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = ord("A"), ord("a"), ord("0"), ord("a")


def _string_hashes(words: pa.Array, table: np.ndarray, squeeze: bool) -> np.ndarray:
    """64-bit hashes of byte strings after a byte table, runs of one byte collapsed if asked: a sum of byte values times powers, mixed."""
    flat = C.Flat(words)
    data = table[flat.data]
    keep = np.ones(len(data), bool)
    starts = flat.off[:-1]
    if squeeze and len(data):
        keep[1:] = data[1:] != data[:-1]
        keep[starts[starts < len(data)]] = True
    place = np.cumsum(keep) - 1
    base = np.repeat(place[np.minimum(starts, max(len(data) - 1, 0))] if len(data) else np.zeros(flat.n, np.int64), np.diff(flat.off))
    power = C.mixed((place - base).astype(np.uint64) + np.uint64(0x51ED27))
    value = np.where(keep, C.mixed(power ^ (data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), np.uint64(0))
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return C.mixed(total[flat.off[1:]] - total[flat.off[:-1]] + np.uint64(1))


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram places of every document, as one array and the first place of each document (n + 1 values)."""
    flat = C.Flat(texts)
    mask = C.WORD_BYTE[flat.data]
    starts, ends, first = flat.spans(mask)
    ids, distinct = C.encoded(C.sliced(flat.data, starts, ends, mask))
    doc = C.doc_of(first)
    shape = _string_hashes(distinct, _SHAPE, True)[ids] if len(ids) else np.zeros(0, np.uint64)
    word = _string_hashes(distinct, C.LOWER, False)[ids] if len(ids) else np.zeros(0, np.uint64)
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    shape = np.where(same, shape ^ np.uint64(0x5BD1E995), shape)
    hashes, docs = [], []
    for kind, values, longest in ((1, shape, 3), (2, word, 2)):
        h = np.full(len(values), kind, np.uint64)
        for n in range(1, longest + 1):
            h = C.mixed(h[: len(values) - n + 1] * np.uint64(0xD6E8FEB86659FD93) + values[n - 1 :])
            inside = doc[: len(h)] == doc[n - 1 :] if n <= len(values) else np.zeros(0, bool)
            hashes.append(h[inside])
            docs.append(doc[: len(h)][inside])
    place = np.concatenate(hashes) >> np.uint64(44)
    key = np.unique((np.concatenate(docs).astype(np.uint64) << np.uint64(20)) | place)
    return (key & np.uint64(PLACES - 1)).astype(np.int32), np.searchsorted(key >> np.uint64(20), np.arange(flat.n + 1).astype(np.uint64))


@dataclass
class Model:
    scale: np.ndarray  # class log-count ratio of a place
    weight: np.ndarray  # scale times the linear model's weight
    bias: float
    sigmoid: tuple[float, float]

    def margin(self, place: np.ndarray, first: np.ndarray) -> np.ndarray:
        up = C.per_doc(self.weight[place], first)
        length = np.sqrt(C.per_doc(self.scale[place] ** 2, first))
        return up / np.maximum(length, 1e-9) + self.bias


def fit_model(place: np.ndarray, first: np.ndarray, y: np.ndarray, share: float, smoothing: float = 1.0, cost: float = 1.0) -> Model:
    """share: the part of class 1 among all labelled rows, to which the sigmoid is set."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(PLACES, np.float32), np.zeros(PLACES, np.float32), 0.0, (1.0, 0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1)))
    doc = C.doc_of(first)
    up = np.bincount(place[y[doc] == 1], minlength=PLACES)
    down = np.bincount(place[y[doc] == 0], minlength=PLACES)
    scale = np.log((up + smoothing) / (up + smoothing).sum()) - np.log((down + smoothing) / (down + smoothing).sum())
    scale[up + down < 3] = 0
    keep = scale[place] != 0
    place, doc = place[keep], doc[keep]
    first = np.searchsorted(doc, np.arange(len(y) + 1))
    value = scale[place]
    value /= np.maximum(np.sqrt(C.per_doc(value**2, first)), 1e-9)[doc]
    # the last place is the bias
    at = np.insert(place.astype(np.int64), first[1:], PLACES)
    value = np.insert(value, first[1:], 1.0)
    starts = first + np.arange(len(first))
    aside = np.arange(len(y)) % 5 == 4
    rows = np.flatnonzero(~aside)
    part = C.take_spans(starts[rows], starts[rows + 1])
    w = S.fit_rows(np.concatenate([[0], np.cumsum(np.diff(starts)[rows])]), at[part], value[part], 2.0 * y[rows] - 1, PLACES + 1, cost)
    model = Model(scale.astype(np.float32), (scale * w[:-1]).astype(np.float32), float(w[-1]), (1.0, 0.0))
    margin = C.per_doc(value * w[at], starts)
    a, b = S.calibrate(margin[aside], y[aside])
    even = float(np.mean(y[aside])) if 0 < np.mean(y[aside]) < 1 else 0.5
    odds = lambda s: np.log(np.clip(s, 1e-3, 1 - 1e-3) / (1 - np.clip(s, 1e-3, 1 - 1e-3)))
    model.sigmoid = (a, b + odds(share) - odds(even))
    return model


def _sample_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in C.in_blocks(batches):
        place, first = ngrams(block.column("text"))
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("y"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(place))], ["doc_id", "y", "place"])


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None, limit: int = TRAIN_ROWS) -> Model:
    """A model of at most `limit` labelled documents of each class; their n-gram places come to the driver."""
    rows = C.labelled_rows(documents, labels, label, limit, keep).mapInArrow(_sample_ngrams, "doc_id bigint, y int, place array<int>").toArrow().sort_by("doc_id")
    y = np.asarray(rows["y"]).astype(np.int64)
    place = [np.asarray(x.values) for x in rows["place"]]
    first = np.concatenate([[0], np.cumsum([len(p) for p in place])]).astype(np.int64)
    down, up = C.class_weights(labels, label, keep)
    return fit_model(np.concatenate(place) if place else np.zeros(0, np.int32), first, y, up / max(up + down, 1))


RESULT = "doc_id bigint, held_out boolean, score double, predicted int"


def score(documents: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Probability of good quality of every document; held_out is passed through."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two arrays of PLACES floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in C.in_blocks(batches):
            p = S.probability(model.margin(*ngrams(block.column("text"))), model.sigmoid)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, RESULT)
