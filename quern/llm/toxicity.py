"""Toxicity by a gap-weighted subsequence kernel under a support vector machine with Nystroem landmarks.

A sentence is a bag of readings: its words, the parts of words that hold signs, and joins of
neighbouring short fragments (`st up id`, `m o r o n`).  Letters are lower-cased, digits and
signs that stand for letters are read as those letters, and everything else that is no letter
is dropped, so `i.d-i0t` reads as `idiot`.

The kernel of two readings sums, over the subsequences of four letters that both have, the
product of their weights; an occurrence over s letters weighs DECAY ** s, so gaps and
inserted letters lower a match and do not break it.  A word's start and end count as
letters.  The kernel is normalised.  The machine is trained on labelled sentences as bags: in
turns, every sampled sentence gives the reading that the machine finds worst, which takes
part with its sentence's label.  The first machine, which chooses the first readings, is
trained on words that are in more toxic sentences than chance explains (with spellings that have letters
inserted) against words of clean ones.  Its features are the kernel's values at landmark
words times the inverse root of the landmarks' kernel matrix.  As the kernel is a product
over an explicit (small) space, the fitted function folds into one weight a subsequence, so
scoring a reading needs its subsequences and no landmark; a document scores as its worst
reading.

Defined results: a null or empty text, or one without a reading of three letters, gets the
lowest score; a text is never cut, and a reading of more than ten letters goes by its worst
window.  With no labels, or one class, all documents score alike.  Repeated rows are scored
one by one and near copies count once in the choice of the first words; ties between words go by the
bytes of the word.  Columns other than those named are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import common as C
from quern.llm import linear_svm as S

#: At most this many labelled documents of each class train the machine.
TRAIN_ROWS = 3_000
DECAY = 0.6
LANDMARKS, COST = 320, 40.0
#: Letters a-z are 1-26, others 27-30, a word's start 31 and end 32; 0 is no letter.
LETTERS, START, END = 33, 31, 32
ENDS = bytes([START, END])
SPACE = LETTERS**4
#: Signs read as letters.
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: A longer word (with its start and end) is read in windows of this many letters, begun at every STEP-th.
WINDOW, STEP = 12, 2
#: Neighbouring fragments of at most SHORT letters are also read as one word of up to JOINED letters.
SHORT, JOINED = 4, WINDOW - 2
#: Turns in which the labelled sentences choose their readings.
TURNS = 3

_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[0x80:0xC0] = 27 + (np.arange(0x80, 0xC0) & 3)  # a letter outside ASCII goes by its later bytes
for _sign, _letter in LOOKS_LIKE.items():
    _CLASS[ord(_sign)] = ord(_letter) - 96


def _subsequences(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (k, 4) of all subsequences of four letters of a word, and their weights."""
    at = np.array(list(itertools.combinations(range(length), 4)), np.int64)
    return at, (DECAY ** (at[:, 3] - at[:, 0] + 1)).astype(np.float32)


_AT = {n: _subsequences(n) for n in range(5, WINDOW + 1)}


def codes(letters: np.ndarray) -> np.ndarray:
    """Codes (words, k) of the subsequences of equally long words."""
    at, _ = _AT[letters.shape[1]]
    x = letters.astype(np.int32)
    return ((x[:, at[:, 0]] * LETTERS + x[:, at[:, 1]]) * LETTERS + x[:, at[:, 2]]) * LETTERS + x[:, at[:, 3]]


def by_length(words: pa.Array, most: int = 10_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices of words, their letters) for each length; a long word gives overlapping windows, a word under three letters nothing."""
    flat = C.Flat(words)
    size = np.diff(flat.off)
    padded = np.full(len(flat.data) + 2 * flat.n, START, np.uint8)
    off = flat.off + 2 * np.arange(flat.n + 1)
    place = np.ones(len(padded), bool)
    place[off[:-1]] = place[off[1:] - 1] = False
    padded[place] = flat.data
    padded[off[1:] - 1] = END
    size = size + 2
    for n in range(5, WINDOW + 1):
        same = np.flatnonzero(size == n)
        for i in range(0, len(same), most):
            at = same[i : i + most]
            yield at, padded[off[at][:, None] + np.arange(n)]
    long = np.flatnonzero(size > WINDOW)
    windows = np.concatenate([[0], np.cumsum(-(-(size[long] - WINDOW) // STEP) + 1)])
    for i in range(0, int(windows[-1]), most):
        k = np.arange(i, min(i + most, int(windows[-1])))
        which = np.searchsorted(windows, k, "right") - 1
        at = long[which]
        start = np.minimum((k - windows[which]) * STEP, size[at] - WINDOW)
        yield at, padded[(off[at] + start)[:, None] + np.arange(WINDOW)]


def norms(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Lengths of the words' vectors; equal subsequences of a word add up first."""
    order = np.argsort(code, 1)
    c, w = np.take_along_axis(code, order, 1), weight[order]
    new = np.ones(c.shape, bool)
    new[:, 1:] = c[:, 1:] != c[:, :-1]
    start = np.flatnonzero(new.ravel())
    sums = np.add.reduceat(w.ravel().astype(np.float64), start) ** 2
    return np.sqrt(np.bincount(start // c.shape[1], sums, len(code)))


class Landmarks:
    """Normalised vectors of a few words over the subsequences that they have."""

    def __init__(self, words: pa.Array):
        found, of, value = [], [], []
        done = np.zeros(len(words), bool)
        for at, letters in by_length(words):
            code, weight = codes(letters), _AT[letters.shape[1]][1]
            size = norms(code, weight)
            for i, c, n in zip(at, code, size, strict=True):
                if not done[i]:  # a long landmark goes by its first window
                    done[i] = True
                    found.append(c)
                    of.append(np.full(len(c), i))
                    value.append(weight / n)
        codes_, of, value = (np.concatenate(v) for v in (found, of, value))
        self.code, column = np.unique(codes_, return_inverse=True)
        self.z = np.zeros((len(self.code) + 1, len(words)), np.float32)  # the last row: a subsequence of no landmark
        np.add.at(self.z, (column, of), value)
        self.column = np.full(SPACE, len(self.code), np.int32)
        self.column[self.code] = np.arange(len(self.code))

    def kernel(self, words: pa.Array) -> np.ndarray:
        """Kernel values (words, landmarks); of a long word's windows, the largest."""
        out = np.zeros((len(words), self.z.shape[1]), np.float32)
        for at, letters in by_length(words, 200):
            np.maximum.at(out, at, self.of_letters(letters))
        return out

    def of_letters(self, letters: np.ndarray) -> np.ndarray:
        """Kernel values of equally long readings, their starts and ends among the letters."""
        code, weight = codes(letters), _AT[letters.shape[1]][1]
        return np.einsum("wcm,c->wm", self.z[self.column[code]], weight) / norms(code, weight)[:, None]

    def of_pieces(self, pieces: list[bytes]) -> np.ndarray:
        """Kernel values of readings with their starts and ends."""
        out = np.zeros((len(pieces), self.z.shape[1]), np.float32)
        size = np.array([len(p) for p in pieces])
        for n in range(5, WINDOW + 1):
            same = np.flatnonzero(size == n)
            for i in range(0, len(same), 200):
                part = same[i : i + 200]
                out[part] = self.of_letters(np.frombuffer(b"".join(pieces[k] for k in part), np.uint8).reshape(-1, n))
        return out


@dataclass
class Model:
    weight: np.ndarray  # of each subsequence
    bias: float
    sigmoid: tuple[float, float]

    def _values(self, words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(indices of words, letters, values) of the readings that may be above -1 and have a positive sum of weights, as no other counts; a long word may come again."""
        for at, letters in by_length(words):
            weight = _AT[letters.shape[1]][1]
            code = codes(letters)
            up = (self.weight[code] * weight).sum(1)
            # the vector's length is at least this, so most words need no exact one
            least = np.sqrt((weight.astype(np.float64) ** 2).sum())
            close = np.flatnonzero((up > 0) & (up / least + self.bias > -1.0))
            if len(close):
                yield at[close], letters[close], up[close] / norms(code[close], weight) + self.bias

    def of_words(self, words: pa.Array) -> np.ndarray:
        """Values of the words, -1 at least: below that bar no word counts."""
        out = np.full(len(words), -1.0)
        for at, _, value in self._values(words):
            np.maximum.at(out, at, value)
        return out

    def margin(self, texts: pa.Array) -> np.ndarray:
        """The largest value of a document's readings, -1 at least, pressed into (-1, 1): by how far an insult is beyond doubt is no evidence about the doubtful."""
        out = np.full(len(texts), -1.0)
        for ids, distinct, first in readings(texts):
            value = self.of_words(distinct)[ids]
            some = np.flatnonzero(np.diff(first))
            out[some] = np.maximum(out[some], np.maximum.reduceat(value, first[some])) if len(some) else out[some]
        return np.tanh(out / 2)

    def worst(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes | None]]:
        """Each document's margin and the reading that has it (with start and end), None at -1."""
        out, piece = np.full(len(texts), -1.0), [None] * len(texts)
        for ids, distinct, first in readings(texts):
            best, letters_of = np.full(len(distinct), -1.0), [b""] * len(distinct)
            for at, letters, value in self._values(distinct):
                for i, row, v in zip(at.tolist(), letters, value.tolist(), strict=True):
                    if v > best[i]:
                        best[i], letters_of[i] = v, row.tobytes()
            for d in np.flatnonzero(np.diff(first)).tolist():
                k = ids[first[d] : first[d + 1]]
                i = int(k[best[k].argmax()])
                if best[i] > out[d]:
                    out[d], piece[d] = best[i], letters_of[i]
        return out, piece


def readings(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Readings of the documents: ids, distinct readings (letters as codes 1-30) and each document's first. The words and their parts come first, then joins of two short fragments, of three, and so on."""
    flat = C.Flat(texts)
    starts, ends, first = flat.spans(C.WORD_BYTE[flat.data])
    letter = _CLASS[flat.data]
    place = np.zeros(len(letter) + 1, np.int64)
    np.cumsum(letter > 0, out=place[1:])
    body = letter[letter > 0]
    a, b, doc = place[starts], place[ends], C.doc_of(first)
    starts_of = starts
    starts, ends, first = flat.spans((letter > 0) | (flat.data >= 0x80))
    x, y, of = place[starts], place[ends], C.doc_of(first)
    word = np.searchsorted(starts_of, starts, "right") - 1
    part = (y - x >= 3) & (y - x < b[word] - a[word])
    whole = b - a >= 3
    begin, end, doc = np.concatenate([a[whole], x[part]]), np.concatenate([b[whole], y[part]]), np.concatenate([doc[whole], of[part]])
    order = np.argsort(doc, kind="stable")
    yield _reading(body, begin[order], end[order], doc[order], flat.n)
    some = y > x
    x, y, of = x[some], y[some], of[some]
    at, m = np.flatnonzero(y - x <= SHORT), 1
    while len(at):  # runs of m short fragments, each lengthened by the next
        at = at[at + m < len(x)]
        ahead = at + m
        at = at[(of[ahead] == of[at]) & (y[ahead] - x[ahead] <= SHORT) & (y[ahead] - x[at] <= JOINED)]
        m += 1
        full = at[y[at + m - 1] - x[at] >= 4]
        if len(full):
            yield _reading(body, x[full], y[full + m - 1], of[full], flat.n)


def _reading(body: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, n: int):
    ids, distinct = C.encoded(C.sliced(body, begin, end))
    return ids, distinct, np.searchsorted(doc, np.arange(n + 1))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The documents' words and parts of words, as readings() gives them."""
    return next(readings(texts))


def chance(n_words: int, toxic: int, clean: int) -> int:
    """A word in this many sentences, all of them toxic, is not explained by chance: fewer than one such word is expected."""
    return max(3, int(np.ceil(np.log(max(n_words, 2)) / np.log((toxic + clean + 1) / max(toxic, 0.5)))))


def witnesses(sentences: dict[bytes, set[int]], clean: dict[bytes, int], least: int, enough: int = 3) -> list[tuple[bytes, int]]:
    """Words that explain the toxic sentences, with their numbers of sentences: again and again the one in most sentences with fewer than `enough` such words, less those that are clean."""
    left: dict[int, int] = {}
    todo, found = dict(sentences), []
    while todo:
        value = {w: sum(left.get(s, 0) < enough for s in of) - 5 * clean[w] for w, of in todo.items()}
        w = max(value, key=lambda w: (value[w], w))
        if value[w] < least:
            break
        found.append((w, len(todo[w])))
        for s in todo.pop(w):
            left[s] = left.get(s, 0) + 1
    return found


def spelled(words: list[bytes], rng: np.random.Generator, times: int = 8) -> list[bytes]:
    """Spellings with one or two letters inserted or one doubled."""
    out = []
    for k in range(times):
        for w in words:
            v = list(w)
            for _ in range(1 + (k % 3 == 2)):
                at = int(rng.integers(1, len(v)))
                v.insert(at, v[at - 1] if k % 3 == 1 else int(rng.integers(1, 27)))
            out.append(bytes(v))
    return out


def _constant(toxic: int, clean: int) -> Model:
    return Model(np.zeros(SPACE, np.float32), -1.0, (1.0, 0.0 if not toxic + clean else 4.0 if not clean else -4.0))


class Machine:
    """The support vector machine. Its landmarks are the first words, spellings of them, the readings that sentences chose, and clean words."""

    def __init__(self, bad: list[bytes], good: list[bytes], sentences: list[int], seed: int = 11):
        """sentences: numbers of those that have a bad word."""
        self.bad, self.good, self.more = bad, good, spelled(bad, np.random.default_rng(seed))
        weight = np.sqrt(np.array(sentences, float))
        self.words = bad + self.more + good
        self.y = np.concatenate([np.ones(len(bad + self.more)), -np.ones(len(good))])
        self.cost = np.concatenate([weight, np.tile(weight / 6, len(self.more) // max(1, len(bad))), np.ones(len(good))])

    def _landmarks(self, pieces: dict[tuple[bytes, int], float]) -> Landmarks:
        by_label = {y: sorted((p for p in pieces if p[1] == y), key=lambda p: (-pieces[p], p[0])) for y in (0, 1)}
        part = LANDMARKS // 4
        groups = [self.bad[:part], self.more[:part], [p.strip(ENDS) for p, _ in by_label[0][:part]], [p.strip(ENDS) for p, _ in by_label[1][: part // 2]], self.good]
        words = list(dict.fromkeys(w for g in groups for w in g if len(w) >= 3))
        return Landmarks(pa.array(words[:LANDMARKS], pa.binary()))

    def fit(self, pieces: dict[tuple[bytes, int], float]) -> Model:
        """pieces: readings chosen by sentences of a label, and the number of those sentences."""
        landmarks = self._landmarks(pieces)
        values, axes = np.linalg.eigh(landmarks.z.T.astype(np.float64) @ landmarks.z.astype(np.float64))
        live = values > 1e-4 * values.max()
        root = axes[:, live] / np.sqrt(values[live])  # inverse root of the landmarks' kernel matrix
        x, y, cost = landmarks.kernel(pa.array(self.words, pa.binary())) @ root, self.y, self.cost
        if pieces:
            x = np.concatenate([x, landmarks.of_pieces([p for p, _ in pieces]) @ root])
            y = np.concatenate([y, [1.0 if label else -1.0 for _, label in pieces]])
            cost = np.concatenate([cost, np.sqrt(list(pieces.values()))])
        up = y > 0
        cost = np.where(up, cost * (cost[~up].sum() / cost[up].sum()), cost)
        w = S.fit_dense(np.concatenate([x, np.ones((len(x), 1))], 1), y, cost * COST, epochs=40, tolerance=0.05)
        folded = np.zeros(SPACE, np.float32)
        folded[landmarks.code] = landmarks.z[:-1] @ (root @ w[:-1])
        return Model(folded, float(w[-1]), (1.0, 0.0))


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sentence, y, word) of every sentence's distinct words; one least hash of three words in a row makes one sentence of near copies."""
    for block in C.in_blocks(batches):
        ids, distinct, first = words_of(block.column("text"))
        doc = C.doc_of(first)
        mark = np.array([zlib.crc32(w) for w in distinct.to_pylist()], np.uint64) + (np.asarray(pc.binary_length(distinct)).astype(np.uint64) << np.uint64(32))
        one = C.mixed(mark)[ids]
        run = one.copy()
        for k in (1, 2):
            same = np.flatnonzero(doc[k:] == doc[:-k])
            run[same] = C.mixed(run[same]) + one[same + k]
        whole = np.diff(first)[doc]
        run = (C.mixed(C.mixed(run)) >> np.uint64(1)).astype(np.int64)
        run[(np.arange(len(ids)) > first[1:][doc] - 3) & (whole > 3)] = np.iinfo(np.int64).max  # fewer than three words are left
        least = np.full(block.num_rows, np.iinfo(np.int64).max)
        np.minimum.at(least, doc, run)
        key = np.unique(doc * (len(distinct) + 1) + ids)
        doc, word = key // (len(distinct) + 1), key % (len(distinct) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(least[doc]), block.column("y").take(pa.array(doc)), distinct.take(pa.array(word))], ["sentence", "y", "word"])


def _worst(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.in_blocks(batches):
            value, piece = shared.value.worst(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("y"), pa.array(value), pa.array(piece, pa.binary())], ["y", "value", "piece"])

    return run


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None, limit: int = TRAIN_ROWS) -> Model:
    """A machine of at most `limit` labelled documents of each class. To the driver come candidate words with their sentences and, in each turn, one reading of at most twelve letters for a document."""
    clean, toxic = C.class_weights(labels, label, keep)
    if not toxic or not clean:
        return _constant(toxic, clean)
    sample = C.stored(C.labelled_rows(documents, labels, label, limit, keep))
    words = C.stored(sample.mapInArrow(_sample_words, "sentence bigint, y int, word binary").distinct())
    sentences = {r["y"]: r["n"] for r in words.groupBy("y").agg(F.count_distinct("sentence").alias("n")).collect()}
    per = C.stored(words.groupBy("word").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")))
    least = chance(per.count(), sentences.get(1, 0), sentences.get(0, 0))
    candidates = per.where((F.col("toxic") >= least) & (F.col("toxic") >= 20 * F.col("clean")))
    of, free = {}, {}
    for r in words.where("y = 1").join(candidates.select("word", "clean"), "word").groupBy("word", "clean").agg(F.collect_list("sentence").alias("s")).collect():
        of[bytes(r["word"])], free[bytes(r["word"])] = set(r["s"]), r["clean"]
    first = witnesses(of, free, least)
    bad = [w for w, _ in first]
    rest = per.where("clean > 0")
    good = [bytes(r["word"]) for part in (rest.orderBy(F.desc("clean"), "word").limit(1000), rest.orderBy(F.xxhash64("word"), "word").limit(2000)) for r in part.select("word").collect() if r["word"]]
    good = list(dict.fromkeys(w[:JOINED] for w in good))
    context = documents.sparkSession.sparkContext
    rows, machine = [], Machine(bad, good, [n for _, n in first]) if bad and good else None
    for turn in range(TURNS + 1 if machine else 0):
        chosen: dict[tuple[bytes, int], float] = {}
        for r in rows:
            if r["piece"] is not None and r["value"] > (-0.3 if r["y"] else -0.8):  # of a sentence that nothing explains yet no reading is to blame; a clean one far below the bar teaches nothing
                key = (bytes(r["piece"]), r["y"])
                chosen[key] = chosen.get(key, 0) + 1
        model = machine.fit(chosen)
        rows = sample.select("y", "text").mapInArrow(_worst(context.broadcast(model)), "y int, value double, piece binary").collect()
    y = np.array([r["y"] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return _constant(int(toxic > clean), int(toxic <= clean))  # no reading tells the classes apart
    a, b = S.calibrate(np.tanh(np.array([r["value"] for r in rows]) / 2), y)
    odds = lambda s: np.log(np.clip(s, 1e-3, 1 - 1e-3) / (1 - np.clip(s, 1e-3, 1 - 1e-3)))
    model.sigmoid = (a, b + odds(toxic / (toxic + clean)) - odds(float(y.mean())))
    return model


RESULT = "doc_id bigint, held_out boolean, score double, predicted int"


def score(documents: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Probability of toxicity of every document; held_out is passed through."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # one float a subsequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in C.in_blocks(batches):
            p = S.probability(model.margin(block.column("text")), model.sigmoid)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, RESULT)
