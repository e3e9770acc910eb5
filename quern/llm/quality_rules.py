"""Quality rules: gradient-boosted trees over document statistics.

The statistics of a document come from array passes over its bytes.  The trees are
fitted on the driver by histogram boosting (logistic loss) over a bounded sample of
labelled documents, with monotone constraints on chosen statistics, and flattened
into node arrays which score a block of documents level by level.

Defined results: a null or empty text has no words, so every count is 0 and the base
rule fails it.  Repeated rows are scored one by one.  With no usable labels, or labels
of one class, the trees are a constant and only the base rule rejects.  Columns of the
input other than doc_id and text are ignored by score() and kept by keep().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common as C

#: At most this many labelled documents train the trees.
TRAIN_ROWS = 12_000
SYMBOLS = C.byte_table(b"#*$%&|<>")
_UPPER, _DIGIT = C.byte_table(range(65, 91)), C.byte_table(range(48, 58))
_PUNCT = C.byte_table(b"!\"'(),-./:;?[]{}@_+=~^`\\")
_LETTER = C.byte_table([*range(65, 91), *range(97, 123), *range(128, 256)])

#: Statistics and the sign that the fitted score must have in each (0: free).
STATISTICS = {
    "log_words": 0, "mean_word_chars": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1,
    "upper_share": -1, "digit_share": 0, "punct_share": 0, "bang_share": -1, "letter_share": 1, "distinct_share": 0,
    "top_word_share": 0, "same_as_next_share": -1, "words_per_line": 0, "short_word_share": 0, "symbol_end_share": -1,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_in_windows(ids: np.ndarray, first: np.ndarray, width: int = 5) -> np.ndarray:
    """Per document: words inside `width`-word windows that are found twice or more in it."""
    n = len(ids)
    if n < width:
        return np.zeros(len(first) - 1, np.int64)
    doc = C.doc_of(first)
    at = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    key = doc[at].astype(np.uint64) + np.uint64(1)
    for j in range(width):
        key = C.mixed(key * np.uint64(0xD6E8FEB86659FD93) + ids[at + j].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    a, b = at[order[1:][same]], at[order[:-1][same]]
    right = doc[a] == doc[b]
    for j in range(width):
        right &= ids[a + j] == ids[b + j]
    if not right.all():  # two windows share a hash: order by the words themselves
        rows = np.stack([doc[at], *(ids[at + j] for j in range(width))])
        order = np.lexsort(rows[::-1])
        same = (rows[:, order[1:]] == rows[:, order[:-1]]).all(0)
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    cover = np.zeros(n + 1, np.int64)
    starts = at[order[hit]]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return C.per_doc((np.cumsum(cover[:-1]) > 0).astype(np.int64), first, np.int64)


def document_statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts and the matrix of STATISTICS of each text."""
    flat = C.Flat(texts)
    data, off = flat.data, flat.off
    mask = C.WORD_BYTE[data]
    starts, ends, first = flat.spans(mask)
    n_words = np.diff(first)
    ids, distinct = C.encoded(C.sliced(data, starts, ends, mask))
    over = lambda m: C.per_doc(m.astype(np.int64), off, np.int64)
    points = (data & 0xC0) != 0x80
    word_chars, symbols = over(points & mask), over(SYMBOLS[data])
    # lines: the runs between \n; equal lines share an id
    cut = flat.data == 10
    line_starts = np.unique(np.concatenate([off[:-1], np.flatnonzero(cut) + 1]))
    line_starts = line_starts[line_starts < len(data)]  # a line after a document's last \n is empty
    ld = np.searchsorted(off, line_starts, "right") - 1
    words_to = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=words_to[1:])
    stop = np.append(np.flatnonzero(cut), len(data))
    line_ends = np.minimum(stop[np.searchsorted(stop, line_starts, "left")], off[ld + 1])
    real = words_to[line_ends] > words_to[line_starts]
    ls, le, ld = line_starts[real], line_ends[real], ld[real]
    line_ids, _ = C.encoded(C.sliced(data, ls, le))
    key = np.unique(ld * (len(line_ids) + 1) + line_ids)
    n_lines = np.bincount(ld, minlength=flat.n)
    dup_lines = n_lines - np.bincount(key // (len(line_ids) + 1), minlength=flat.n)
    repeated = repeated_in_windows(ids, first)
    counts = dict(zip(COUNTS, (n_words, word_chars, symbols, dup_lines, repeated), strict=True))
    # statistics for the trees
    doc = C.doc_of(first)
    w, size = np.maximum(n_words, 1), np.maximum(np.diff(off), 1)
    pair, times = np.unique(doc * (len(distinct) + 1) + ids, return_counts=True)
    pair_doc = pair // (len(distinct) + 1)
    top = np.zeros(flat.n, np.int64)
    np.maximum.at(top, pair_doc, times)
    next_same = np.zeros(len(ids), np.int64)
    next_same[:-1] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    symbol_end = SYMBOLS[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    per_word = lambda v: C.per_doc(v.astype(np.int64), first, np.int64) / w
    columns = {
        "log_words": np.log1p(n_words), "mean_word_chars": word_chars / w, "symbols_per_word": symbols / w,
        "dup_line_share": dup_lines / np.maximum(n_lines, 1), "repeat_word_share": repeated / w, "upper_share": over(_UPPER[data]) / size,
        "digit_share": over(_DIGIT[data]) / size, "punct_share": over(_PUNCT[data]) / size, "bang_share": over(data == 33) / w,
        "letter_share": over(_LETTER[data]) / size, "distinct_share": np.bincount(pair_doc, minlength=flat.n) / w, "top_word_share": top / w,
        "same_as_next_share": per_word(next_same), "words_per_line": n_words / np.maximum(n_lines, 1), "short_word_share": per_word(ends - starts <= 3), "symbol_end_share": per_word(symbol_end),
    }
    return counts, np.stack([columns[k] for k in STATISTICS], 1)


@dataclass
class Trees:
    """Flattened trees: node i goes to left[i] if x[feature[i]] <= threshold[i], else to left[i] + 1; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40))) if len(x) else np.zeros(0)


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: float = 8.0) -> Trees:
    """Boosts depth-bounded trees on the logistic loss. A split on a constrained statistic must order its children, and bounds keep their offspring ordered."""
    share = float(np.clip(y.mean() if len(y) else 0.75, 0.02, 0.98))
    base, nodes, roots = float(np.log(share / (1 - share))), [], []
    if len(y) and 0 < y.mean() < 1:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        margin = np.full(len(y), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            roots.append(len(nodes))
            nodes.append(None)
            todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
            while todo:
                at, rows, level, low, high = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                best = None
                if level < depth and hs >= 2 * least / 8:
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[rows, f]
                        gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                        gr, hr = gs - gl, hs - hl
                        vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                        gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - (gr * vr + 0.5 * (hr + l2) * vr**2)
                        ok = (nl >= least) & (len(rows) - nl >= least)
                        if signs[f]:
                            ok &= signs[f] * (vr - vl) >= 0
                        gain = np.where(ok, gain, -np.inf)
                        k = int(gain.argmax())
                        if best is None or gain[k] > best[0]:
                            best = (gain[k], f, k, vl[k], vr[k])
                v = float(np.clip(-gs / (hs + l2), low, high))
                if best is None or best[0] <= -(gs * v + 0.5 * (hs + l2) * v * v) + 1e-6:
                    nodes[at] = (0, np.inf, at, at, rate * v)
                    margin[rows] += rate * v
                    continue
                _, f, k, vl, vr = best
                a = len(nodes)
                nodes += [None, None]
                nodes[at] = (f, float(cuts[f][k]), a, a + 1, 0.0)
                goes_left = binned[rows, f] <= k
                middle = (vl + vr) / 2
                left_bounds, right_bounds = ((low, middle), (middle, high)) if signs[f] > 0 else ((middle, high), (low, middle)) if signs[f] < 0 else ((low, high), (low, high))
                todo.append((a, rows[goes_left], level + 1, *left_bounds))
                todo.append((a + 1, rows[~goes_left], level + 1, *right_bounds))
    if not nodes:
        nodes, roots = [(0, np.inf, 0, 0, 0.0)], [0]
    feature, threshold, left, right, value = (np.array(v) for v in zip(*nodes, strict=True))
    return Trees(base, np.array(roots), feature, threshold, left, right, value, depth)


_FEATURES = "y int, x array<double>"


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in C.in_blocks(batches):
        _, x = document_statistics(block.column("text"))
        yield pa.RecordBatch.from_arrays([block.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS) -> Trees:
    """Trees fitted on at most `limit` labelled documents of each class; only their statistics (a few numbers each) reach the driver. The margin is shifted to the class ratio of all labels."""
    rows = C.labelled_rows(documents, labels, label, limit).mapInArrow(_sample_features, _FEATURES).toArrow()
    y = np.asarray(rows["y"]).astype(float)
    x = np.array(rows["x"].to_pylist(), float).reshape(len(y), len(STATISTICS))
    trees = fit_trees(x, y, list(STATISTICS.values()))
    cut = [max(n / limit, 1.0) for n in C.class_sizes(labels, label)]
    if 0 < y.sum() < len(y):
        trees.base += float(np.log(cut[1] / cut[0]))
    return trees


RESULT = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double, kept boolean"


def score(documents: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """Counts, base rule, probability of good quality and verdict of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.in_blocks(batches):
            counts, x = document_statistics(block.column("text"))
            p = trees.probability(x)
            failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), *(pa.array(counts[k].astype(np.int64)) for k in COUNTS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))],
                ["doc_id", *COUNTS, "base_failed", "score", "kept"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, RESULT)


def keep(documents: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """The documents whose verdict is to keep, with all their columns; one narrow pass, no join."""
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.in_blocks(batches):
            counts, x = document_statistics(block.column("text"))
            failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
            yield block.filter(pa.array(~failed & (trees.probability(x) >= threshold)))

    return documents.mapInArrow(run, schema)
