"""Removal of long byte strings that occur more than once, by suffix arrays.

A string of LENGTH bytes that starts in two places has the same least k-gram (by hash, the
leftmost of equals) among its first WINDOW ones, and the same bytes there; so its starts are
dealt by the text behind that anchor, and both meet in one task.  A run of starts with one
anchor is a block; its context is all text that its strings cover.  Blocks whose anchor
text occurs once need no more work, and equal contexts are counted and go on as one.  A task
sorts the suffixes of its contexts by the difference-cover algorithm (suffix_array) and
compares adjacent prefixes of LENGTH bytes: the starts that agree with a neighbour are
repeats.  Anchor texts whose contexts all occur twice, or with two contexts in all (held
against each other from the anchor outwards), need no sort.

An anchor text with more than HOT contexts is dealt by more text: its starts are cut into
cells by their distance from the anchor, and a cell goes by all text that its strings share;
cells that are still crowded are cut finer, down to one start, whose text is the whole string.

Copies of a whole text are found by digest and go through the sort once.  Texts and contexts
are told apart by 128 bits of a digest.

Defined results: a null text is an empty one; a text under LENGTH bytes, or an empty one, is
kept whole; an empty table gives an empty one.  Very long texts are handled whole, as one block
of a task.  Repeated rows are copies of each other like any others, and all copies of a text go:
no one of them is preferred.  score() reads doc_id and text alone; keep() passes other columns
on, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import common as C
from quern.llm.suffix_array import suffix_array

LENGTH, GRAM = 400, 16
#: Bytes sorted at once; contexts of an anchor text or a cell beyond which it is cut.
SORT_BYTES, HOT = 2 << 20, 8_192
#: Distances from the anchor that a cell spans, one level after another.
CELLS = (48, 12, 3, 1)
#: Bytes of text hashed at once: every byte takes some ten numbers of eight bytes.
HASH_BYTES = 1 << 20

_rng = np.random.default_rng(2024)
_VALUE = _rng.integers(1, 1 << 63, 256).astype(np.uint64)
_BASE = int(_rng.integers(1 << 60, 1 << 62)) * 2 + 1
_BACK = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, HASH_BYTES + 1)

        def one(b: int) -> np.ndarray:
            step = np.full(size, b, np.uint64)
            step[0] = 1
            return np.cumprod(step)

        _powers[:] = [one(_BASE), one(_BACK)]
    return _powers[0][:n], _powers[1][:n]


class Hashes:
    """64-bit hashes of any substring of a buffer."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[:-1], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return C.mixed((self.sums[b] - self.sums[a]) * self.down[a])


def blocks_of(flat: C.Flat, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start, number of starts, the anchor's place from the first start, hash of the anchor's text) of every block."""
    window = (length - gram) // 2
    n = len(flat.data)
    none = np.zeros(0, np.int64)
    size = np.diff(flat.off)
    if not n or size.max(initial=0) < length:
        return none, none, none, none, none.astype(np.uint64)
    h = Hashes(flat.data)
    m = n - gram + 1
    place = np.arange(m)
    v = C.mixed((h.sums[gram:] - h.sums[:-gram]) * h.down[:m])
    v &= np.uint64(0xFFFFFFFF00000000)
    v |= place.astype(np.uint64)
    full = -(-m // window) * window
    v = np.concatenate([v, np.full(full - m, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, window)
    ahead = np.minimum.accumulate(v, 1).ravel()
    behind = np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()
    del v
    docs = np.flatnonzero(size >= length)
    starts = C.take_spans(flat.off[docs], flat.off[docs + 1] - length + 1)
    anchor = (np.minimum(behind[starts], ahead[starts + window - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    first, anchor = starts[at], anchor[at]
    count = np.diff(np.append(at, len(starts)))
    doc = np.searchsorted(flat.off, first, "right") - 1
    return doc, first - flat.off[doc], count, anchor - first, h.of(anchor, anchor + length - window)


_BLOCKS = "k bigint, t binary, a bigint, n int, o int"


def _blocks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.in_blocks(batches, budget=HASH_BYTES):
            doc, a, n, o, k = blocks_of(C.Flat(block.column("text")), length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.view(np.int64)), block.column("t").take(pa.array(doc)), pa.array(a), pa.array(n.astype(np.int32)), pa.array(o.astype(np.int32))], ["k", "t", "a", "n", "o"]
            )

    return run


_CONTEXTS = "k bigint, h binary, t binary, a bigint, n int, o int, context binary, hot boolean"


def _contexts(length: int):
    """(t, text, blocks) to a row for each block: h is the digest of its context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.in_blocks(batches, budget=1 << 20):
            flat = C.Flat(block.column("text"))
            lists = block.column("blocks")
            of = np.repeat(np.arange(block.num_rows), np.asarray(lists.value_lengths()))
            b = lists.flatten()
            start = flat.off[of] + np.asarray(b.field("a"))
            end = start + np.asarray(b.field("n")) + length - 1
            raw = flat.data.tobytes()
            h = [xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.field("k"), pa.array(h, pa.binary()), block.column("t").take(pa.array(of)), b.field("a"), b.field("n"), b.field("o"), C.sliced(flat.data, start, end), b.field("hot")], [c.split()[0] for c in _CONTEXTS.split(", ")]
            )

    return run


def _cells(length: int, width: int):
    """Rows of contexts to rows of their cells: starts whose distances from the anchor lie in one range of `width`, dealt by the text that all strings of such a cell cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.in_blocks(batches, "context", 1 << 20):
            out = []
            for row in batch.select(["k", "t", "a", "n", "o", "context"]).to_pylist():
                o, text = row["o"], row["context"]
                for c in range((o - row["n"] + 1) // width, o // width + 1):
                    far, near = min(c * width + width - 1, o), max(c * width, o - row["n"] + 1)
                    shared = text[o - c * width : o + length - (c * width + width - 1)]
                    part = text[o - far : o - near + length]
                    k = xxhash.xxh3_64_intdigest(shared, seed=c) - (1 << 63)
                    out.append((k, xxhash.xxh3_128_digest(part), row["t"], row["a"] + o - far, far - near + 1, far, part, True))
                if len(out) >= 4_096:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _CONTEXTS.split(", ")])


def repeated_starts(contexts: pa.Array, length: int = LENGTH) -> np.ndarray:
    """For every start of the contexts, one after another: does its string start elsewhere too?"""
    flat = C.Flat(contexts)
    size = np.diff(flat.off)
    starts = size - length + 1
    # letters 2-257; a letter below them ends each context
    n = len(flat.data) + len(size)
    off = flat.off + np.arange(len(flat.off))
    inside = np.ones(n, bool)
    inside[off[1:] - 1] = False
    text = np.ones(n, np.int32)
    text[inside] = flat.data
    text[inside] += 2
    valid = np.zeros(n, bool)
    every = C.take_spans(off[:-1], off[:-1] + starts)
    valid[every] = True
    order = suffix_array(text, 257)
    order = order[valid[order]]
    # adjacent prefixes: the last eight bytes first, then whole; in a run of pairs one byte apart the first vouches for the others
    eight = np.zeros(n, np.uint64)
    for j in range(8):
        eight[: n - j] |= text[j:].astype(np.uint64) << np.uint64(8 * j)
    ends = eight[order + (length - 8)]
    same = np.flatnonzero(ends[1:] == ends[:-1])
    pair = (order[same].astype(np.uint64) << np.uint64(32)) | order[same + 1].astype(np.uint64)
    pair.sort()
    x, y = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.ones(len(x), bool)
    head[1:] = (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1)
    run = np.cumsum(head) - 1
    ok = _equal(text, x[head], y[head], length)[run] if len(x) else head
    doubt = np.flatnonzero(~ok)
    ok[doubt] = _equal(text, x[doubt], y[doubt], length)
    hit = np.zeros(n, bool)
    hit[x[ok]] = hit[y[ok]] = True
    return hit[every]


def _equal(text: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Which strings of `length` at x and y are equal."""
    out = np.zeros(len(x), bool)
    for i in range(0, len(x), 20_000):
        a, b = x[i : i + 20_000, None] + np.arange(length), y[i : i + 20_000, None] + np.arange(length)
        out[i : i + 20_000] = (text[a] == text[b]).all(1)
    return out


def extensions(flat: C.Flat, i: np.ndarray, j: np.ndarray, o: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far contexts i and j agree to the left and to the right of their anchors (o: an anchor's place in its context)."""
    found = []
    for step, far in ((-1, int(o.max(initial=0))), (1, 2 * length)):
        room = [o[r] if step < 0 else flat.off[r + 1] - flat.off[r] - o[r] for r in (i, j)]
        at = step * np.arange(1 if step < 0 else 0, far + (step < 0))
        both = np.minimum(*room)
        a, b = ((flat.off[r] + o[r])[:, None] + at for r in (i, j))
        top = len(flat.data) - 1
        same = flat.data[np.clip(a, 0, top)] == flat.data[np.clip(b, 0, top)]
        same &= np.arange(far) < both[:, None]
        found.append(np.where(same.all(1), far, same.argmin(1)) if far else np.zeros(len(i), np.int64))
    return found[0], found[1]


_RUNS = "k bigint, h binary, x int, y int"


def settled(k: np.ndarray, times: np.ndarray, n: np.ndarray, o: np.ndarray, contexts: pa.Array, length: int) -> np.ndarray:
    """For every start of the contexts (sorted by k, `times` places each): is it a repeat?"""
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    members = np.bincount(group)
    first = np.concatenate([[0], np.cumsum(n)])
    hit = np.repeat(times > 1, n)
    open_ = (np.bincount(group, times == 1) > 0) & (members > 1)
    pairs = np.flatnonzero(new)[open_ & (members == 2)]
    flat = C.Flat(contexts)
    for s in range(0, len(pairs), 2_000):
        i = pairs[s : s + 2_000]
        left, right = extensions(flat, i, i + 1, o, length)
        for r in (i, i + 1):
            a, b = np.maximum(o[r] - left, 0), np.minimum(o[r] - (length - right), n[r] - 1) + 1
            some = a < b
            hit[C.take_spans((first[r] + a)[some], (first[r] + b)[some])] = True
    rest = np.flatnonzero((open_ & (members > 2))[group])
    if len(rest):
        hit[C.take_spans(first[rest], first[rest + 1])] |= repeated_starts(contexts.take(pa.array(rest)), length)
    return hit


def _sorted_groups(length: int, at_once: int = SORT_BYTES):
    """Distinct contexts (k, h, times, n, o, context) sorted by k to runs [x, y) of repeated starts of each."""

    def solved(table: pa.Table) -> pa.RecordBatch:
        k, times, n, o = (np.asarray(table[c]).astype(np.int64) for c in ("k", "times", "n", "o"))
        context = pa.concat_arrays(table["context"].chunks)
        hit = settled(k, times, n, o, context, length)
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        edge = np.ones(len(row) + 1, bool)
        edge[1:-1] = (row[1:] != row[:-1]) | (hit[1:] != hit[:-1])
        at = np.flatnonzero(edge)
        keep = hit[at[:-1]]
        x, y = at[:-1][keep], (at[1:] - 1)[keep]
        of = pa.array(row[x])
        columns = [pa.concat_arrays(table[c].chunks).take(of) for c in ("k", "h")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(place[x].astype(np.int32)), pa.array((place[y] + 1).astype(np.int32))], ["k", "h", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in C.in_blocks(batches, "context", at_once // 2):
            held.append(batch)
            size += int(pc.sum(pc.binary_length(batch.column("context"))).as_py() or 0)
            if size >= at_once:  # the last group may go on
                table = pa.Table.from_batches(held)
                k = np.asarray(table["k"])
                cut = np.flatnonzero(k[1:] != k[:-1]) + 1
                if len(cut):
                    yield solved(table.slice(0, int(cut[-1])))
                    held = table.slice(int(cut[-1])).to_batches()
                    size = sum(int(pc.sum(pc.binary_length(b.column("context"))).as_py() or 0) for b in held)
        if held:
            yield solved(pa.Table.from_batches(held))

    return run


def _digest(text: Column) -> Column:
    """The first 128 bits of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)), 1, 16)


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.withColumn("t", _digest(text)).withColumn("text", text)


def _repeated(contexts: DataFrame, length: int) -> DataFrame:
    """Runs (t, a, b) of repeated starts, of rows of contexts."""
    distinct = contexts.groupBy("k", "h").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.first("o").alias("o"), F.first("context").alias("context"))
    runs = distinct.repartition("k").sortWithinPartitions("k").mapInArrow(_sorted_groups(length), _RUNS)
    return contexts.select("k", "h", "t", "a").join(runs, ["k", "h"]).select("t", (F.col("a") + F.col("x")).alias("a"), (F.col("a") + F.col("y")).alias("b"))


def repeats(documents: DataFrame, length: int = LENGTH, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows (doc_id, t, n_bytes, sha, copies): every document; spans (t, runs, text): of texts with repeats, the runs of repeated starts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = C.stored(documents.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha")))
    rows = rows.withColumn("t", F.substring(F.unhex("sha"), 1, 16))
    texts = rows.groupBy("t").agg(F.count("*").alias("copies"), F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first"))
    keyed = _keyed(documents.select("doc_id", "text").where(F.octet_length("text") >= length))
    blocks = C.stored(keyed.select("t", "text").mapInArrow(_blocks(length), _BLOCKS))
    start = F.xxhash64("t", "a")
    shared = blocks.groupBy("k").agg(F.min(start).alias("x"), F.max(start).alias("y"), F.count("*").alias("c")).where("x != y").select("k", (F.col("c") > hot).alias("hot"))
    shared = C.stored(shared)  # a table of its own, so that the join can split a hot anchor text
    wanted = blocks.join(shared, "k").groupBy("t").agg(F.collect_set(F.struct("a", "n", "o", "k", "hot")).alias("blocks"))
    wanted = C.stored(wanted.join(texts, "t").select("t", "first", "blocks"))
    C.removed(documents.sparkSession, blocks)
    one = keyed.select("t", F.coalesce("doc_id", F.lit(-(2**63))).alias("first"), "text")
    chosen = C.stored(one.join(wanted, ["t", "first"]).select("t", "text", "blocks"))
    contexts = C.stored(chosen.mapInArrow(_contexts(length), _CONTEXTS))
    found = [_repeated(contexts.where("not hot"), length)]
    crowded = contexts.where("hot")
    for width in (0, *CELLS):
        if crowded.isEmpty():
            break
        cells = C.stored(crowded.mapInArrow(_cells(length, width), _CONTEXTS)) if width else crowded
        if width == 1:  # a group is one string now, however often it occurs
            cells = cells.withColumn("hot", F.lit(False))
        else:  # many contexts make a group crowded, many places of one context don't
            distinct = cells.groupBy("k", "h").agg(F.count("*").alias("times"))
            many = distinct.groupBy("k").agg(F.count("*").alias("c"), F.max("times").alias("times")).where("c > 1 or times > 1").select("k", (F.col("c") > hot).alias("hot"))
            cells = C.stored(cells.drop("hot").join(C.stored(many), "k"))
        found.append(_repeated(cells.where("not hot"), length))
        crowded = cells.where("hot")
    runs = found[0]
    for more in found[1:]:
        runs = runs.unionAll(more)
    starts = runs.groupBy("t").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    spans = starts.join(chosen.select("t", "text").distinct(), "t")
    return rows.join(texts.select("t", "copies"), "t"), spans


def merged(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes, of runs of starts."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"] - 1 + length) for r in runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


_CUT = "t binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(length: int, words: int, with_text: bool):
    """What stays of a text without its spans of at least `words` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.in_blocks(batches):
            out = []
            for text, runs in zip(block.column("text").cast(pa.binary()).to_pylist(), block.column("runs").to_pylist(), strict=True):
                spans = [(a, b) for a, b in merged(runs, length) if not words or len(_WORDS.findall(text[a:b])) >= words]
                kept = _kept_bytes(text, spans)
                out.append((sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text and spans else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([block.column("t"), *(pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds))], [c.split()[0] for c in _CUT.split(", ")])

    return run


_EMPTY = hashlib.sha256(b"").hexdigest()


def score(documents: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    rows, spans = repeats(documents, length, hot)
    all_ = rows.join(C.stored(spans.mapInArrow(_cut(length, 0, False), _CUT)), "t", "left")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    pick = lambda whole, name, otherwise: F.when(copied, whole).otherwise(F.coalesce(F.col(name), otherwise)).alias(name)
    return all_.select("doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed", F.lit(0)), pick(F.lit(1), "n_spans", F.lit(0)).cast("bigint").alias("n_spans"), pick(F.lit(_EMPTY), "kept_sha256", F.col("sha")))


_WORD = r"[^\x20\x09-\x0D]+"
#: keep(): strings of so many bytes are looked for, and a run of them goes if it has so many words.
PASSAGE, PASSAGE_WORDS = 240, 50


def keep(documents: DataFrame, length: int = PASSAGE, words: int = PASSAGE_WORDS, hot: int = HOT) -> DataFrame:
    """The documents without their repeated passages, with all their columns; n_chars, where there, follows.

    A passage is a run of bytes covered by repeated strings of `length` bytes, of at least `words` words. Fifty words
    take some 330 bytes in English, so shorter strings are looked for and the words of a run are counted. A character
    that is cut in part goes, and so does a document of which no word stays. Null and empty texts stay as they are.
    """
    rows, spans = repeats(documents, length, hot)
    cut = spans.mapInArrow(_cut(length, words, True), _CUT).where("n_spans > 0").select("t", F.col("kept").alias("cut"))
    copies = rows.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("t").distinct()
    copied = copies.select("t", F.lit(None).cast("string").alias("cut"), F.lit(True).alias("copied"))
    changed = C.stored(cut.withColumn("copied", F.lit(False)).unionAll(copied).groupBy("t").agg(F.max("cut").alias("cut"), F.max("copied").alias("copied")))
    held = documents.select(F.struct("*").alias("row"), _digest(F.coalesce("text", F.lit(""))).alias("t")).join(changed, "t", "left")
    text = F.col("row.text")
    whole = F.coalesce(F.col("copied"), F.lit(False)) & (F.regexp_count(text, F.lit(_WORD)) >= words)
    now = F.when(whole, F.lit("")).otherwise(F.coalesce(F.col("cut"), text))
    same = ~whole & F.col("cut").isNull()
    out = held.select("row", now.alias("now"), same.alias("same")).where(F.col("same") | F.col("now").rlike(_WORD))
    row = F.col("row").withField("text", F.col("now"))
    if "n_chars" in documents.columns:
        row = row.withField("n_chars", F.when(F.col("same"), F.col("row.n_chars")).otherwise(F.char_length("now")).cast(documents.schema["n_chars"].dataType))
    return out.select(row.alias("row")).select("row.*")

