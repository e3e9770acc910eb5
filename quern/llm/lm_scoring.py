"""Language-model scores from an Elias-Fano n-gram trie over the whole corpus.

The model interpolates word pairs with words: P(w | v) = max(c(vw) - D, 0) / N(v) +
D T(v) / N(v) P(w), with P(w) = (c(w) + 1) / (N + V + 1); c counts training tokens, N(v) is
the count of v as a context, T(v) the number of its distinct followers.

Nothing of the size of the corpus meets in one place.  Documents are held in blocks of
bounded size as token numbers.  A block's distinct words go once to the partition of the
word and come back with the word's number and count; its distinct pairs go once to the
shard of the context.  A shard builds the trie of its pairs (quantised first terms of the
formula), maps it into memory and answers each block's pairs by successor search.  There
are as many shards as blocks, so a shard is bounded too; a context with more than a shard's
part of all tokens is dealt over shards by the following word.

Defined results: a null text is empty; an empty text is the end token alone.  Repeated rows
count and are scored one by one.  With no training document every word is unknown.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import common as C
from quern.llm.elias_fano import Trie

#: Bytes of text in a block, and the discount D.
BLOCK, DISCOUNT = 8 << 20, 0.75
#: First terms are kept as one of 255 steps of their logarithm down to 10 ** -LOWEST.
LOWEST = 8.0
#: Numbers of the start and the end of a text; words are numbered from 2.
START, END, FIRST_WORD = 0, 1, 2


def _packed(a: np.ndarray, kind) -> bytes:
    return pa.compress(np.ascontiguousarray(a.astype(kind)).tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def _unpacked(b: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(kind).itemsize, codec="zstd"), kind) if n else np.zeros(0, kind)


_BLOCKS = "block bigint, docs array<bigint>, held array<boolean>, first array<int>, n int, low binary, high binary, n_words int, words array<binary>, counts array<int>, tokens bigint, trained bigint"


def _in_blocks(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in C.in_blocks(batches, budget=budget):
            flat = C.Flat(batch.column("text"))
            flat.data = C.LOWER[flat.data]
            mask = C.WORD_BYTE[flat.data]
            starts, ends, first = flat.spans(mask)
            ids, words = C.encoded(C.sliced(flat.data, starts, ends, mask))
            train = ~np.asarray(batch.column("held").fill_null(False))
            count = np.bincount(ids[np.repeat(train, np.diff(first))], minlength=len(words))
            tokens = int(count.sum() + train.sum())
            k += 1
            one = lambda values, kind: pa.array([values], kind)
            yield pa.RecordBatch.from_arrays(
                [
                    one((TaskContext.get().partitionId() << 24) + k, pa.int64()), pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id")), one((~train).tolist(), pa.list_(pa.bool_())),
                    one(first, pa.list_(pa.int32())), one(len(ids), pa.int32()), one(_packed(ids & 0xFFFF, "<u2"), pa.binary()), one(_packed(ids >> 16, "<u1"), pa.binary()),
                    one(len(words), pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), one(count, pa.list_(pa.int32())), one(tokens, pa.int64()), one(int(train.sum()), pa.int64()),
                ],
                [c.split()[0] for c in _BLOCKS.split(", ")],
            )

    return run


def _words_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, block, place, count) of every block's distinct words."""
    for batch in batches:
        for r in range(batch.num_rows):
            words = batch.column("words")[r].values
            n = len(words)
            yield pa.RecordBatch.from_arrays([words, pa.array(np.full(n, batch.column("block")[r].as_py())), pa.array(np.arange(n, dtype=np.int32)), batch.column("counts")[r].values], ["word", "block", "place", "count"])


_NUMBERED = "block bigint, n int, place binary, number binary, count binary, known bigint"


def _numbered(parts: int):
    """Rows sorted by word to a word's number and its count over all blocks, gathered by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used, known = TaskContext.get().partitionId(), 0, 0
        kept: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush():
            nonlocal kept, size, known
            block, place, number, count = (np.concatenate(c) for c in zip(*kept, strict=True))
            order = np.argsort(block, kind="stable")
            ids, begin = np.unique(block[order], return_index=True)
            for b, rows in zip(ids.tolist(), np.split(order, begin[1:]), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([len(rows)], pa.int32()), *(pa.array([_packed(c[rows], kind)], pa.binary()) for c, kind in ((place, "<u4"), (number, "<u8"), (count, "<u8"))), pa.array([known])], [c.split()[0] for c in _NUMBERED.split(", ")])
                known = 0
            kept, size = [], 0

        def closed(words: pa.Array, block, place, count):
            nonlocal used, known, size
            ids, distinct = C.encoded(words)
            total = np.bincount(ids, count, len(distinct)).astype(np.int64)
            known += int((total > 0).sum())
            kept.append((block, place, FIRST_WORD + (used + ids) * parts + part, total[ids]))
            used += len(distinct)
            size += len(ids)

        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if carry is None else [carry, batch]).combine_chunks()
            word = pa.concat_arrays(rows["word"].chunks).cast(pa.binary())
            ids, _ = C.encoded(word)
            # the last word may go on in the next batch
            stop = int(np.flatnonzero(ids == ids[-1])[0])
            if stop:
                closed(word.slice(0, stop), *(np.asarray(rows[c])[:stop] for c in ("block", "place", "count")))
            carry = rows.slice(stop).combine_chunks().to_batches()[0]
            if size > 2_000_000:
                yield from flush()
        if carry is not None:
            closed(carry.column("word").cast(pa.binary()), *(np.asarray(carry.column(c)) for c in ("block", "place", "count")))
        if kept:
            yield from flush()

    return run


def _mix(a: np.ndarray) -> np.ndarray:
    return C.mixed(a.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


class Block:
    """A block with its words' numbers and counts, and its distinct pairs in the order of shard, context, word."""

    def __init__(self, row: dict, trained: int, tokens: int, shards: int):
        n, n_words = row["n"], row["n_words"]
        ids = _unpacked(row["low"], n, "<u2").astype(np.int64) | _unpacked(row["high"], n, "<u1").astype(np.int64) << 16
        number, count = np.zeros(n_words + 1, np.int64), np.zeros(n_words + 1, np.int64)
        for p in row["numbers"] or []:
            place = _unpacked(p["place"], p["n"], "<u4")
            number[place], count[place] = _unpacked(p["number"], p["n"], "<u8"), _unpacked(p["count"], p["n"], "<u8")
        number[-1], count[-1] = END, trained  # the end token behind the words
        first = np.array(row["first"], np.int64)
        self.train = ~np.array(row["held"], bool)
        self.docs = row["docs"]
        self.word = np.insert(ids, first[1:], n_words)
        self.first = first + np.arange(len(first))
        self.count = count
        self.tokens = tokens
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.first[:-1]] = n_words + 1  # the start
        key, self.pair = np.unique(before * (n_words + 2) + self.word, return_inverse=True)
        left, right = key // (n_words + 2), key % (n_words + 2)
        context_number = np.append(number, START)
        context_number[n_words] = END
        context_count = np.append(count, trained)
        shard = _mix(context_number[left]) % np.uint64(shards)
        hot = context_count[left] > tokens / shards
        shard[hot] = _mix(context_number[left[hot]] * 1_000_003 + number[right[hot]]) % np.uint64(shards)
        order = np.lexsort((number[right], context_number[left], shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[self.pair]
        times = np.bincount(self.pair, np.repeat(self.train, np.diff(self.first)), len(order)).astype(np.int64)
        self.shard, self.left, self.right, self.times = shard[order].astype(np.int64), context_number[left[order]], number[right[order]], times
        self.left_count, self.right_count = context_count[left[order]], count[right[order]]

    def parts(self) -> Iterator[tuple[int, int, int]]:
        """(shard, begin, end) of the pairs that go to each shard."""
        cut = np.flatnonzero(np.diff(self.shard)) + 1
        for a, b in zip(np.concatenate([[0], cut]).tolist(), np.append(cut, len(self.shard)).tolist(), strict=True):
            if b > a:
                yield int(self.shard[a]), a, b


def _contexts(left: np.ndarray) -> np.ndarray:
    """Where each context of sorted pairs begins."""
    return np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(left) else np.zeros(0, np.int64)


_ASKED = "shard bigint, block bigint, n int, m int, size binary, left binary, total binary, right binary, times binary"


def _asked(scalars: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, tokens, shards = scalars
        for batch in batches:
            for row in (batch.slice(r, 1).to_pylist()[0] for r in range(batch.num_rows)):
                block = Block(row, trained, tokens, shards)
                out = []
                for s, a, b in block.parts():
                    left = block.left[a:b]
                    at = _contexts(left)
                    out.append((s, row["block"], b - a, len(at), _packed(np.diff(np.append(at, b - a)), "<u4"), _packed(left[at], "<u8"), _packed(block.left_count[a:b][at], "<u8"), _packed(block.right[a:b], "<u8"), _packed(np.minimum(block.times[a:b], (1 << 32) - 1), "<u4")))
                yield pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in _ASKED.split(", ")], o, strict=True)) for o in out], _schema(_ASKED))

    return run


def _schema(text: str) -> pa.Schema:
    kinds = {"array<bigint>": pa.list_(pa.int64()), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in text.split(", ")])


_ANSWERED = "block bigint, shard bigint, n int, m int, followers binary, codes binary, asked array<bigint>, hot array<bigint>, hot_followers array<bigint>"


def code_of(p: np.ndarray) -> np.ndarray:
    """Codes 1-255 of positive probabilities, 0 for none."""
    with np.errstate(divide="ignore"):
        step = np.clip(np.rint(-np.log10(p) / LOWEST * 254), 0, 254)
    return np.where(p > 0, step + 1, 0).astype(np.uint8)


_DECODED = np.concatenate([[0.0], 10.0 ** (-np.arange(255) / 254 * LOWEST)])


def _answers(rows: list[dict], most: float) -> Iterator[pa.RecordBatch]:
    """One shard: its trie from all blocks' pairs, then each block's answers. Contexts of more than `most` tokens have pairs on other shards too: the first row has their followers here, each row those that its block asked for."""
    parts = []
    for r in rows:
        size, left, total = _unpacked(r["size"], r["m"], "<u4"), _unpacked(r["left"], r["m"], "<u8"), _unpacked(r["total"], r["m"], "<u8")
        parts.append((left.astype(np.int64), size, total, _unpacked(r["right"], r["n"], "<u8").astype(np.int64), _unpacked(r["times"], r["n"], "<u4")))
    left, total = (np.concatenate([np.repeat(p[i], p[1]) for p in parts]) for i in (0, 2))
    right, times = (np.concatenate([p[i] for p in parts]) for i in (3, 4))
    live = times > 0
    left, total, right, times = left[live], total[live], right[live], times[live]
    order = np.lexsort((right, left))
    left, total, right, times = left[order], total[order], right[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])) if len(left) else np.zeros(0, np.int64)
    count = np.add.reduceat(times.astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
    left, total, right = left[new], total[new], right[new]
    at = _contexts(left)
    made = Trie.of(left[at], np.append(at, len(left)), right, code_of(np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1)))
    followers = np.diff(np.append(at, len(left)))
    with tempfile.TemporaryDirectory() as folder:  # for this task alone
        made.save(folder)
        trie = Trie.mapped(folder)
        out, hot = [], np.flatnonzero(total[at] > most)
        for r, (contexts, size, asked, children, _) in zip(rows, parts, strict=True):
            place = trie.context(contexts)
            t = np.where(place >= 0, followers[np.maximum(place, 0)] if len(followers) else 0, 0)
            codes = trie.codes_of(np.repeat(place, size), children)
            out.append({"block": r["block"], "shard": r["shard"], "n": r["n"], "m": r["m"], "followers": _packed(t, "<u4"), "codes": _packed(codes, "<u1"), "asked": contexts[asked > most].tolist(), "hot": [] if out else left[at][hot].tolist(), "hot_followers": [] if out else followers[hot].tolist()})
        del trie
    yield pa.RecordBatch.from_pylist(out, _schema(_ANSWERED))


def _by_shard(most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if held and row["shard"] != held[0]["shard"]:
                    yield from _answers(held, most)
                    held = []
                held.append(row)
        if held:
            yield from _answers(held, most)

    return run


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scored(scalars: tuple[int, int, int], kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, tokens, shards = scalars
        for batch in batches:
            for row in (batch.slice(r, 1).to_pylist()[0] for r in range(batch.num_rows)):
                block = Block(row, trained, tokens, shards)
                code, follow = np.zeros(len(block.shard), np.uint8), np.zeros(len(block.shard), np.int64)
                answers = {a["shard"]: a for a in row["answers"] or []}
                for s, a, b in block.parts():
                    got = answers[s]
                    at = _contexts(block.left[a:b])
                    size = np.diff(np.append(at, b - a))
                    code[a:b] = _unpacked(got["codes"], got["n"], "<u1")
                    t = _unpacked(got["followers"], got["m"], "<u4")
                    follow[a:b] = np.repeat(t, size)
                split = {h["context"]: h["followers"] for h in row["hot"] or []}
                if split:  # a context on several shards has the followers of all
                    hot = np.flatnonzero(block.left_count > tokens / shards)
                    follow[hot] = [split.get(v, 0) for v in block.left[hot].tolist()]
                word = (block.right_count + 1) / (tokens + kinds + 1)
                n = np.maximum(block.left_count, 1)
                p = np.where(block.left_count > 0, _DECODED[code] + np.maximum(follow, 1) * DISCOUNT / n * word, word)
                base = np.log10((block.count[block.word] + 1) / (tokens + kinds + 1))
                some = len(block.docs)
                sums = lambda v, kind=np.float64: C.per_doc(v, block.first, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.docs, pa.int64()), pa.array(~block.train), pa.array(np.diff(block.first)), pa.array(sums((block.count[block.word] > 0).astype(np.int64), np.int64)),
                        pa.array(np.full(some, tokens, np.int64)), pa.array(sums(base)), pa.array(sums(np.log10(p)[block.pair])),
                    ],
                    [c.split()[0] for c in RESULT.split(", ")],
                )

    return run


def score(documents: DataFrame, held_out: Column, budget: int = BLOCK) -> DataFrame:
    """Scores of all documents by a model of those that held_out doesn't mark."""
    blocks = C.stored(documents.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held"), "text").mapInArrow(_in_blocks(budget), _BLOCKS))
    n, tokens, trained = blocks.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()
    shards = max(1, n)
    parts = max(1, n, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words = blocks.select("block", "words", "counts").mapInArrow(_words_out, "word binary, block bigint, place int, count int")
    numbers = C.stored(words.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(_numbered(parts), _NUMBERED))
    kinds = (numbers.agg(F.sum("known")).first()[0] or 0) + (trained > 0)
    few = max(1, -(-n // 2))  # blocks are large rows; all that is joined by block is dealt once, to as many parts
    of = numbers.repartition(few, "block").groupBy("block").agg(F.collect_list(F.struct("n", "place", "number", "count")).alias("numbers"))
    full = blocks.drop("words", "counts").repartition(few, "block").join(of, "block", "left")
    scalars = (trained, tokens, shards)
    asked = full.mapInArrow(_asked(scalars), _ASKED)
    answered = C.stored(asked.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_by_shard(tokens / shards), _ANSWERED))
    answers = answered.repartition(few, "block").groupBy("block").agg(F.collect_list(F.struct("shard", "n", "m", "followers", "codes")).alias("answers"))
    parted = answered.select(F.explode(F.arrays_zip("hot", "hot_followers")).alias("h")).groupBy(F.col("h.hot").alias("context")).agg(F.sum("h.hot_followers").alias("followers"))
    wanted = answered.select("block", F.explode("asked").alias("context")).distinct()
    hot = wanted.join(parted, "context").repartition(few, "block").groupBy("block").agg(F.collect_list(F.struct("context", "followers")).alias("hot"))
    rows = full.join(answers, "block", "left").join(hot, "block", "left")
    return rows.mapInArrow(_scored(scalars, kinds), RESULT)
