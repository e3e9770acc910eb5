"""Language identification by words first, then by ever shorter character n-grams.

A known word scores its smoothed log frequency in every language.  An unseen word falls
back to the character n-grams of the longest length of which the model knows at least one
(5 down to 1), averaged; a word without any known n-gram says nothing.  A document's
scores are sums over its words, and the answer is the language with the largest.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every
text where no language was learned.  A text with letters of which nothing is known gets
the most frequent language.  Ties go to the first language in alphabetical order.  Repeated rows
are read and answered one by one, very long texts whole; an empty table gives an empty one.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import common as C

#: Bounds of the model, for each language: documents read, words kept, n-grams kept.
TRAIN_ROWS, WORDS, GRAMS, LONGEST = 4_000, 20_000, 40_000, 5
UND = "und"


def normalised(word: bytes) -> str:
    """Lower-cased, without the non-letters at its ends; empty if it has no letter."""
    w = word.decode("utf-8", "replace").lower()
    if w.isalpha():
        return w
    a, b = 0, len(w)
    while a < b and not w[a].isalpha():
        a += 1
    while b > a and not w[b - 1].isalpha():
        b -= 1
    return w[a:b]


def grams(word: str, n: int) -> list[str]:
    w = f"_{word}_" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    words: dict[str, int]
    word_scores: np.ndarray  # a row of log probabilities a known word, less the row's largest
    grams: dict[str, int]
    gram_scores: np.ndarray
    cache: dict[bytes, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "rows": None}

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word by language, and whether it has a letter."""
        out, letter = np.zeros((len(words), len(self.languages)), np.float32), np.zeros(len(words), bool)
        known_at, known, unseen_at, unseen = [], [], [], []
        word_of, gram_of = self.words.get, self.grams.get
        for i, raw in enumerate(words):
            w = normalised(raw)
            if not w:
                continue
            letter[i] = True
            if (k := word_of(w)) is not None:
                known_at.append(i)
                known.append(k)
                continue
            for n in range(min(LONGEST, len(w) + 2), 0, -1):
                found = [g for g in map(gram_of, grams(w, n)) if g is not None]
                if found:
                    unseen_at += [i] * len(found)
                    unseen += found
                    break
        out[known_at] = self.word_scores[known]
        if unseen:
            times = np.bincount(unseen_at, minlength=len(words))
            for k in range(len(self.languages)):
                out[:, k] += (np.bincount(unseen_at, self.gram_scores[unseen, k], len(words)) / np.maximum(times, 1)).astype(np.float32)
        return out, letter

    def cached(self, words: list[bytes], most: int = 400_000) -> np.ndarray:
        """of_words() with the last column telling letters, kept for words met again in the same task."""
        width = len(self.languages) + 1
        if self.rows is None or len(self.cache) + len(words) > len(self.rows):
            self.cache, self.rows = {}, np.zeros((max(most, len(words)), width), np.float32)
        at = [self.cache.get(w, -1) for w in words]
        at = np.array(at, np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new]
            scores, letter = self.of_words(fresh)
            n = len(self.cache)
            self.rows[n : n + len(new), :-1], self.rows[n : n + len(new), -1] = scores, letter
            self.cache.update(zip(fresh, range(n, n + len(new)), strict=True))
            at[new] = np.arange(n, n + len(new))
        return self.rows[at]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        flat = C.Flat(texts)
        if not self.languages:
            return [UND] * flat.n, np.zeros(flat.n)
        mask = C.WORD_BYTE[flat.data]
        starts, ends, first = flat.spans(mask)
        ids, distinct = C.encoded(C.sliced(flat.data, starts, ends, mask))
        rows = self.cached(distinct.to_pylist())
        sums = np.stack([C.per_doc(rows[:, k][ids].astype(np.float64), first) for k in range(rows.shape[1])], 1)
        total, letters = sums[:, :-1] + self.prior, sums[:, -1] > 0
        best = total.argmax(1)
        p = np.exp(total - total.max(1, keepdims=True))
        p = p[np.arange(flat.n), best] / p.sum(1)
        return [self.languages[k] if ok else UND for k, ok in zip(best, letters, strict=True)], np.where(letters, p, 0.0)


def _table(counts: dict[str, np.ndarray], smoothing: float) -> tuple[dict[str, int], np.ndarray]:
    keys = sorted(counts)
    if not keys:
        return {}, np.zeros((0, 1), np.float32)
    m = np.array([counts[k] for k in keys], float)
    p = np.log((m + smoothing) / (m.sum(0) + smoothing * len(keys)))
    return dict(zip(keys, range(len(keys)), strict=True)), (p - p.max(1, keepdims=True)).astype(np.float32)


def build(counts: list[tuple[str, str, int]], documents: dict[str, int]) -> Model:
    """counts: (language, word, times); documents: training documents of each language."""
    languages = sorted(documents)
    place = {lang: k for k, lang in enumerate(languages)}
    words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    by_length: Counter = Counter()
    pieces: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    for lang, word, n in counts:
        words[word][place[lang]] += n
    for word, n in words.items():
        for k in range(1, LONGEST + 1):
            for g in grams(word, k):
                pieces[g] += n
                by_length[k] += 1
    # each language keeps its own most frequent ones, with their counts in all languages
    kept = sorted({g for k in range(len(languages)) for g in sorted((g for g in pieces if pieces[g][k]), key=lambda g: (-pieces[g][k], g))[:GRAMS]})
    # frequencies of n-grams are taken among those of one length
    names: dict[str, int] = {}
    scores = []
    for k in range(1, LONGEST + 1):
        of_length, table = _table({g: pieces[g] for g in kept if len(g) == k}, 0.5)
        names |= {g: i + sum(map(len, scores)) for g, i in of_length.items()}
        if of_length:
            scores.append(table)
    prior = np.log(np.array([documents[lang] for lang in languages], float) / max(1, sum(documents.values()))) if languages else np.zeros(0)
    known, table = _table(dict(words), 0.2)
    return Model(languages, prior, known, table, names, np.concatenate(scores) if scores else np.zeros((0, len(languages)), np.float32))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in C.in_blocks(batches):
        flat = C.Flat(block.column("text"))
        langs, distinct_langs = block.column("lang").dictionary_encode().indices.to_numpy(), block.column("lang").dictionary_encode().dictionary.to_pylist()
        mask = C.WORD_BYTE[flat.data]
        starts, ends, first = flat.spans(mask)
        ids, distinct = C.encoded(C.sliced(flat.data, starts, ends, mask))
        key, times = np.unique(np.repeat(langs, np.diff(first)) * (len(distinct) + 1) + ids, return_counts=True)
        lang, word = key // (len(distinct) + 1), key % (len(distinct) + 1)
        names = [normalised(w) for w in distinct.to_pylist()]
        found = [(distinct_langs[a], names[b], int(n)) for a, b, n in zip(lang, word, times, strict=True) if names[b]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])


def fit(documents: DataFrame, keep: Column | None = None, limit: int = TRAIN_ROWS, words: int = WORDS) -> Model:
    """Counts the words of at most `limit` documents of each language. A language keeps its `words` most frequent ones, and every word kept has its true count in each language; the prior counts all documents."""
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if keep is not None:
        rows = rows.where(keep)
    chosen = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))  # tasks pass on `limit` ids of a language at most
    ids = rows.select("lang", "doc_id").withColumn("n", chosen).where(F.col("n") <= limit).select("doc_id").distinct()
    sample = rows.select("doc_id", "lang", "text").join(ids, "doc_id", "left_semi")
    counts = C.stored(sample.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    known = counts.withColumn("place", place).where(F.col("place") <= words).select("word").distinct()
    numbers = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    return build([(r.lang, r.word, r.n) for r in counts.join(known, "word", "left_semi").collect()], numbers)


RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double"


def predict(documents: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Language and posterior of every document. The broadcast model is bounded by WORDS and GRAMS for each language."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in C.in_blocks(batches):
            lang, p = model.predict(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), pa.array(lang, pa.string()), pa.array(p)], ["doc_id", "held_out", "lang_pred", "score"])

    return documents.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, RESULT)
