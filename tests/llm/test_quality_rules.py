import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quern.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts_match_brute_force():
    rng = random.Random(1)
    bits = ["a", "bb", "é", "ñu", " ", "\n", "\t", " ", "x*", "|", "\n", "\x0b", "日本", " a bb a bb a ", "\r\n"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(80))) for _ in range(400)] + [None, "", "\n", "a\n", "\na", "a\na\n", "a\na", " \n \n", "w " * 5000]
    for part in (texts, texts[::-1], [""], [None]):
        counts, x = Q.document_statistics(pa.array(part, pa.string()))
        got = list(zip(*(counts[k].tolist() for k in Q.COUNTS), strict=True))
        assert got == [brute(t) for t in part]
        assert np.isfinite(x).all()


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.6) ^ (rng.random(3000) < 0.05)).astype(float)
    t = Q.fit_trees(x, y, [1, -1, 0], rounds=30)
    assert ((t.probability(x) > 0.5) == (x[:, 0] > 0.6)).mean() > 0.95
    grid = np.linspace(0, 1, 50)
    for row in x[:50]:
        many = np.repeat(row[None], 50, 0)
        many[:, 0] = grid
        assert (np.diff(t.probability(many)) >= -1e-12).all()
        many = np.repeat(row[None], 50, 0)
        many[:, 1] = grid
        assert (np.diff(t.probability(many)) <= 1e-12).all()


def test_one_class_is_constant():
    t = Q.fit_trees(np.random.rand(50, 2), np.ones(50), [0, 0])
    assert set(t.probability(np.random.rand(9, 2)).round(9)) == {0.98}


def test_spark_edges(spark):
    docs = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (2, "", "z"), (3, " ".join(f"w{i}" for i in range(40)), None), (None, "a b", "z")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(3, 1, None), (3, 1, 0), (None, 0, 1), (2, None, 1)], "doc_id long, quality int, text int")
    trees = Q.fit(docs, labels)
    rows = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in Q.score(docs, trees).collect()}
    assert rows == {(1, 0, True, False), (2, 0, True, False), (3, 40, False, True), (None, 2, True, False)}
    kept = Q.keep(docs, trees)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [3]
    empty = docs.limit(0)
    assert Q.score(empty, Q.fit(empty, labels.limit(0))).count() == 0


def test_sample_keeps_the_class_ratio(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    x = Q.document_statistics(pa.array([text]))[1]
    for limit in (Q.TRAIN_ROWS, 150, 60):  # all labels; one class is cut; both are
        assert abs(Q.fit(docs, labels, limit=limit).probability(x)[0] - 0.75) < 0.01
