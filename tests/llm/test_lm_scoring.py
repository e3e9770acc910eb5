import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import lm_scoring as L
from quern.llm.elias_fano import EliasFano, Trie


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 1), (5, 3), (200, 50), (3000, 1 << 40), (777, 800), (64, 1 << 62)):
        v = np.sort(rng.integers(0, top, n))
        e = EliasFano.of(v)
        assert e.get(np.arange(n)).tolist() == v.tolist()
        x = np.concatenate([rng.integers(0, top + 3, 500), v, v + 1, [0, top, top + 2]])
        assert e.successor(x).tolist() == np.searchsorted(v, x).tolist()


def test_trie(tmp_path):
    rng = random.Random(2)
    pairs = sorted({(rng.randrange(1 << 20), rng.randrange(1 << 33)) for _ in range(2000)} | {(5, k) for k in range(400)})
    codes = [rng.randrange(1, 256) for _ in pairs]
    left = np.array([p[0] for p in pairs])
    at = np.flatnonzero(np.diff(left, prepend=-1))
    Trie.of(left[at], np.append(at, len(left)), np.array([p[1] for p in pairs]), np.array(codes)).save(str(tmp_path))
    trie = Trie.mapped(str(tmp_path))
    want = dict(zip(pairs, codes, strict=True))
    ask = pairs + [(rng.choice(pairs)[0], rng.choice(pairs)[1]) for _ in range(2000)] + [(rng.randrange(1 << 21), 3) for _ in range(500)]
    a, b = (np.array(x) for x in zip(*ask, strict=True))
    assert trie.codes_of(trie.context(a), b).tolist() == [want.get(p, 0) for p in ask]


def brute(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    docs = [(d, h, [*word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for d, h, t in rows]
    c, pair, total = Counter(), Counter(), Counter()
    for _, h, w in docs:
        if not h:
            c.update(w)
            for a, b in zip(["", *w], w, strict=False):
                pair[a, b] += 1
                total[a] += 1
    follow = defaultdict(int)
    for a, _ in pair:
        follow[a] += 1
    n, v = sum(c.values()), len(c)
    out = {}
    for d, h, w in docs:
        base = score = 0.0
        for a, b in zip(["", *w], w, strict=False):
            p = (c[b] + 1) / (n + v + 1)
            base += math.log10(p)
            if total[a]:
                first = max(pair[a, b] - L.DISCOUNT, 0) / total[a]
                p = (10 ** (-round(-math.log10(first) / L.LOWEST * 254) / 254 * L.LOWEST) if first else 0) + L.DISCOUNT * follow[a] / total[a] * p
            score += math.log10(p)
        out[d] = (h, len(w), sum(c[x] > 0 for x in w), n, base, score)
    return out


@pytest.mark.parametrize("budget", [100, 400, 1 << 20])
def test_against_brute_force(spark, budget):
    rng = random.Random(8)
    words = ["the", "The", "é", "a.", "b", "日本"] + [f"w{k}" for k in range(30)]
    rows = [(i, i % 5 == 2, " ".join(rng.choices(words, [40, 9, 5, 5, 5, 5, *[1] * 30], k=rng.randrange(60)))) for i in range(60)]
    rows += [(60, False, None), (61, True, ""), (62, True, "unseen words only"), (63, False, rows[4][2]), (64, True, " \t ")]
    docs = spark.createDataFrame([(d, t, h) for d, h, t in rows], "doc_id long, text string, held boolean").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in L.score(docs, F.col("held"), budget).collect()}
    for d, w in brute(rows).items():
        assert got[d][:4] == w[:4]
        assert got[d][4:] == pytest.approx(w[4:], rel=1e-9)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", True), (None, None, True)], "doc_id long, text string, held boolean")
    got = sorted(tuple(r)[2:5] for r in L.score(docs, F.col("held")).collect())
    assert got == [(1, 0, 0), (3, 0, 0)]
    assert L.score(docs.limit(0), F.col("held")).count() == 0
