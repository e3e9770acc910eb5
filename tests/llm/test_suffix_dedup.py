import hashlib
import random

import numpy as np

from quern.llm import suffix_dedup as D
from quern.llm.suffix_array import suffix_array


def test_suffix_array_is_the_order_of_suffixes():
    rng = random.Random(4)
    for k in range(400):
        s = [rng.randint(1, rng.choice([1, 2, 3, 200])) for _ in range(rng.randrange(1, 60))]
        assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    cover = [bytearray(len(t)) for t in texts]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                cover[d][i : i + length] = b"\1" * length
    out = []
    for t, c in zip(texts, cover, strict=True):
        spans = sum(1 for i in range(len(c)) if c[i] and (i == 0 or not c[i - 1]))
        out.append((len(t), sum(c), spans, hashlib.sha256(bytes(x for x, m in zip(t, c, strict=True) if not m)).hexdigest()))
    return out


def corpus(rng, length):
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 6)))
    passage = [" ".join(word() for _ in range(length)) for _ in range(4)]
    texts = [None, "", "short", "x" * (3 * length), "ab" * (2 * length), "日本" * length]
    for _ in range(25):
        t = " ".join(word() for _ in range(rng.randrange(length)))
        p = rng.choice(passage)
        a = rng.randrange(len(p) // 2)
        texts.append(t + p[a : a + rng.randrange(length // 2, 3 * length)] + " ".join(word() for _ in range(20)))
    texts += texts[8:11] + [texts[9][:-3] + "zz", texts[12].replace("a", "b", 2)]
    return texts


def test_against_brute_force(spark):
    rng = random.Random(9)
    for length, most in ((48, D.HOT), (48, 3), (70, 0)):
        texts = corpus(rng, length)
        docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, k long").repartition(5)
        old, D.SORT_BYTES = D.SORT_BYTES, 2000
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.score(docs, length, most).collect()}
        D.SORT_BYTES = old
        assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_words_of_a_passage(spark):
    """Passages of 51 and more words go wherever they are, shorter ones stay; other columns stay, whatever their names."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (51, 55, 60, 90, 44, 30)]
    rows = []
    for i in range(60):
        body = [word() for _ in range(rng.randrange(20, 200))]
        rows.append((i, " ".join([*body[:15], passages[i % 6], *body[15:]]), "x", i))
    rows += [(60, None, "y", 60), (61, "", "y", 61), (62, passages[0], "y", 62)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string, cut long")
    got = {r.doc_id: r for r in D.keep(docs).collect()}
    assert 62 not in got and got[60].text is None and got[61].text == "" and got[5].t == "x"
    for i in range(60):
        assert got[i].cut == i
        assert (passages[i % 6] in got[i].text) == (i % 6 > 3), i
        if i % 6 > 3:
            assert got[i].text == rows[i][1]
        else:
            assert len(got[i].text.split()) >= len(rows[i][1].split()) - len(passages[i % 6].split()) - 1


def test_a_very_long_text(spark):
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefgh ", k=3_000_000))
    docs = spark.createDataFrame([(1, long), (2, "q" + long[1_000_000:1_000_500] + "q"), (3, long[:399])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in D.score(docs).collect()}
    assert got == {1: (500, 1), 2: (500, 1), 3: (0, 0)}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert D.score(empty).count() == 0
    t = "".join(chr(97 + i * i % 26) for i in range(500))
    docs = spark.createDataFrame([(None, t), (1, t), (1, t), (2, "q")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in D.score(docs).collect())
    assert got == [("1", 500, 1), ("1", 500, 1), ("2", 0, 0), ("None", 500, 1)]
