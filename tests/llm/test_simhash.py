import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from quern.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, width=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    rng = random.Random(2)
    texts = [None, "", " \n", "One", "one two", "A b C"] + [" ".join(rng.choices(["a", "B", "ñé", "x.", "\t", "zz"], k=rng.randrange(40))) for _ in range(80)]
    for w in (1, 3, 5):
        assert [int(f) for f in S.fingerprints_of(pa.array(texts, pa.string()), w)] == [brute(t, w) for t in texts]


def test_every_close_pair_meets():
    rng = random.Random(3)
    for radius, level in ((3, 0), (3, 2), (5, 0), (6, 0)):
        tables = S.masks(level, radius)
        assert min(bin(m).count("1") for m in tables) >= 16
        assert len(tables) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            d = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(d & m == 0 for m in tables)


def components(f, radius):
    out = list(range(len(f)))
    for _ in f:
        new = [min(out[j] for j in range(len(f)) if bin(f[i] ^ f[j]).count("1") <= radius) for i in range(len(f))]
        if new == out:
            return out
        out = new
    return out


def test_links_and_components(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    f = [0, 0, 7]
    for b in base:
        for _ in range(12):
            b ^= sum(1 << x for x in rng.sample(range(64), rng.choice([0, 1, 3, 4])))
            f.append(b)
    signed = [x - (1 << 64) if x >> 63 else x for x in f]
    rows = spark.createDataFrame([(v, v) for v in set(signed)], "id long, f long")
    want = components(f, 3)
    for most in (4096, 3):  # with 3, buckets are dealt again
        roots = {r.f: r.root for r in S.classes(rows, ["f"], [3]).collect()} if most == 4096 else {r.f: r.root for r in _classes(rows, most).collect()}
        got = [roots[x] for x in signed]
        assert [[a == b for b in got] for a in got] == [[a == b for b in want] for a in want]


def _classes(rows, most):
    from quern.llm.components import components as cc

    roots = cc(S.links(rows, ["f"], [3], most))
    return rows.join(roots, rows["id"] == roots["node"], "left").selectExpr("f", "coalesce(root, id) as root")


def test_score_and_keep(spark):
    long = " ".join(f"w{i}" for i in range(300))
    other = " ".join(f"v{i * i}" for i in range(300))
    docs = spark.createDataFrame([(5, long, "a"), (3, long, "b"), (3, long, "b"), (9, long.replace("w7 ", "q "), "c"), (1, None, "d"), (2, "", "e"), (4, other, None), (None, other, "f")], "doc_id long, text string, root string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.score(docs).collect()}
    assert (1, "0" * 16, 1) in got and (2, "0" * 16, 1) in got and {c for d, _, c in got if d in (3, 5)} == {3} and {c for d, _, c in got if d in (4, None)} == {4}
    kept = S.keep(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.root) for r in kept.collect()) in ([(0, "f"), (1, "d"), (3, "b")], [(0, "f"), (1, "d"), (3, "b")])
    empty = docs.limit(0)
    assert S.score(empty).count() == 0 and S.keep(empty).count() == 0


def test_shingle_sets():
    texts = [None, "", "a B c", "a b C d e", "a b c d e a b c d e a b c d e", "x a b c d e"]
    sets = [set(x) for x in S.shingle_sets(pa.array(texts, pa.string())).to_pylist()]
    assert [len(s) for s in sets] == [0, 0, 1, 1, 5, 2] and sets[3] < sets[4] and sets[3] < sets[5]


def test_similarity_decides(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in rng.choices(range(3000), [1 / (k + 1) for k in range(3000)], k=400)]

    def changed(k):
        w = list(base)
        for i in range(k):
            w[5 + i * 13] = f"q{k}x{i}"
        return " ".join(w)

    # k changes leave (396 - 5 k) of (396 + 5 k) shingles: 0.89 at 5, 0.5 at 26
    docs = spark.createDataFrame([(1, " ".join(base)), (2, changed(5)), (3, changed(26))], "doc_id long, text string")
    assert sorted(r.doc_id for r in S.keep(docs).collect()) == [1, 3]


def jaccard_components(texts):
    sets = [set(x) for x in S.shingle_sets(pa.array(texts)).to_pylist()]
    near = [[j for j in range(len(sets)) if len(x & sets[j]) >= 0.8 * len(x | sets[j])] for x in sets]
    out = list(range(len(sets)))
    while (new := [min(out[j] for j in near[i]) for i in range(len(sets))]) != out:
        out = new
    return out


def edited(rng, words, k):
    w = list(words)
    for i in rng.sample(range(len(w)), k):
        w[i] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def kept_of(spark, texts):
    return sorted(r.doc_id for r in S.keep(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())


def test_no_similar_pair_is_left_out_of_a_group(spark):
    rng = random.Random(31)
    texts = []
    for _ in range(12):  # pairs on both sides of 0.8, linked through some members only
        base = [f"w{rng.randrange(4000)}" for _ in range(200)]
        texts += [edited(rng, base, rng.randrange(1, 6)) for _ in range(25)]
    assert kept_of(spark, texts) == sorted(set(jaccard_components(texts)))


def test_tiles_meet(spark):
    rng = random.Random(32)
    base = [f"w{k}" for k in range(60)]
    texts = [edited(rng, base, rng.randrange(1, 4)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sizes = spark.createDataFrame([(i, len(s)) for i, s in enumerate(S.shingle_sets(pa.array(texts)).to_pylist())], "id long, n long")
    star = spark.createDataFrame([(0, i) for i in range(1, 60)], "a long, b long")
    want = jaccard_components(texts)
    for most in (S.TILE, 700):
        out = list(range(60))
        for a, b in S.verified(star, sizes, docs, most=most).collect():
            x, y = sorted((out[a], out[b]))
            out = [x if v == y else v for v in out]
        assert out == want and 1 < len(set(want)) < 60


def tails(rng, n, count):
    """Pairs (text, the same with an appended or a replaced tail) of similarity 0.8 or more."""
    out = []
    for i in range(count):
        w = [f"w{rng.randrange(5000)}" for _ in range(n)]
        new = [f"v{rng.randrange(5000)}" for _ in range(max(1, n // 5 - 2 if i % 2 else n // 10 - 2))]
        out.append((" ".join(w), " ".join(w + new if i % 2 else w[: n - len(new)] + new)))
    return out


def test_changed_tails_are_found(spark):
    rng = random.Random(33)
    pairs = [p for n in (30, 100, 200) for p in tails(rng, n, 40)]
    texts = [t for p in pairs for t in p]
    assert sum(len(x & y) >= 0.8 * len(x | y) for x, y in ((set(a), set(b)) for a, b in (S.shingle_sets(pa.array(p)).to_pylist() for p in pairs))) > 110
    assert kept_of(spark, texts) == sorted(set(jaccard_components(texts)))


def test_many_texts_of_one_fingerprint(spark):
    rng = random.Random(34)
    texts = [" ".join(["the"] * 7 + [f"w{rng.randrange(10**6)}" for _ in range(6)]) for _ in range(S.BUCKET + 500)]
    assert len(set(S.fingerprints_of(pa.array(texts), 1).tolist())) == 1
    assert kept_of(spark, [*texts, texts[7], texts[9] + " "]) == list(range(len(texts)))


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    """Without the bands, keep() finds the similar texts that fingerprints within the radius connect, and no others."""
    rng = random.Random(35)
    base = [[f"w{rng.randrange(4000)}" for _ in range(300)] for _ in range(8)]
    texts = [edited(rng, b, k) for b in base for k in (0, 1, 2, 3, 12)] + [None, "", "a b", "A  b"]
    prints = [int(f) for f in S.fingerprints_of(pa.array(texts))]
    rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(prints)], "id long, f long")
    want = components(prints, S.RADIUS)
    roots = {r.node: r.root for r in S.components(S.print_links(rows)).collect()}
    assert [roots.get(i, i) for i in range(len(texts))] == want and 20 < len(set(want)) < 40
    monkeypatch.setattr(S, "band_links", lambda distinct: distinct.selectExpr("id as a", "id as b").limit(0))
    kept = set(kept_of(spark, texts))
    found = [i for i, r in enumerate(want) if r != i]
    similar = jaccard_components(texts)
    assert {i for i in found if similar[i] == similar[want[i]] and texts[i]} <= set(range(len(texts))) - kept
    assert {0, 5, 10, 15, 20, 25, 30, 35} <= kept and 41 not in kept and 43 not in kept  # texts without words, equal words
