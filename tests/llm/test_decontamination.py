import random
import re

from quern.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, items, width):
    windows = [(i, tuple(w[k : k + width])) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - width + 1))]
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(str(item))
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "B", "cé", "d1", "日本", "e"]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "'"]) for _ in range(n))
    items = [(i, make(rng.randrange(1, 9))) for i in range(12)] + [(90, None), (91, " ., "), (3, "a B"), (92, "e")]
    texts = [make(rng.randrange(60)) for _ in range(40)] + [None, "", " . ", items[2][1], "x" * 30_000]
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for width, most in ((4, 20_000), (4, 3), (13, 20_000), (2, 9)):
        blocks = list(D.item_blocks(bench, most))
        got = D.scan([(t or "").encode() for t in texts], blocks, width)
        want = brute(texts, items, width)
        assert [(n, sum(b - a for a, b in runs), sorted(i)) for n, runs, i in got] == [w[:3] for w in want]
    rows = {r.doc_id: r for r in D.match(docs, bench, 4).collect()}
    want = brute(texts, items, 4)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == want[i]
        assert sum(len(words(t[s.start : s.end])) for s in r.spans) == r.n_hit
    kept = D.keep(docs, bench, 4)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, w in enumerate(want) if not w[1]]
    assert D.match(docs.limit(0), bench).count() == 0 and D.match(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_many_benchmarks_in_one_session(spark):
    """Reused workers answer for the benchmark that they are asked about."""
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choices("abcdef", k=4)) for _ in range(20))
    items = [text() for _ in range(12)]
    docs = spark.createDataFrame([(i, f"{text()} {t} {text()}") for i, t in enumerate(items)], "doc_id long, text string").repartition(4).cache()
    for k in range(24):
        bench = spark.createDataFrame([(k % 12, items[k % 12])], "item_id long, text string")
        assert {r.doc_id: r.n_hit for r in D.match(docs, bench).where("n_hit > 0").collect()} == {k % 12: 20}
        if k % 6 == 0:
            assert D.keep(docs, bench).where(f"doc_id = {k % 12}").count() == 0


def test_a_hit_in_a_very_long_text(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdef", k=5))
    item = " ".join(word() for _ in range(13))
    long = " ".join([*(word() for _ in range(300_000)), item, *(word() for _ in range(10))])
    docs = spark.createDataFrame([(1, long), (2, long.replace(item, item[:-1]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in D.match(docs, bench).collect()}
    assert (got[1].n_hit, got[1].contaminated, got[2].n_hit) == (13, False, 0)
    assert long[got[1].spans[0].start : got[1].spans[0].end] == item
    assert [r.doc_id for r in D.keep(docs, bench).collect()] == [2]
