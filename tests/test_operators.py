import random

import pytest
from pyspark.sql import functions as F

from quern.operators import chunking, qa_datasets, regions, retrieval, selection, splitting


def greedy(rows, tokens, budget):
    """rows in rank order (start, end): the plain loop."""
    seen, used, out = set(), 0, []
    for rank, (a, b) in enumerate(rows, 1):
        new = [i for i in range(a, b) if i not in seen]
        if not new:
            continue
        cost = sum(tokens[i] for i in new)
        if used >= budget or used + cost > budget:
            break
        used += cost
        seen |= set(new)
        out += [(rank, i) for i in new]
    return sorted(out)


def test_region_selection_is_the_greedy_loop(spark):
    rng = random.Random(1)
    tokens = [rng.randrange(1, 30) for _ in range(40)]
    cases = {}
    for q in range(60):
        spans = [(a, a + rng.randrange(1, 6)) for a in (rng.randrange(34) for _ in range(12))]
        scores = [rng.choice([0.1, 0.2, 0.5, float("-inf")]) for _ in spans]
        cases[q] = [(q, k // 4 + 1, k % 4, s, a, b) for k, ((a, b), s) in enumerate(zip(spans, scores))]
    reg = spark.createDataFrame([r for c in cases.values() for r in c], "query_id int, chunk_rank int, region_id int, score double, start int, end int")
    counts = spark.createDataFrame(list(enumerate(tokens)), "subchunk_id int, tokens int")
    for budget in (25, 60, 200):
        got = {}
        for r in selection.select_regions(reg, counts, budget).collect():
            got.setdefault(r.query_id, []).append((r.region_rank, r.subchunk_id))
        for q, rows in cases.items():
            ranked = [(a, b) for *_, a, b in sorted(rows, key=lambda r: (-r[3], r[1], r[2]))]
            assert sorted(got.get(q, [])) == greedy(ranked, tokens, budget)


def test_runs_are_not_joined_across_regions(spark):
    sel = spark.createDataFrame([(1, 1, 1, 0, 3, 5), (1, 1, 1, 0, 4, 5), (1, 1, 1, 0, 6, 5), (1, 2, 1, 1, 5, 5)], "query_id int, region_rank int, chunk_rank int, region_id int, subchunk_id int, tokens int")
    texts = spark.createDataFrame([(i, f"s{i}") for i in range(9)], "subchunk_id int, text string")
    got = {(r["first"], r["last"], r.passage) for r in selection.passages(sel, texts).collect()}
    assert got == {(3, 4, "s3 s4"), (6, 6, "s6"), (5, 5, "s5")}
    top = spark.createDataFrame([(1, 1), (1, 2)], "query_id int, chunk_rank int")
    assert [r.passages for r in selection.reassembled(top, selection.passages(sel, texts)).orderBy("chunk_rank").collect()] == [["s3 s4", "s5", "s6"], []]


def test_subchunk_selection_may_overshoot_once(spark):
    c = spark.createDataFrame([(1, 1, 1, 0.9, 5), (1, 2, 1, 0.9, 5), (1, 1, 2, 0.5, 5), (1, 1, 3, 0.4, 5)], "query_id int, chunk_rank int, subchunk_id int, score double, tokens int")
    assert [(r.subchunk_id, r.chunk_rank) for r in selection.select_subchunks(c, 6).orderBy("rank").collect()] == [(1, 1), (2, 1)]
    s = spark.createDataFrame([(1, 3), (2, 0), (3, 2)], "chunk_id int, size int")
    picked = spark.createDataFrame([(1, 2), (1, 9), (3, -1)], "chunk_id int, index int")
    assert sorted(map(tuple, selection.fallback_first(s, picked).collect())) == [(1, 2), (3, 0)]
    with pytest.raises(ValueError):
        selection.method("nothing")


def grown(n, c, budget, overhead):
    """The alternating growth, plainly."""
    l = r = c
    used = n[c] + overhead
    if used >= budget:
        return c, c, True
    left = True
    while l > 0 or r < len(n) - 1:
        go_left = (left and l > 0) or r == len(n) - 1
        j = l - 1 if go_left else r + 1
        if used + n[j] > budget:
            break
        used += n[j]
        l, r = (j, r) if go_left else (l, j)
        left = not go_left
    return l, r, False


def test_centred_windows_are_the_growth(spark):
    rng = random.Random(2)
    docs = [[rng.randrange(1, 12) for _ in range(rng.randrange(1, 25))] for _ in range(40)]
    rows = []
    for d, n in enumerate(docs):
        at = 0
        for i, x in enumerate(n):
            rows.append((d, i, at, at + x))
            at += x
    units = spark.createDataFrame(rows, "doc_id long, ordinal int, token_start long, token_end long")
    got = {(r.doc_id, r.center): (r["first"], r["last"], r.truncated) for r in regions.centred_windows(units, 30, 3).collect()}
    for d, n in enumerate(docs):
        for c in range(len(n)):
            assert got[d, c] == grown(n, c, 30, 3), (n, c)


def test_pruned_regions_have_no_parts(spark):
    rng = random.Random(3)
    w = [(1, c, max(0, c - rng.randrange(4)), c + rng.randrange(4), False) for c in range(30)]
    win = spark.createDataFrame(w, "doc_id long, center long, first long, last long, truncated boolean")
    ch = spark.createDataFrame([(1, 0, 0, 14), (1, 1, 14, 29)], "doc_id long, window long, first long, last long")
    got = {(r.window, r.start, r.end) for r in regions.pruned(win, ch).collect()}
    for k, a, b in ((0, 0, 14), (1, 14, 29)):
        all_ = {(max(l, a), min(r, b) + 1) for _, c, l, r, _ in w if a <= c <= b}
        assert {(s, e) for x, s, e in got if x == k} == {(s, e) for s, e in all_ if not any(x <= s and e <= y and (x, y) != (s, e) for x, y in all_)}
    with pytest.raises(ValueError):
        regions.validate_sizes(100, 180)


def test_sentences_and_merging(spark):
    t = "Dr. Who sat. J. K. Rowling spoke. It cost 3.5 dollars! See U.S. law\nNew line"
    units = spark.range(1).select(splitting.merged_sentences(splitting.sentences(F.lit(t)))).first()[0]
    assert units == ["Dr. Who sat.", "J. K. Rowling spoke.", "It cost 3.5 dollars!", "See U.S. law", "New line"]
    spans = spark.range(1).select(splitting.located(F.lit("a b. c d."), F.array(F.lit("a b."), F.lit("c d.")))).first()[0]
    assert [(s.start, s.end) for s in spans] == [(0, 4), (5, 9)]
    assert spark.range(1).select(splitting.url_units(F.lit("see https://x.org/a, now"))).first()[0] == ["see", "https://x.org/a,", "now"]
    docs = spark.createDataFrame([(1, "one two. three"), (2, None), (3, " \n ")], "doc_id long, text string")
    assert [(r.doc_id, r.ordinal, r.token_start, r.token_end) for r in splitting.subchunks(docs).orderBy("doc_id", "ordinal").collect()] == [(1, 0, 0, 3), (1, 1, 3, 4)]


def test_ranges(spark):
    m = spark.createDataFrame([("a", 3), ("a", 4), ("b", 4)], "chunk_id string, subchunk_id long")
    packed = chunking.packed_ranges(m)
    assert sorted(map(tuple, packed.collect())) == [("a", 3, 5), ("b", 4, 5)]
    assert sorted((r.chunk_id, r.subchunk_id) for r in chunking.unpacked_ranges(packed).collect()) == [("a", 3), ("a", 4), ("b", 4)]
    with pytest.raises(Exception, match="consecutive"):
        chunking.packed_ranges(spark.createDataFrame([("a", 3), ("a", 5)], "chunk_id string, subchunk_id long")).collect()
    rows = spark.createDataFrame([("a", 3, 6, [0, 1], [2, 3])], "chunk_id string, subchunk_start int, subchunk_end int, region_starts array<int>, region_ends array<int>")
    assert [(r.start, r.end) for r in chunking.unpacked_regions(rows).orderBy("region_id").collect()] == [(3, 5), (4, 6)]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, chunking.upserted(old, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_dense_ids_over_groups(spark):
    rows = [(d, i) for d in (5, 70_000, 70_001, 200_000) for i in range(d % 3 + 1)]
    got = chunking.dense_ids(spark.createDataFrame(rows, "doc_id long, ordinal int").repartition(3)).orderBy("subchunk_id").collect()
    assert [(r.doc_id, r.ordinal) for r in got] == rows and [r.subchunk_id for r in got] == list(range(len(rows)))


def test_top_k_in_blocks(spark):
    rng = random.Random(4)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    corpus = [(i, vec()) for i in range(300)]
    queries = [(q, vec()) for q in range(7)]
    c, q = spark.createDataFrame(corpus, "id long, vector array<float>").repartition(4), spark.createDataFrame(queries, "query_id long, vector array<float>")
    a = sorted(map(tuple, retrieval.top_k(q, c, 9).collect()))
    assert a == sorted(map(tuple, retrieval.top_k(q, c, 9, block=2).collect())) and len(a) == 63
    assert retrieval.top_k(q, c, 0).count() == 0
    with pytest.raises(ValueError):
        retrieval.top_k(q, c, -1)


def test_dataset_rules(spark):
    v = spark.createDataFrame([(1, 0, "a", 2), (1, 1, "b", 2), (2, 0, "none", 3), (3, 0, "x", 1), (3, 1, "y", 1), (3, 2, "z", 1)], "id int, position int, span string, votes int")
    assert [(r.id, r.span) for r in qa_datasets.consensus(v).collect()] == [(1, "a")]
    r = spark.createDataFrame([(1, "0:5,none,9:30|7:7", 10)], "id int, ranges string, length long")
    assert [(x.span, x.start, x.end) for x in qa_datasets.clipped_spans(r).collect()] == [("0:5", 0, 5), ("none", None, None), ("9:30", 9, 10)]
    raw = "line one\nline two\n\nCopyright 2007\n@highlight\nx"
    assert spark.range(1).select(qa_datasets.decoded_story(F.lit(raw), 1)).first()[0] == "line one\nline two\n"
    p = spark.createDataFrame([(1, "T", 0, "aa"), (1, "T", 1, "bbb")], "doc_id int, title string, position int, passage string")
    texts, spans = qa_datasets.serialized(p)
    t = texts.first().text
    assert t == "T\naa\n\nbbb" and [t[s.start : s.end] for s in spans.orderBy("position").collect()] == ["aa", "bbb"]


def by_places(n, c, budget, overhead):
    """The rule of centered_windows' SQL, plainly: (first, last) over the places that units within reach take, in order."""
    ts, size, used, l, r = [sum(n[:i]) for i in range(len(n))], len(n), 0, c, c
    m = min(c, size - 1 - c)
    place = lambda j: 0 if j == c else m + abs(j - c) if abs(j - c) > m else 2 * abs(j - c) - (j < c)
    for j in sorted((j for j in range(size) if abs(ts[j] - ts[c]) <= budget), key=place):
        used += n[j]
        if used + overhead > budget and j != c:
            break
        l, r = min(l, j), max(r, j)
    return l, r, n[c] + overhead >= budget


def test_windows_and_pruned_regions_of_lengths(spark, monkeypatch):
    """Many units a window, units over the budget and over a chunk, none at all: no shuffle, no row for each unit and neighbour."""
    from quern.operators import blocks

    rng = random.Random(5)
    docs = [[rng.choice([1, 2, 3, 9, 40]) if k % 3 else rng.randrange(1, 90) for _ in range(rng.randrange(60))] for k in range(50)] + [None]
    monkeypatch.setattr(blocks, "BLOCK_UNITS", 100)
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, lengths array<int>").repartition(3)
    windows, kept = regions.windows_of_lengths(rows, 30, 3), regions.pruned_of_lengths(rows, 30, 50, 3)
    got = sorted(map(tuple, windows.collect()))
    assert got == sorted((d, c, *by_places(n, c, 30, 3)) for d, n in enumerate(docs) for c in range(len(n or [])))
    for frame in (windows, kept):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Window " not in plan and "Generate" not in plan and "hashpartitioning" not in plan
    units = spark.createDataFrame([(d, i, sum(n[:i]), sum(n[: i + 1])) for d, n in enumerate(docs) for i in range(len(n or []))], "doc_id long, ordinal int, token_start long, token_end long")
    assert sorted(map(tuple, regions.centred_windows(units, 30).collect())) == got
    assert "Generate" not in regions.centred_windows(units, 30)._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, regions.pruned(windows, chunking.chunks(units, 50)).select("doc_id", "window", "start", "end", "center").collect()))
    with pytest.raises(Exception, match="without gaps"):
        regions.centred_windows(units.where("ordinal != 1"), 30).collect()


def test_top_k_memory_is_that_of_a_tile():
    """A full batch of rows against a full block of queries: no array of all scores."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(6)
    q, x = rng.normal(size=(4096, 8)), rng.normal(size=(10_000, 8))
    found = []

    class Corpus:
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v)))

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.FixedSizeListArray.from_arrays(x.ravel(), 8).cast(pa.list_(pa.float64()))], ["id", "vector"])
            tracemalloc.start()
            found.extend(pa.Table.from_batches(list(run(iter([batch])))).to_pylist())
            found.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            raise StopIteration

    rows = SimpleNamespace(select=lambda *_: SimpleNamespace(toLocalIterator=lambda: ((i, v) for i, v in enumerate(q))))
    with pytest.raises(StopIteration):
        retrieval.top_k(rows, Corpus(), 5, "ip")
    assert found.pop() < 100e6
    best = {}
    for r in found:
        best.setdefault(r["query_id"], []).append(r["id"])
    assert len(best) == 4096 and all(set(best[i]) == set(np.argsort(-(x @ q[i]))[:5]) for i in range(0, 4096, 97))


def test_top_k_of_groups_over_tiles_and_tasks(spark, monkeypatch):
    """Against all scores: equal vectors, groups over several tasks, an all-zero vector, each metric."""
    import numpy as np

    monkeypatch.setattr(retrieval, "ROW_TILE", 7)
    monkeypatch.setattr(retrieval, "QUERY_TILE", 2)
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(240, 4)), 1)
    x[60:120], x[5] = x[:60], 0
    q = np.vstack([x[[5, 8, 30]], rng.normal(size=(2, 4))])
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    s = q @ x.T
    norms = np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1), 1e-7)
    full = {"cosine": s / norms, "ip": s, "l2": -((q[:, None] - x[None]) ** 2).sum(2)}
    for metric, per in (("cosine", 1), ("ip", 6), ("l2", 1), ("cosine", 6)):
        scores = np.round(full[metric], 4).reshape(len(q), -1, per).max(2)
        wanted = {(i, int(j)) for i in range(len(q)) for j in sorted(range(scores.shape[1]), key=lambda j: (-scores[i, j], j))[:9]}  # noqa: B023
        got = retrieval.top_k(queries, corpus, 9, metric, 4, per=per).collect()
        assert {(r.query_id, r.id) for r in got} == wanted and len(got) == 45, (metric, per)
    with pytest.raises(Exception, match="finite"):
        retrieval.top_k(queries, corpus.unionAll(spark.createDataFrame([(999, [float("nan")] * 4)], corpus.schema)), 3).collect()


def test_chunk_ranges_come_from_a_documents_own_row(spark):
    """The same ranges as from members with dense ids, over groups of ids; no unit is shuffled."""
    rng = random.Random(8)
    ids = [*range(12), 65_535, 65_536, 70_000, 400_000, -3]
    texts = ["\n".join(" ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([1, 3, 8, 40]))) for _ in range(rng.randrange(30))) for _ in ids[2:]]
    docs = spark.createDataFrame(list(zip(ids, [None, " \n ", *texts])), "doc_id long, text string").repartition(3)
    got = chunking.chunk_ranges_of_lengths(splitting.unit_lengths(docs), splitting.unit_counts(docs), 16)
    units = splitting.subchunks(docs)
    members = chunking.window_members(units, 16).join(chunking.dense_ids(units).select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "subchunk_id"), ["doc_id", "ordinal"])
    wanted = chunking.packed_ranges(members.select(F.struct("doc_id", "window").alias("chunk_id"), "subchunk_id"))
    assert sorted(map(tuple, got.collect())) == sorted((*r.chunk_id, r.start, r.end) for r in wanted.collect()) and got.count() > 100


def test_range_pack_shuffles_chunks_alone(spark, tmp_path):
    from quern.plans import queries

    spark.createDataFrame([(1, "a b. c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.range_pack(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2 and "hashpartitioning(doc_id" not in plan and "Generate" not in plan
