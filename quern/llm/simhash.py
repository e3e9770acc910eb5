"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bit is 1 if more than half of the document's shingle hashes have it.  The
tables of the index are masks: bit i has a vector of RADIUS + 1 bits, mask v drops the bits
whose vector is orthogonal to v.  RADIUS differing bits have RADIUS vectors, and some
non-zero v is orthogonal to them all, so every pair within the radius meets in a table.

Copies share a fingerprint, so the index holds each fingerprint once.  A bucket streams
through a task sorted; one of more than BUCKET fingerprints is not compared there but dealt
again by a second family of masks on top of the first (and so on), which keeps the
guarantee.  A mask drops half of the bits that are still in play, so from the third deal on a
bucket has room for 2 ** 8 fingerprints at most and none is dealt again.  Only a spanning
forest of a bucket's links leaves it.

Defined results: a null or empty text, or one without words, has fingerprint 0, linked like
any other.  A null doc_id belongs to the component of its text; a component of null ids
alone has a null component_id.  Repeated rows and copies share a fingerprint and a component; a
very long text has one like any other; an empty table gives an empty one.  score() reads doc_id
and text alone; keep() passes other columns on, whatever their names, and keeps one row of
repeated ones; texts without words are copies of each other there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import common as C
from quern.llm.components import components

BITS, RADIUS, WIDTH, SEED = 64, 3, 3, 42
#: A bucket of more fingerprints is dealt again.
BUCKET = 4_096


def masks(level: int, radius: int = RADIUS) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks of a level. The vectors are dealt evenly, in an order of the level's own."""
    size = 1 << (radius + 1)
    if size - 1 > BITS:  # not all vectors are in use: those of one half, so that no mask keeps few bits
        vectors = np.resize(np.arange(size // 2, size), BITS) if size == 2 * BITS else np.random.default_rng(size).choice(np.arange(1, size), BITS, replace=False)
    else:
        vectors = np.resize(np.arange(1, size), BITS)
    vectors = np.random.default_rng(1000 + level).permutation(vectors)
    return [sum(1 << i for i, x in enumerate(vectors) if bin(int(x) & v).count("1") % 2) for v in range(1, size)]


def fingerprints_of(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """64-bit fingerprints of the texts."""
    flat = C.Flat(texts)
    data = C.LOWER[flat.data]
    mask = C.WORD_BYTE[flat.data]
    starts, ends, first = flat.spans(mask)
    n = np.diff(first)
    # words with one space behind each
    body = np.full(int((ends - starts + 1).sum()) if len(starts) else 0, 32, np.uint8)
    a = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    place = np.ones(len(body), bool)
    place[a[1:] - 1] = False
    body[place] = data[mask]
    raw = body.tobytes()
    doc = C.doc_of(first)
    at = np.arange(len(starts))
    last = np.minimum(at + width, first[1:][doc] if len(doc) else 0)
    shingle = (last - at == width) | (at == first[:-1][doc]) if len(doc) else np.zeros(0, bool)
    at, last, doc = at[shingle], last[shingle], doc[shingle]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(raw[x:y], SEED) for x, y in zip(a[at].tolist(), (a[last] - 1).tolist(), strict=True)], np.uint64)
    out = np.zeros(flat.n, np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        begin = np.searchsorted(doc, some)
        count = np.diff(np.append(begin, len(doc)))
        for b in range(BITS):
            on = np.add.reduceat(((h >> np.uint64(b)) & np.uint64(1)).astype(np.int32), begin)
            out[some] |= (2 * on > count).astype(np.uint64) << np.uint64(b)
    return out


def fingerprints(documents: DataFrame, widths: dict[str, int]) -> DataFrame:
    """documents (doc_id, ..., text) with the text replaced by a fingerprint, as a signed number, for each name and width."""
    kept = [c for c in documents.columns if c != "text"]
    schema = ", ".join([*(f"{c} {documents.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} bigint" for c in widths)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.in_blocks(batches):
            made = [pa.array(fingerprints_of(block.column("text"), w).view(np.int64)) for w in widths.values()]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in kept), *made], [*kept, *widths])

    return documents.mapInArrow(run, schema)


def forest(columns: list[np.ndarray], radii: list[int], steps: tuple[int, ...] = (1 << 30,), tile: int = 512, at_once: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of rows that lie within every column's radius of each other; of sums of distances under a smaller step, links come first.

    Pairs are few as a rule and found in one pass; beyond `at_once` of them there is a pass for each step, and none is kept.
    """
    columns = [c.view(np.uint64) for c in columns]
    n = len(columns[0])
    parent = np.arange(n)
    a: list[int] = []
    b: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def pairs():
        for x in range(0, n, tile):
            first = np.bitwise_count(columns[0][x : x + tile, None] ^ columns[0][None, x:])
            i, j = np.nonzero(first <= radii[0])
            total = first[i, j].astype(np.int64)
            i, j = i + x, j + x
            ok = i < j
            for c, r in zip(columns[1:], radii[1:], strict=True):
                d = np.bitwise_count(c[i] ^ c[j])
                ok &= d <= r
                total += d
            yield i[ok], j[ok], total[ok]

    def linked(i: np.ndarray, j: np.ndarray) -> None:
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            rp, rq = root(p), root(q)
            if rp != rq:
                parent[max(rp, rq)] = min(rp, rq)
                a.append(p)
                b.append(q)
                if len(a) == n - 1:
                    return

    held, size = [], 0
    for part in pairs():
        held.append(part)
        size += len(part[0])
        if size > at_once:
            break
    if size <= at_once:
        i, j, total = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
        order = np.argsort(np.searchsorted(np.array(steps), total), kind="stable")
        linked(i[order], j[order])
    else:
        del held
        for step in steps:
            for i, j, total in pairs():
                linked(i[total <= step], j[total <= step])
    return np.array(a, np.int64), np.array(b, np.int64)


def _in_buckets(names: list[str], radii: list[int], most: int, steps: tuple[int, ...]):
    """Reads (t, k, id, *names) sorted by t, k; gives links (a, b), or (a = id, t, names) with b null for what is dealt again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = ["a", "b", "t", *names]

        def linked(a, b):
            none = [pa.nulls(len(a), pa.int64()), *(pa.nulls(len(a), pa.int64()) for _ in names)]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *none], labels)

        key, held, over = None, [], False

        def closed():
            rows = np.unique(np.concatenate(held, 1), axis=1) if held else np.zeros((1, 0), np.int64)
            if rows.shape[1] > 1:
                a, b = forest(list(rows[1:]), radii, steps)
                if len(a):
                    yield linked(rows[0][a], rows[0][b])

        for batch in batches:
            t, k = np.asarray(batch.column("t")), np.asarray(batch.column("k"))
            rows = np.stack([np.asarray(batch.column(c)) for c in ("id", *names)])
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            begin, end = np.concatenate([[0], cut]), np.append(cut, len(t))
            # pairs, the bulk, without a loop
            inner = (begin > 0) & (end < len(t))
            i = begin[inner & (end - begin == 2)]
            near = np.ones(len(i), bool)
            for c, r in zip(rows[1:], radii, strict=True):
                near &= np.bitwise_count((c[i] ^ c[i + 1]).view(np.uint64)) <= r
            if near.any():
                yield linked(rows[0][i][near], rows[0][i + 1][near])
            rest = ~inner | (end - begin > 2)
            for s, e in zip(begin[rest].tolist(), end[rest].tolist(), strict=True):
                if (t[s], k[s]) != key:
                    yield from closed()
                    key, held, over = (t[s], k[s]), [], False
                held.append(rows[:, s:e])
                if over or sum(h.shape[1] for h in held) > most:
                    over = True
                    part = np.concatenate(held, 1)
                    size = part.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.nulls(size, pa.int64()), pa.array(np.full(size, t[s]), pa.int64()), *(pa.array(c) for c in part[1:])], labels)
                    held = []
        yield from closed()

    return run


def _dealt(names: list[str], level: int, radius: int):
    """A row for each mask of the level; t numbers the masks so far in base 2 ** (radius + 1) - 1."""
    tables = [masks(x, radius) for x in range(level + 1)]
    n = len(tables[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = np.asarray(batch.column("t")).astype(np.int64)
            f = np.asarray(batch.column(names[0])).view(np.uint64)
            kept, digits = np.zeros(len(t), np.uint64), t.copy()
            for x in range(level - 1, -1, -1):
                kept |= np.array(tables[x], np.uint64)[digits % n]
                digits //= n
            for v, m in enumerate(tables[level]):
                k = (f & (kept | np.uint64(m))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t * n + v), pa.array(k), batch.column("id"), *(batch.column(c) for c in names)], ["t", "k", "id", *names])

    return run


def links(distinct: DataFrame, names: list[str], radii: list[int], most: int = BUCKET, steps: tuple[int, ...] = (1 << 30,)) -> DataFrame:
    """Links (a, b) of ids, enough to connect all rows (id, *names) that lie within every radius; the first column is the one indexed, steps as for forest()."""
    kinds = ", ".join(f"{c} bigint" for c in names)
    todo, found, level = distinct.select("id", F.lit(0).cast("bigint").alias("t"), *names), None, 0
    while True:
        rows = todo.mapInArrow(_dealt(names, level, radii[0]), f"t bigint, k bigint, id bigint, {kinds}")
        step = C.stored(rows.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(_in_buckets(names, radii, most, steps), f"a bigint, b bigint, t bigint, {kinds}"))
        now = step.where("b is not null").select("a", "b")
        found = now if found is None else found.unionAll(now)
        again = step.where("b is null")
        if again.isEmpty():
            return found
        todo, level = again.select(F.col("a").alias("id"), "t", *names), level + 1


def joined(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """distinct (id, ...) with root, the least id that each reaches by the links found."""
    roots = components(found)
    return distinct.join(roots, distinct["id"] == roots["node"], "left").select(distinct["*"], F.coalesce("root", "id").alias("root"))


def classes(distinct: DataFrame, names: list[str], radii: list[int]) -> DataFrame:
    """distinct (id, *names) with root, the least id that each reaches."""
    return joined(distinct, links(distinct, names, radii))


def score(documents: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    prints = C.stored(fingerprints(documents.select("doc_id", "text"), {"f": width}))
    distinct = C.stored(prints.groupBy("f").agg(F.min("doc_id").alias("first")))
    rows = classes(distinct.select(F.col("f").alias("id"), "f", "first"), ["f"], [radius])
    least = rows.groupBy("root").agg(F.min("first").alias("component_id"))
    of = C.stored(rows.join(least, "root").select("f", "component_id"))
    return prints.join(of, "f").select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


#: keep(): shingles of five words, similar at 0.8 or more.
SIMILARITY = 0.8
#: Candidates beyond the fingerprints' radius share a band, the least hashes of a shingle set under BAND functions. A pair of similarity 0.8 shares none of BANDS with a probability of (1 - 0.8 ** 6) ** 56 = 4e-8, wherever its texts differ.
BANDS, BAND = 56, 6
#: Shingles that a task compares at once.
TILE = 1_000_000


def shingle_sets(texts: pa.Array, width: int = 5) -> pa.Array:
    """The distinct shingle hashes of every text, as lists; a text of fewer words is one shingle."""
    flat = C.Flat(texts)
    mask = C.WORD_BYTE[flat.data]
    starts, ends, first = flat.spans(mask)
    ids, distinct = C.encoded(C.sliced(C.LOWER[flat.data], starts, ends, mask))
    word = np.array([xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()], np.uint64)[ids] if len(ids) else np.zeros(0, np.uint64)
    doc, at = C.doc_of(first), np.arange(len(ids))
    last = np.minimum(at + width, first[1:][doc]) if len(doc) else at
    whole = np.flatnonzero((last - at == width) | (at == first[:-1][doc])) if len(doc) else at
    h = np.full(len(whole), 7, np.uint64)
    for j in range(width):
        inside = whole + j < last[whole]
        h = np.where(inside, C.mixed(h * np.uint64(0xD6E8FEB86659FD93) + word[np.minimum(whole + j, max(len(word) - 1, 0))]), h)
    order = np.lexsort((h, doc[whole]))
    d, h = doc[whole][order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(d[new], np.arange(flat.n + 1)).astype(np.int32)), pa.array(h[new].view(np.int64)))


def bands_of(sets: pa.Array, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of every shingle set, and its bands (sets, BANDS); the band's number is part of it."""
    n = np.asarray(sets.value_lengths()).astype(np.int64)
    v = np.asarray(sets.flatten()).view(np.uint64)
    some = np.flatnonzero(n)
    out = np.zeros((len(n), BANDS), np.uint64)
    name = np.zeros(len(n), np.uint64)
    if len(some):
        begin = (np.cumsum(n) - n)[some]
        name[some] = C.mixed(np.add.reduceat(C.mixed(v * np.uint64(0xD6E8FEB86659FD93)), begin) + n[some].astype(np.uint64))
        low, h = v.astype(np.uint32), np.empty(len(v), np.uint32)
        rng = np.random.default_rng(seed)
        for band in range(BANDS):
            k = np.full(len(some), band + 1, np.uint64)
            for add, by in rng.integers(0, 1 << 32, (BAND, 2), dtype=np.uint32):
                np.bitwise_xor(low, add, out=h)
                np.multiply(h, by | np.uint32(1), out=h)
                k = C.mixed(k * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(h, begin))
            out[some, band] = k
    return name.view(np.int64), out.view(np.int64)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in C.in_blocks(batches):
        f = pa.array(fingerprints_of(block.column("text")).view(np.int64))
        sets = shingle_sets(block.column("text"))
        name, bands = bands_of(sets)
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(name) + 1) * BANDS).astype(np.int32)), pa.array(bands.ravel()))
        yield pa.RecordBatch.from_arrays([block.column("__i"), block.column("__x"), pa.array(name), sets.value_lengths().cast(pa.int64()), f, lists], ["__i", "__x", "id", "n", "f", "bands"])


def print_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), enough to connect all ids of rows (id, f) whose fingerprints lie within the radius; the index holds each fingerprint once, as score()'s does."""
    of = C.stored(prints.select("id", "f").distinct())
    hubs = C.stored(of.groupBy("f").agg(F.min("id").alias("hub")))
    same = of.join(hubs, "f").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    return same.unionAll(links(hubs.select(F.col("hub").alias("id"), "f"), ["f"], [radius])).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def band_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b), enough to connect all ids of rows (id, bands) that share a band."""
    rows = distinct.select(F.explode("bands").alias("k"), "id").repartition("k").sortWithinPartitions("k")
    return rows.mapInArrow(_starred, "a bigint, b bigint")


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (k, id) sorted by k; links every id of a bucket to the bucket's first."""
    key = hub = None
    for batch in batches:
        k, ids = np.asarray(batch.column("k")), np.asarray(batch.column("id"))
        if not len(k):
            continue
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        new[0] = key is None or k[0] != key
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        first = np.where(at < 0, hub if hub is not None else 0, ids[at])
        key, hub = k[-1], first[-1]
        apart = first != ids
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(first, ids)[apart]), pa.array(np.maximum(first, ids)[apart])], ["a", "b"])


def similar(v: np.ndarray, n: np.ndarray, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of all pairs of sets with that Jaccard similarity; set i has the next n[i] of v. Exact: a set is held against every set that shares a member and is not linked yet."""
    m = len(n)
    doc = np.repeat(np.arange(m), n)
    _, member, times = np.unique(v, return_inverse=True, return_counts=True)
    shared = times[member] > 1
    free = (n > 0) & (np.bincount(doc[shared], minlength=m) >= least * n - 1e-6)
    use = shared & free[doc]
    doc = doc[use]
    _, member = np.unique(member[use], return_inverse=True)
    first = np.searchsorted(doc, np.arange(m + 1))
    by = np.argsort(member, kind="stable")
    holder, sorted_member = doc[by], member[by]
    start = np.searchsorted(sorted_member, np.arange(len(by) + 1))
    live, a, b = int(free.sum()), [], []
    for seed in np.flatnonzero(free).tolist():
        todo = [seed] if free[seed] else []
        free[seed] = False
        while todo:
            x = todo.pop()
            mine = member[first[x] : first[x + 1]]
            both = np.bincount(holder[C.take_spans(start[mine], start[mine + 1])], minlength=m)
            hit = np.flatnonzero(free & (both >= least * (n[x] + n - both)))
            if len(hit):
                free[hit] = False
                a += [x] * len(hit)
                b += hit.tolist()
                todo += hit.tolist()
                if (left := int(free.sum())) * 2 < live:  # those that are linked need not be met again
                    live, still = left, free[holder]
                    holder, sorted_member = holder[still], sorted_member[still]
                    start = np.searchsorted(sorted_member, np.arange(len(by) + 1))
    return np.array(a, np.int64), np.array(b, np.int64)


def _tiles(least: float):
    """Reads (root, tile, id, s) sorted by root, tile; gives the links (a, b) of each tile."""

    def closed(held):
        ids = np.concatenate([h[0] for h in held])
        n = np.concatenate([h[1] for h in held])
        a, b = similar(np.concatenate([h[2] for h in held]), n, least)
        return pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            root, tile, ids, sets = (batch.column(c) for c in ("root", "tile", "id", "s"))
            root, tile, ids = np.asarray(root), np.asarray(tile), np.asarray(ids)
            n = np.asarray(sets.value_lengths()).astype(np.int64)
            v, off = np.asarray(sets.flatten()), np.concatenate([[0], np.cumsum(n)])
            cut = np.flatnonzero((root[1:] != root[:-1]) | (tile[1:] != tile[:-1])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(root)], strict=True):
                if key != (root[s], tile[s]):
                    if held:
                        yield closed(held)
                    key, held = (root[s], tile[s]), []
                held.append((ids[s:e], n[s:e], v[off[s] : off[e]]))
        if held:
            yield closed(held)

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in C.in_blocks(batches):
        yield pa.RecordBatch.from_arrays([block.column("id"), shingle_sets(block.column("text"))], ["id", "s"])


def verified(found: DataFrame, sizes: DataFrame, texts: DataFrame, least: float = SIMILARITY, most: int = TILE) -> DataFrame:
    """Links (a, b), enough to connect all similar texts (id, text) that the links found connect. sizes (id, n): shingles of each.

    A component of more than `most` shingles is cut into blocks of half of that; every two blocks meet in a tile.
    """
    roots = components(found)
    roots = C.stored(roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct()))
    total = roots.join(sizes, roots["node"] == sizes["id"]).groupBy("root").agg(F.ceil(2 * F.sum("n") / F.lit(most)).cast("bigint").alias("k"))
    of = roots.join(total.withColumn("k", F.when(F.col("k") > 2, F.col("k")).otherwise(1)), "root").withColumn("block", F.pmod(F.xxhash64("node"), "k"))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1), lambda x: x != F.col("block"))
    tiles = F.when(F.col("k") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(others, lambda x: F.least(x, "block") * F.col("k") + F.greatest(x, "block")))
    placed = of.select("root", F.explode(tiles).alias("tile"), F.col("node").alias("id"))
    sets = texts.mapInArrow(_shingled, "id bigint, s array<bigint>")
    rows = placed.join(sets, "id").select("root", "tile", "id", "s").repartition("root", "tile").sortWithinPartitions("root", "tile")
    return rows.mapInArrow(_tiles(least), "a bigint, b bigint")


def keep(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document (that of the least id) of every group of near-duplicates, with all its columns.

    Candidates are the fingerprints within RADIUS that score() links, and, for similar texts whose fingerprints lie further
    apart, what shares a band of least hashes; all of a component are held against each other by their shingle sets.
    """
    key = [F.coalesce("doc_id", F.lit(-(2**63))).alias("__i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__x")]
    texts = documents.select(*key, F.col("text"))
    prints = C.stored(texts.mapInArrow(_described, "__i bigint, __x bigint, id bigint, n bigint, f bigint, bands array<bigint>"))
    distinct = C.stored(prints.groupBy("id").agg(F.min(F.struct("__i", "__x")).alias("best"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")))
    found = C.stored(print_links(prints.where("n > 0")).unionAll(band_links(distinct.where("n > 0"))).distinct())
    ends = found.select(F.col("a").alias("id")).unionAll(found.select(F.col("b").alias("id"))).distinct()
    of = distinct.join(ends, "id", "left_semi").select("id", "best.__i", "best.__x").distinct()
    first = texts.join(of, ["__i", "__x"]).dropDuplicates(["id"]).select("id", "text")
    rows = joined(distinct.select("id", "best"), verified(found, distinct.select("id", "n"), first, least))
    best = C.stored(rows.groupBy("root").agg(F.min("best").alias("best")).select("best.__i", "best.__x"))
    held = documents.select(F.struct("*").alias("row"), *key)  # whatever its columns are called
    once = F.row_number().over(Window.partitionBy("__i", "__x").orderBy("__x"))  # repeated rows of one document
    return held.join(best, ["__i", "__x"]).withColumn("n", once).where("n = 1").select("row.*")
