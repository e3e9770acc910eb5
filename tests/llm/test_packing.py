import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from quern.llm import packing as P
from quern.llm.tokenizing import Tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def odd_texts(rng, n=1500):
    bits = ["a", "bc", " ", "  ", "\n", "\t", " \n", "1", "23", "!", "...", "é", "日本", " x", " ", "²", "'s", "it's", " '", "<|endoftext|>"]
    texts = ["".join(rng.choices(bits[: 16 + 4 * (k % 3 == 0)], k=rng.randrange(40))) for k in range(n)]
    return texts + ["", None, " ", "  ", "\n\n", "a ", "a  ", "word " * 6000]


def test_ids_are_those_of_the_tokenizer():
    texts = odd_texts(random.Random(3))
    for part in (texts, texts[-8:], [None]):
        ids, first = Tokens(PATH).of_texts(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == reference(part)


def test_genetic_steps_keep_every_piece():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 100, 300)
    a = P.best_fit(size, np.zeros(300, np.int64), np.arange(300), 100)
    b = P.best_fit(size, np.zeros(300, np.int64), rng.permutation(300), 100)
    for s in (a, b, P.crossover(size, a, b, 100, rng), P.mutated(size, a, 100, rng), P.evolve(size, [a, b], 100, 1)):
        assert len(s) == 300 and np.bincount(s, size).max() <= 100 and np.bincount(s, size).min() > 0
    assert P.fitness(size, P.evolve(size, [b], 100, 1), 100) >= P.fitness(size, b, 100)


def test_packing(spark):
    rng = random.Random(7)
    texts = odd_texts(rng, 200) + ["lorem ipsum " * rng.randrange(400) for _ in range(150)]
    docs = spark.createDataFrame([(i % 300, t, i) for i, t in enumerate(texts)], "doc_id long, text string, piece int").repartition(4)
    for region in (P.REGION, 40):
        rows = P.pack(docs, PATH, region=region).collect()
        ids = [x + [0] for x in reference(texts)]
        want = sorted((i % 300, k, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, x in enumerate(ids) for k, s, p in pieces(x))
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for placed in by.values():
            at = 0
            for offset, length in sorted(placed):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(r.length for r in rows)
        assert len(by) <= -(-total // 2048) * (1 if region == P.REGION else 1.05) + 2  # regions of 40 leave little to choose from
    assert P.pack(docs.limit(0), PATH).count() == 0


def pieces(x):
    n = -(-len(x) // 2048)
    head = len(x) - (n - 1) * 2048
    cuts = [0, *(head + k * 2048 for k in range(n))]
    return [(k, a, x[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
