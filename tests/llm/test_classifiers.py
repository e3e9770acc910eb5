import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import language_id, quality_classifier, toxicity
from quern.llm import linear_svm as S

EN, DE = ["the", "and", "house", "river", "green", "stone", "walk", "light"], ["der", "und", "haus", "fluss", "grün", "stein", "gehen", "licht"]
BAD = ["moron", "wretch"]


def sentence(rng, words, n=30):
    return " ".join(rng.choice(words) + rng.choice(["", "", "er", "ing", "st"]) for _ in range(n)) + "."


def test_svm_separates_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    w = S.fit_dense(x, y, 10.0)
    assert (np.sign(x @ w) == y).mean() > 0.97
    a, b = S.calibrate(x @ w, (y > 0).astype(int))
    assert a > 0 and ((S.probability(x @ w, (a, b)) > 0.5) == (y > 0)).mean() > 0.95


def labelled(spark, rng, n=260):
    rows, labels = [], []
    for i in range(n):
        words = EN if i % 2 else DE
        text, toxic, quality = sentence(rng, words), int(i % 5 == 0), int(i % 3 > 0)
        if toxic:
            at = rng.randrange(len(text) // 2)
            text = text[:at] + " " + rng.choice(BAD) + " " + text[at:]
        if not quality:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, "en" if i % 2 else "de", "s"))
        labels.append((i, quality, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, y string").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


ODD = [(1000, None, None, "s"), (1001, "", "en", "s"), (1002, "12 34 !!", "en", "s"), (1003, "x" * 50_000, "en", "s"), (1003, "x" * 50_000, "en", "s"), (None, "the house", None, None)]


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    docs, labels = labelled(spark, rng)
    held = F.coalesce(F.col("doc_id"), F.lit(0)) % 4 == 1
    odd = spark.createDataFrame(ODD, docs.schema)
    both = docs.unionAll(odd)
    for module, label in ((quality_classifier, "quality"), (toxicity, "toxic")):
        model = module.fit(both, labels, keep=~held)
        got = module.score(both, model, held)
        assert got.count() == docs.count() + len(ODD)
        truth = got.join(labels, "doc_id").where("held_out")
        assert truth.where(F.col("predicted") == F.col(label)).count() / truth.count() > 0.9
        assert got.where("score is null or score < 0 or score > 1 or (score >= 0.5) != (predicted = 1)").count() == 0
        for few in (labels.limit(0), labels.where(f"{label} = 1")):
            assert module.score(docs.limit(0), module.fit(docs, few), held).count() == 0
            one = {r.predicted for r in module.score(docs, module.fit(docs, few), held).collect()}
            assert len(one) == 1
    model = language_id.fit(both, keep=~held)
    got = {r.doc_id: r for r in language_id.predict(both, model, held).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(260))
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[None].lang_pred == "en"
    none = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, none, held).collect()} == {"und"}


def test_toxicity_tolerates_gaps_and_insertions(spark):
    rng = random.Random(2)
    docs, labels = labelled(spark, rng, 400)
    model = toxicity.fit(docs, labels)
    clean = [sentence(rng, EN), sentence(rng, DE)]
    texts = [f"the {w} and stone" for w in ("moron", "MORON!", "m.o.r.o.n", "m o r o n", "m0r0n", "morxon", "wretch", "wreetch")] + clean
    p = S.probability(model.margin(pa.array(texts)), model.sigmoid)
    assert (p[:-2] >= 0.5).all(), p
    assert (p[-2:] < 0.5).all()


def plain_margin(model, text):
    """The worst reading of a text, one reading and one subsequence at a time."""
    import itertools
    import re

    def letters(raw):
        return bytes(int(toxicity._CLASS[b]) for b in raw if toxicity._CLASS[b])

    def value(word):
        if len(word) < 3:
            return -1.0
        s = bytes([toxicity.START]) + word + bytes([toxicity.END])
        w = toxicity.WINDOW
        starts = sorted({*range(0, max(len(s) - w, 0), toxicity.STEP), max(len(s) - w, 0)})
        best = -1.0
        for part in (s[i : i + w] for i in starts):
            phi = {}
            for at in itertools.combinations(range(len(part)), 4):
                key = 0
                for i in at:
                    key = key * toxicity.LETTERS + part[i]
                phi[key] = phi.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
            up = sum(model.weight[k] * v for k, v in phi.items())
            if up > 0:
                best = max(best, up / sum(v * v for v in phi.values()) ** 0.5 + model.bias)
        return best

    raw = (text or "").encode()
    found = [letters(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    pieces = [x for p in re.split(rb"[^A-Za-z013457@$\x80-\xFF]+", raw.replace(b" ", b"\n")) if (x := letters(p))]
    found += pieces
    for i, m in itertools.product(range(len(pieces)), range(2, toxicity.JOINED + 1)):
        run = pieces[i : i + m]
        if len(run) == m and all(len(x) <= toxicity.SHORT for x in run) and 4 <= len(b"".join(run)) <= toxicity.JOINED:
            found.append(b"".join(run))
    return np.tanh(max([-1.0, *(value(w) for w in found)]) / 2)


def test_toxicity_against_a_plain_version(spark):
    """Gaps by blanks and signs, glued words, ties, copies, nulls, long texts: every document's score is its worst reading's."""
    rng = random.Random(5)
    docs, labels = labelled(spark, rng, 300)
    model = toxicity.fit(docs.withColumn("value", F.lit(1)).withColumn("sentence", F.lit("x")), labels)
    gapped = ["mo ron", "m o r o n", "wr et ch", "wret ch", "house,moron/river", "the-w.r.e.t.c.h-walk", "mo\nron", "W R E T C H"]
    clean = ["the and house", "to be or no", "a b c d", "der und fluss"]
    odd = [None, "", " \t", "é", "ü b e r", "xy", "12 34 !!", "mo" * 40, "moronmoron" * 3, "ab " * 50, "moron moron moron"]
    texts = gapped + clean + odd
    got = model.margin(pa.array(texts))
    assert np.allclose(got, [plain_margin(model, t) for t in texts], atol=1e-4)
    p = S.probability(got, model.sigmoid)
    assert (p[: len(gapped)] >= 0.5).all(), p
    assert (p[len(gapped) : len(gapped) + len(clean)] < 0.5).all(), p
    long = "stone walk " * 20_000
    assert np.allclose(model.margin(pa.array([long, long + "mo ron"])), [plain_margin(model, "stone walk stone"), plain_margin(model, "walk mo ron")], atol=1e-4)
    worst, piece = model.worst(pa.array(texts))
    assert np.allclose(np.tanh(worst / 2), got) and all((x is None) == (v == -1) for x, v in zip(piece, worst, strict=True))


def test_first_words_are_beyond_chance():
    assert toxicity.chance(50_000, 120, 1000) == 5 and toxicity.chance(10, 5, 5) == 3 and toxicity.chance(0, 0, 0) == 3
    of = {b"a": {1, 2, 3, 4}, b"b": {1, 2, 3, 4}, b"c": {7, 8}, b"d": {1, 2, 3, 5}}
    assert toxicity.witnesses(of, {b"a": 0, b"b": 0, b"c": 0, b"d": 1}, 3) == [(b"b", 4), (b"a", 4)]


def test_kernel_matches_its_definition():
    import itertools

    def phi(word):
        s = [toxicity.START, *word, toxicity.END]
        out = {}
        for at in itertools.combinations(range(len(s)), 4):
            key = tuple(s[i] for i in at)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    words = [bytes([1, 2, 3]), bytes([1, 2, 1, 2, 1]), bytes([5, 6, 7, 8, 9, 9])]
    k = toxicity.Landmarks(pa.array(words, pa.binary())).kernel(pa.array(words, pa.binary()))
    for i, a in enumerate(map(phi, words)):
        for j, b in enumerate(map(phi, words)):
            want = sum(v * b.get(c, 0) for c, v in a.items()) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
            assert abs(k[i, j] - want) < 1e-5


def plain_language(counts, documents, text):
    """The model said plainly, a word and a language at a time."""
    languages = sorted(documents)
    words, pieces = {}, {}
    for lang, word, n in counts:
        words.setdefault(word, {}).setdefault(lang, 0)
        words[word][lang] += n
    for word, of in words.items():
        for k in range(1, language_id.LONGEST + 1):
            for g in language_id.grams(word, k):
                for lang, n in of.items():
                    pieces.setdefault(k, {}).setdefault(g, {}).setdefault(lang, 0)
                    pieces[k][g][lang] += n

    def table(of, smoothing):
        total = {x: sum(c.get(x, 0) for c in of.values()) + smoothing * len(of) for x in languages}
        p = {key: {x: np.log((c.get(x, 0) + smoothing) / total[x]) for x in languages} for key, c in of.items()}
        return {key: {x: v - max(c.values()) for x, v in c.items()} for key, c in p.items()}

    known, by_length = table(words, 0.2), {k: table(of, 0.5) for k, of in pieces.items()}
    score = {x: np.log(documents[x] / sum(documents.values())) for x in languages}
    letters = False
    for raw in (text or "").encode().split():
        w = language_id.normalised(raw)
        letters |= bool(w)
        if w in known:
            for x in languages:
                score[x] += known[w][x]
        elif w:
            for k in range(min(language_id.LONGEST, len(w) + 2), 0, -1):
                found = [g for g in language_id.grams(w, k) if g in by_length.get(k, {})]
                if found:
                    for x in languages:
                        score[x] += sum(by_length[k][g][x] for g in found) / len(found)
                    break
    if not letters:
        return language_id.UND
    return max(languages, key=lambda x: (score[x], -languages.index(x)))


def test_language_against_a_plain_version(spark):
    """Rare languages beside a frequent one: every word kept has its count in all languages."""
    rng = random.Random(21)
    lists = {"aa": EN, "bb": DE, "cc": ["the", "haus", "piedra", "luz", "verde", "rio", "y", "el"]}
    rows = [(i, sentence(rng, lists[x], 12), x) for i, x in enumerate(["aa"] * 90 + ["bb"] * 8 + ["cc"] * 4)]
    texts = [sentence(rng, words, 6) for words in lists.values() for _ in range(15)] + ["rio verde", "qqq", "", None, "12 34", "the haus", "haus the " * 3000]
    rows += [(1000 + i, t, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(docs)
    counts = []
    for _, text, lang in rows:
        if lang:
            counts += [(lang, w, 1) for raw in text.encode().split() if (w := language_id.normalised(raw))]
    documents = {"aa": 90, "bb": 8, "cc": 4}
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model, F.lit(False)).collect()}
    for i, t in enumerate(texts):
        assert got[1000 + i] == plain_language(counts, documents, t), t
    few = language_id.fit(docs, limit=2, words=3)
    assert few.languages == ["aa", "bb", "cc"] and len(few.words) <= 9 and np.exp(few.prior).round(3).tolist() == [0.882, 0.078, 0.039]
