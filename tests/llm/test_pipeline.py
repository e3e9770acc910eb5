import random

import corpus_pipeline
from quern.llm import common as C


def text(rng, n=220):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(n))


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(12)
    clean = [text(rng) for _ in range(60)]
    rows = list(clean)
    rows += [clean[3], clean[3], clean[5].replace(clean[5].split()[50], "zz", 1)]  # 60, 61 exact copies; 62 a near copy
    passage = text(rng, 90)
    rows += [f"{text(rng, 150)} {passage} {text(rng, 120)}" for _ in range(3)]  # 63-65 share a passage
    item = text(rng, 40)
    rows += [f"{text(rng, 30)} {item} {text(rng, 30)}"]  # 66 holds a test item
    junk = [" ".join(w + "###" for w in text(rng, 60).split()) for _ in range(25)]
    rows += junk + ["too short", "", None, "same words here again now " * 40]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), i) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, t long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(67 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, text(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [f for _, f in corpus_pipeline.STAGES]
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for stage in left[:-1]:
        now = C.stored(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns
        kept.append({r.doc_id: r for r in now.collect()})
    quality, near, repeats, tests = kept
    assert set(quality) == set(range(67))
    assert set(near) == set(range(67)) - {60, 61, 62}
    assert set(repeats) == set(near) and all(repeats[i].text == rows[i] for i in repeats if i not in (63, 64, 65))
    for i in (63, 64, 65):
        assert passage[5:-5] not in repeats[i].text and repeats[i].n_chars == len(repeats[i].text) and rows[i].startswith(repeats[i].text[:500])
    assert set(tests) == set(repeats) - {66}
    packed = left[-1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(tests)
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(packed)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
