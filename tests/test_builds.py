import hashlib

import pytest
from pyspark.sql import functions as F

from quern.operators import builds, codec, encoding, selection


def test_dense_vectors_have_unit_length_and_queries_a_prefix(spark):
    rows = spark.createDataFrame([(1, "aa e"), (2, None), (3, "xyz")], "id long, text string")
    got = {r.id: r.vector for r in encoding.embedded(rows).collect()}
    assert [round(x, 6) for x in got[1]] == [round(2 / 5**0.5, 6), round(1 / 5**0.5, 6), 0, 0] and got[2] == got[3] == [0, 0, 0, 0]
    assert encoding.embedded(rows.limit(0)).count() == 0
    assert {r.id: r.vector for r in encoding.embedded(rows, prefix="i").collect()}[2] == [0, 0, 1, 0]


def test_document_vectors_keep_the_centre_or_all(spark):
    rows = spark.createDataFrame([(1, "one, two three", 5, 8), (2, "one two", 90, 99)], "id long, text string, s int, e int")
    tokens = encoding.token_embedded(rows).join(rows.select("id", "s", "e"), "id")
    got = sorted((r.id, r.token) for r in encoding.document_vectors(tokens, "s", "e").collect())
    assert got == [(1, "two"), (2, "one"), (2, "two")]


def test_tokens_of_a_span_and_the_text_of_a_window(spark):
    row = spark.createDataFrame([("ab cd,  ef",)], "t string")
    pick = lambda a, b: row.select(builds.tokens_of_span(F.col("t"), F.lit(a), F.lit(b)).alias("s")).first().s
    assert tuple(pick(1, 4)) == (0, 2) and tuple(pick(5, 6)) == (2, 3) and pick(6, 8) is None
    assert row.select(builds.window_text(F.col("t"), F.lit(1), F.lit(4))).first()[0] == "cd,  ef"


def test_checks_raise(spark, tmp_path):
    twice = spark.createDataFrame([("1", "list", "a"), ("1", "list", "b")], "id string, type string, body string")
    with pytest.raises(Exception, match="twice"):
        builds.typed_questions(twice)[0].collect()
    with pytest.raises(Exception, match="unknown question type"):
        builds.typed_questions(twice.limit(1).withColumn("type", F.lit("odd")))[0].collect()
    with pytest.raises(Exception, match="repeated document"):
        builds.abstract_documents(spark.createDataFrame([("x", "t", ["a"])], "pmid string, title string, abstract_sections array<string>")).collect()
    regions = spark.createDataFrame([(1, 1, 0, 1.0, 0, 2)], "query_id long, chunk_rank int, region_id int, score double, start long, end long")
    with pytest.raises(Exception, match="no token count"):
        selection.select_regions(regions, spark.createDataFrame([(0, 5)], "subchunk_id long, tokens long"), 10).collect()
    with pytest.raises(ValueError):
        builds.validate_centre_unit("sentence", "fixed")
    with pytest.raises(ValueError):
        builds.validate_budget(5, "a", {"tokenizer_name": "b"})
    (tmp_path / "f").write_bytes(b"abc")
    digest = hashlib.sha256(b"abc").hexdigest()
    assert builds.verified_file(spark, f"{tmp_path}/f", 3, digest).first().sha256 == digest
    with pytest.raises(Exception, match="expected file"):
        builds.verified_file(spark, f"{tmp_path}/f", 4, digest).collect()


def test_trivia_references(spark):
    rows = spark.createDataFrame([(1, ["x"], ["y"], ["Z"]), (2, None, ["y"], ["The Z!"])], "i int, a array<string>, b array<string>, h array<string>")
    got = [r[0] for r in rows.orderBy("i").select(builds.trivia_references(F.col("a"), F.col("b"), F.col("h"))).collect()]
    assert got[0] == ["x"] and got[1][0] == "y" and len(got[1]) == 2


def test_codec_sample_is_held_apart(spark):
    vectors = spark.range(400).select("id", F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 2), F.lit(0.5)).alias("vector"))
    training, aside = codec.split_sample(vectors, 3, per=10, held_out=7)
    assert training.count() == 30 and aside.count() == 7 and training.join(aside, "id").count() == 0
    codes, centroids, buckets = codec.built(vectors, 4)
    assert codes.count() == 400 and centroids.count() == 4 and len(buckets.first().cutoffs) == 3


def test_token_vectors_of_a_full_batch_are_made_in_blocks():
    """10,000 texts in one Arrow batch: memory goes by the block, and every token is there."""
    import tracemalloc

    import pyarrow as pa

    texts = [None, "", *(f"one two, {k} a" * 20 for k in range(9_998))]
    held = []

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
            tracemalloc.start()
            for out in run(iter([batch])):
                held.append((out.num_rows, out.column("id")[0].as_py(), out.column("token")[0].as_py(), out.column("position")[-1].as_py(), out.column("vector")[-1].as_py()))
            held.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            return self

    from unittest import mock

    with mock.patch.object(encoding.F, "col"):
        encoding.token_embedded(Rows())
    assert held.pop() < 60e6
    assert sum(n for n, *_ in held) == sum(len(encoding._TOKEN.findall(t or "")) for t in texts)
    assert held[0][1:3] == (2, "one") and held[-1][3] == len(encoding._TOKEN.findall(texts[-1])) - 1 and held[-1][4] == [1.0, 0.0, 0.0, 0.0]


def test_codec_work_is_dealt_out(spark):
    """The training sample goes to several tasks, and a code's values are computed once a vector."""
    from quern.functions.vectors import packed

    vectors = spark.range(9_000).select("id", F.array(F.sin("id"), F.cos("id")).alias("vector"))
    training, aside = codec.split_sample(vectors, 50, per=100, held_out=300)
    assert training.rdd.getNumPartitions() == 3 and aside.rdd.getNumPartitions() == 1 and training.count() == 5_000 and aside.count() == 300
    assert str(packed(F.col("residual_values"))).count("residual_values") == 1
    assert spark.range(1).select(packed(F.array(*map(F.lit, (1, 0, 2, 3, 3, 3, 0, 1))))).first()[0] == [135, 242]
