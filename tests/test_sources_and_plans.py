import gzip
import io
import json
import tarfile
import zipfile

import pytest

from quern.operators import qa_datasets
from quern.plans import stages
from quern.sources import readers, sinks
from quern.streaming import stream


def test_readers(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/doc_1.txt").write_text("a\nb")
    assert [(r.name, r.text) for r in readers.text_directory(spark, str(tmp_path / "docs")).collect()] == [("doc_1.txt", "a\nb")]
    (tmp_path / "q.jsonl").write_text('{"id": 1, "query": "x", "more": 2}\n{"id": "b", "query": "y"}\n')
    assert sorted(map(tuple, readers.queries(spark, str(tmp_path / "q.jsonl")).collect())) == [("1", "x"), ("b", "y")]
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n')
    with pytest.raises(Exception, match="needs id and query"):
        readers.queries(spark, str(tmp_path / "bad.jsonl")).collect()
    for name, body in (("a.json", '\n [{"v": 1}, {"v": 2}]'), ("b.json", '{"v": 1}\n\n{"v": 2}\n')):
        (tmp_path / name).write_text(body)
        assert sorted(r.v for r in readers.records(spark, str(tmp_path / name), "v int").collect()) == [1, 2]
    (tmp_path / "c.json").write_text("")
    assert readers.records(spark, str(tmp_path / "c.json"), "v int").count() == 0
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", 'id,t\n1,"a, b"\n2,c\n')
    assert sorted(map(tuple, readers.zipped_csv(spark, str(tmp_path / "a.zip"), "x.csv", ["t", "id"]).collect())) == [("a, b", "1"), ("c", "2")]
    with tarfile.open(tmp_path / "s.tar.gz", "w:gz") as t:
        for name in ("p/1.story", "p/2.story"):
            info = tarfile.TarInfo(name)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
    wanted = spark.createDataFrame([("2.story",)], "name string")
    assert [tuple(r) for r in readers.tar_members(spark, str(tmp_path / "s.tar.gz"), wanted).collect()] == [("2.story", "abc")]
    (tmp_path / "r.xml").write_text("<set><rec><id>1</id><t>x</t></rec><rec><id>2</id><t>y</t></rec></set>")
    assert sorted((r.id, r.t) for r in readers.xml_records(spark, str(tmp_path / "r.xml"), "rec", "id int, t string").collect()) == [(1, "x"), (2, "y")]
    nested = {"data": [{"paragraphs": [{"document_id": 4, "context": "abc d", "qas": [{"id": 9, "question": "q", "answers": [{"text": "d", "answer_start": 4}]}]}]}]}
    (tmp_path / "n.json").write_text(json.dumps(nested))
    schema = "paragraphs: array<struct<document_id: int, context: string, qas: array<struct<id: int, question: string, answers: array<struct<text: string, answer_start: int>>>>>>"
    flat = qa_datasets.flattened(readers.nested_json(spark, str(tmp_path / "n.json"), schema))
    audit = flat.selectExpr("id", "context", "answers[0].text answer", "answers[0].answer_start start")
    assert [r.matches for r in qa_datasets.offset_audit(audit).collect()] == [True]
    with gzip.open(tmp_path / "z.jsonl.gz", "wt") as f:
        f.write('{"v": 3}\n')
    assert readers.json_lines(spark, str(tmp_path / "z.jsonl.gz"), "v int").first().v == 3


def test_manifests_and_sinks(spark, tmp_path):
    at = f"file://{tmp_path}/m.json"
    assert sinks.read_manifest(spark, at, "k", 1) is None
    m = sinks.write_manifest(spark, at, "k", 1, {"b": 2, "a": "é"})
    assert sinks.read_manifest(spark, at, "k", 1) == m and len(sinks.manifest_hash(m)) == 64
    with pytest.raises(ValueError):
        sinks.read_manifest(spark, at, "k", 2)
    sinks.write_once(spark.range(3), f"{tmp_path}/t")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_once(spark.range(3), f"{tmp_path}/t")


def test_plan_runs_and_resumes(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{k} goes on." for k in range(60 + i))) for i in range(4)] + [(9, " ".join(f"w{k} goes on." for k in range(60)))], "doc_id long, text string")
    config = stages.Config(retrieval_chunk=80, region_budget=40, unit_cap=30, distinct=True)
    root = f"file://{tmp_path}/build"
    assert [s.name for s in stages.execute(spark, docs, root, config, dry=True)] == ["documents", "units", "subchunks", "chunks", "regions"]
    stages.execute(spark, docs, root, config)
    assert spark.read.parquet(f"{root}/documents").count() == 4 and spark.read.parquet(f"{root}/regions").count() > 0
    before = spark.read.parquet(f"{root}/regions").inputFiles()
    stages.execute(spark, docs, root, config)
    assert spark.read.parquet(f"{root}/regions").inputFiles() == before
    with pytest.raises(ValueError):
        stages.Config(retrieval_chunk=100, region_budget=180)


def test_streams(spark, tmp_path):
    spark.createDataFrame([("1", "x"), ("2", "y")], "id string, query string").write.json(f"{tmp_path}/in")
    rows = spark.readStream.schema(readers.QUERY).json(f"{tmp_path}/in")
    stream.answered(rows, lambda df: df.selectExpr("id", "upper(query) prediction"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert sorted((r.id, r.prediction) for r in spark.read.json(f"{tmp_path}/out").collect()) == [("1", "X"), ("2", "Y")]
