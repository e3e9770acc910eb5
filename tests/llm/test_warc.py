import hashlib

from quern.llm import common as C
from quern.llm import warc


def test_round_trip(spark):
    big, other = "<p>é" * 400, "y" * 1000
    pages = [(1, "http://a", big, "k"), (7, "http://b\r\nX: y", big, "k"), (7, "http://b\r\nX: y", big, "k"), (3, None, None, "k"), (4, "u", "", "k"), (5, "u", "small", "k"), (6, "u", "small", "k"), (None, "n", other, "k"), (9, "u", other, "k"), (-8, "u", other, "k")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, address string")
    path = C.shared_folder(spark)
    warc.store(df, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({p[2] or "" for p in pages})
    sha1 = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
    owner = {big: 7, other: 9}
    want = sorted((str(i), len((h or "").encode()), sha1(h), *(("revisit", owner[h]) if h in owner and i != owner[h] else ("response", None))) for i, _, h, _ in pages)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.facts(spark, path).collect())
    assert str(got) == str(want)
    records = warc.reconstruct(spark, path).collect()
    assert len(records) == len(pages)
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest == bytes(r.payload if fields[b"WARC-Type"] == b"response" else b"") + b"\r\n\r\n"
        assert int(fields[b"Content-Length"]) == len(rest) - 4
        assert fields[b"WARC-Payload-Digest"] == b"sha1:" + hashlib.sha1(bytes(r.payload)).hexdigest().encode()


def test_empty(spark):
    path = C.shared_folder(spark)
    warc.store(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.facts(spark, path).count() == 0
