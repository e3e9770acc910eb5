"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; the exact header of every record is
stored by itself with that digest.  A record is the join of the two.  Reading back checks
every payload against its address, and the record's facts come from its header.

Defined results: a null html is an empty payload; a null url an empty target.  A null
page_id is the smallest.  Repeated rows of one page and payload are records of one kind:
all responses if theirs is the largest page_id of the payload, else revisits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as C

#: Payloads of fewer bytes are repeated as responses.
LEAST_BYTES = 1000
#: Fixed values of the record headers.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_NO_PAGE = -(2**63)


def _records(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select("page_id", "url", payload.alias("payload")).withColumn("address", F.unhex(F.sha2("payload", 256)))


def _id(page) -> F.Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def store(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """Writes `path`/payloads (address, payload) and `path`/headers (address, header). Payload bytes are shuffled once at most."""
    records = _records(pages)
    index = C.stored(records.select("page_id", "url", "address", F.octet_length("payload").alias("size"), F.sha1("payload").alias("sha1")), f"{path}/_index")
    page = F.coalesce(F.col("page_id"), F.lit(_NO_PAGE))
    owners = C.stored(index.groupBy("address").agg(F.max(page).alias("owner")), f"{path}/_owners")
    from pyspark.sql import Window

    once = F.row_number().over(Window.partitionBy("address", "owner").orderBy("address"))
    records.select("address", page.alias("owner"), "payload").join(owners, ["address", "owner"]).withColumn("n", once).where("n = 1").select("address", "payload").write.parquet(f"{path}/payloads")
    revisit = (F.col("size") >= least) & (page != F.col("owner"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _id(F.col("page_id"))),
        line("WARC-Date", F.lit(_DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\r\\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", _id(F.when(F.col("owner") != _NO_PAGE, F.col("owner")))))).otherwise(""),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    index.join(owners, "address").select("address", header.alias("header")).write.parquet(f"{path}/headers")
    C.removed(pages.sparkSession, index, owners)


def verified(spark: SparkSession, path: str) -> DataFrame:
    """(address, payload) of the archive; a payload that doesn't have its address as digest is an error."""
    rows = spark.read.parquet(f"{path}/payloads")
    right = F.unhex(F.sha2("payload", 256)) == F.col("address")
    return rows.withColumn("payload", F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("a payload isn't what its address says")).cast("binary")))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, record): every record with its full payload, and the bytes it has in a WARC file (a revisit has no block)."""
    rows = spark.read.parquet(f"{path}/headers").join(verified(spark, path), "address")
    block = F.when(F.col("header").contains("\r\nWARC-Type: response\r\n"), F.col("payload")).otherwise(F.lit(b""))
    return rows.select("header", "payload", F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"))


def facts(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of each page: digests and sizes of the payloads as read, kinds and references of the headers."""
    payloads = verified(spark, path).select("address", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    of = lambda name, value: F.regexp_extract("header", f"\\r\\n{name}: {value}\\r\\n", 1)
    number = lambda name: F.when(of(name, "<urn:x-page:(-?\\d+)>") != "", of(name, "<urn:x-page:(-?\\d+)>").cast("bigint"))
    headers = spark.read.parquet(f"{path}/headers").select("address", number("WARC-Record-ID").alias("page_id"), of("WARC-Type", "(\\w+)").alias("record_type"), number("WARC-Refers-To").alias("refers_to"))
    return headers.join(payloads, "address").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
