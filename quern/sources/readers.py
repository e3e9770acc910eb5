"""Readers. All read through Spark, so any store that Spark reaches will do."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY = "id string, query string"


def text_directory(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): a document for each file, in the order numbered files, then the others by name."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; a line that is no object of the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(id, query); both are required, other keys dropped."""
    rows = json_lines(spark, path, QUERY)
    fine = F.assert_true(F.col("id").isNotNull() & F.col("query").isNotNull(), F.lit("a query record needs id and query"))
    return rows.where(fine.isNull())


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON array or of JSON lines, told apart by the first sign."""
    first = _lines(spark, path).limit(1).collect()
    if not first:
        return spark.createDataFrame([], schema)
    whole = first[0][0].lstrip().startswith("[")
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", whole).json(path)


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def zipped_csv(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """Named columns of a CSV file inside zip archives, one archive a task."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv

        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    rows: list[dict] = []
                    for row in csv.DictReader(io.TextIOWrapper(f, "utf-8", newline="")):
                        rows.append({c: row[c] for c in columns})
                        if len(rows) == 5_000:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.string()) for c in columns]))
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.string()) for c in columns]))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def tar_members(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(name, text) of the wanted members (name) of gzipped tar archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
                    for m in t:
                        if m.isfile():
                            yield pa.RecordBatch.from_pylist([{"name": m.name.rpartition("/")[2], "text": t.extractfile(m).read().decode("utf-8", "replace")}])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, text string")
    return rows.join(wanted.select("name").distinct(), "name", "left_semi")


def xml_records(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """Records of XML files, one for each element `row_tag`."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def nested_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of {"data": [...]} in a JSON file."""
    return spark.read.schema(f"data array<struct<{schema}>>").option("multiLine", True).json(path).select(F.explode("data").alias("d")).select("d.*")
