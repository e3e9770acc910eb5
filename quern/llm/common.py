"""Shared pieces of the training-data operators.

Texts reach Python as Arrow batches.  A batch is cut into byte-bounded blocks (a
document is never cut) and each block is handled as one flat byte buffer with
NumPy, so the cost of a word is a few array passes and not a Python object.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by one task.
BLOCK_BYTES = 2 << 20

#: The bytes \x20 and \x09-\x0D separate words.
SPACE_BYTES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)


def byte_table(of: bytes | tuple[int, ...] | range) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(of)] = True
    return table


#: True for a byte of a word `[^\x20\x09-\x0D]+`.
WORD_BYTE = ~byte_table(SPACE_BYTES)
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Flat:
    """Documents of one block as a flat byte buffer: document d is data[off[d]:off[d + 1]]."""

    def __init__(self, texts: pa.Array):
        if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
            kind = np.int32
        else:
            texts, kind = texts.cast(pa.large_binary()), np.int64
        if texts.null_count:
            texts = pc.fill_null(texts, pa.scalar(b"", pa.binary()).cast(texts.type))
        n = len(texts)
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = whole[off[0] : off[-1]]
        self.off = off - off[0]
        self.n = n

    def spans(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of mask within documents, and the index of each document's first run (n + 1 values)."""
        size = len(self.data)
        if not size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        first = np.empty(size, bool)
        first[0], first[1:] = True, ~mask[:-1]
        inner = self.off[:-1][self.off[:-1] < size]
        first[inner] = True
        starts = np.flatnonzero(first & mask)
        last = first
        last[-1], last[:-1] = True, ~mask[1:]
        last[self.off[1:][self.off[1:] > 0] - 1] = True
        ends = np.flatnonzero(last & mask) + 1
        return starts, ends, np.searchsorted(starts, self.off)

    def words(self, table: np.ndarray = WORD_BYTE):
        return self.spans(table[self.data])


def sliced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """The byte strings data[starts:ends] as an Arrow binary array; mask, where given, marks just their bytes."""
    off = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=off[1:])
    body = data[mask] if mask is not None else data[take_spans(starts, ends)]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(body))])


def take_spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Indices of all bytes of the spans, in order."""
    size = ends - starts
    keep = size > 0
    starts, size = starts[keep], size[keep]
    total = int(size.sum())
    step = np.ones(total, np.int64)
    if total:
        step[0] = starts[0]
        at = np.cumsum(size)[:-1]
        step[at] = starts[1:] - (starts[:-1] + size[:-1]) + 1
    return np.cumsum(step)


def encoded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Ids of equal byte strings and the distinct strings."""
    d = words.dictionary_encode()
    return np.asarray(d.indices).astype(np.int64), d.dictionary


def in_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", budget: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `budget` bytes of text; a longer document is a slice by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + budget, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def per_doc(values: np.ndarray, first: np.ndarray, kind=np.float64) -> np.ndarray:
    """Sums of values over the ranges first[d]:first[d + 1]."""
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each run, of the first-run indices that spans() returns."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values, well mixed."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


# --- Spark side ---


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def crc_mod(k: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, mod k."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(k)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; a local one is set only where the session names none (tests)."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or (sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="quern-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/quern-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: the lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what stored() wrote, when no later plan reads it."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def all_labelled_ids(labels: DataFrame, label: str, keep: Column | None = None) -> DataFrame:
    """The labelled ids (doc_id, y); repeated ids count once, with their largest label."""
    ids = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    if keep is not None:
        ids = ids.where(keep)
    return ids.groupBy("doc_id").agg(F.max("y").alias("y"))


def class_sizes(labels: DataFrame, label: str) -> tuple[int, int]:
    """Numbers of labelled ids of class 0 and 1."""
    n = {r["y"]: r["count"] for r in all_labelled_ids(labels, label).groupBy("y").count().collect()}
    return n.get(0, 0), n.get(1, 0)


def labelled_ids(labels: DataFrame, label: str, limit: int, keep: Column | None = None) -> DataFrame:
    """At most `limit` ids (doc_id, y) of each class, chosen by a hash of the id; repeated ids count once, with their largest label."""
    ids = all_labelled_ids(labels, label, keep)
    of = lambda y: ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return of(0).unionAll(of(1))


def labelled_rows(documents: DataFrame, labels: DataFrame, label: str, limit: int, keep: Column | None = None) -> DataFrame:
    """(doc_id, text, y) of the sampled labelled documents. The broadcast side has 2 * `limit` rows of two numbers at most."""
    ids = labelled_ids(labels, label, limit, keep)
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def class_weights(labels: DataFrame, label: str, keep: Column | None = None) -> tuple[int, int]:
    """Numbers of labelled rows of class 0 and 1 (all of them, not the sample)."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if keep is not None:
        rows = rows.where(keep)
    n = {int(r[0]): r[1] for r in rows.groupBy(label).count().collect()}
    return n.get(0, 0), n.get(1, 0)
