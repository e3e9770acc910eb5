"""Encoders as functions that a caller gives, called once for each block of texts: an Arrow batch, or TEXT_BLOCK bytes of one.

A dense encoder maps a list of texts to one vector each; a token encoder maps it to one matrix
each, with the character offsets of its tokens.  The stand-ins here count letters, so that SQL
can say the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import EPSILON
from quern.operators.blocks import cut

Dense = Callable[[list[str]], np.ndarray]
Tokens = Callable[[list[str]], list[tuple[np.ndarray, list[tuple[int, int]]]]]
LETTERS = "aeio"
#: Bytes of text that an encoder gets at once; a text is never cut.
TEXT_BLOCK = 1 << 18
_TOKEN = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+|[^A-Za-z0-9\u0080-\U0010ffff \t\n\x0b\f\r]")


def letter_counts(texts: list[str]) -> np.ndarray:
    """A dense stand-in: how often each of LETTERS occurs."""
    return np.array([[t.count(c) for c in LETTERS] for t in texts], np.float64).reshape(len(texts), len(LETTERS))


def token_letter_counts(texts: list[str]) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """A stand-in for a token encoder."""
    spans = [[m.span() for m in _TOKEN.finditer(t)] for t in texts]
    return [(letter_counts([t[a:b] for a, b in s]), s) for t, s in zip(texts, spans, strict=True)]


def _text_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of each block; a null text is empty."""
    for batch in batches:
        for a, b in cut(np.asarray(pc.binary_length(batch.column("text")).fill_null(0), np.int64), most):
            some = batch.slice(a, b - a)
            yield some.column("id"), [t or "" for t in some.column("text").to_pylist()]


def embedded(rows: DataFrame, encode: Dense = letter_counts, prefix: str = "") -> DataFrame:
    """(id, vector) of rows (id, text): unit vectors; a null text is empty. prefix: put before each text, for queries alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _text_blocks(batches, TEXT_BLOCK):
            x = np.asarray(encode([prefix + t for t in texts]), np.float64)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPSILON) if len(x) else x.reshape(0, 1)
            off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(off, pa.array(x.ravel()))], ["id", "vector"])

    return rows.select(F.col("id").cast("bigint").alias("id"), "text").mapInArrow(run, "id bigint, vector array<double>")


def token_embedded(rows: DataFrame, encode: Tokens = token_letter_counts) -> DataFrame:
    """(id, position, start, end, token, vector): a row for each token of rows (id, text). A block of tokens is flat arrays, not an object a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _text_blocks(batches, TEXT_BLOCK):
            made = encode(texts)
            if len(made) != len(texts) or any(len(x) != len(spans) for x, spans in made):
                raise ValueError("an encoder must give one vector for each span, and one list of spans for each text")
            counts = np.array([len(spans) for _, spans in made])
            if not counts.sum():
                continue
            x = np.concatenate([np.asarray(x, np.float64) for x, spans in made if len(spans)])
            at = np.fromiter((edge for _, spans in made for span in spans for edge in span), np.int32).reshape(-1, 2)
            position = (np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
            token = pa.array([text[a:b] for text, (_, spans) in zip(texts, made, strict=True) for a, b in spans], pa.string())
            vector = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            columns = [ids.take(pa.array(np.repeat(np.arange(len(texts)), counts))), pa.array(position), pa.array(np.ascontiguousarray(at[:, 0])), pa.array(np.ascontiguousarray(at[:, 1])), token, vector]
            yield pa.RecordBatch.from_arrays(columns, ["id", "position", "start", "end", "token", "vector"])

    return rows.select(F.col("id").cast("bigint").alias("id"), "text").mapInArrow(run, "id bigint, position int, start int, end int, token string, vector array<double>")


def is_valid_token() -> Column:
    """Not padding (an empty span) and not punctuation."""
    return (F.col("end") > F.col("start")) & F.col("token").rlike(r"^[A-Za-z0-9\x{80}-\x{10FFFF}]")


def document_vectors(tokens: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The valid tokens; where a text has a centre span (columns start and end), those that overlap it, or all if none does."""
    rows = tokens.where(is_valid_token())
    if start is None:
        return rows
    inside = (F.col("end") > F.col(start)) & (F.col("start") < F.col(end))
    some = F.max(inside).over(Window.partitionBy("id"))
    return rows.withColumn("_in", inside).withColumn("_some", some).where("_in or not _some").drop("_in", "_some")


def query_length(tokens: Column, least: int, most: int) -> Column:
    """The length that a query is padded to: its tokens and three special ones, within bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), tokens + 3))
