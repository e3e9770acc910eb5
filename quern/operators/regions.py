"""Overlapping windows of sentences around each sentence, and their pruning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import blocks


def validate_sizes(chunk: int | None, region: int, overhead: int = 0) -> None:
    if region <= overhead:
        raise ValueError("the region budget must exceed the overhead")
    if chunk is not None and chunk <= region:
        raise ValueError("retrieval chunks must be larger than the region budget")


def centred_windows(units: DataFrame, budget: int, overhead: int = 3) -> DataFrame:
    """(doc_id, center, first, last, truncated): each unit's window, grown left and right in turn within the budget.

    units (doc_id, ordinal, token_start, token_end) with ordinals from 0 without gaps; a row of
    lengths a document takes their place.
    """
    rows = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal").cast("bigint").alias("o"), (F.col("token_end") - F.col("token_start")).alias("n")))).alias("u"))
    gap = F.assert_true(F.element_at("u", -1)["o"] == F.size("u") - 1, F.lit("the ordinals of a document must run from 0 without gaps"))
    return windows_of_lengths(rows.where(gap.isNull()).select("doc_id", F.transform("u", lambda x: x["n"]).alias("lengths")), budget, overhead)


def windows_of_lengths(lengths: DataFrame, budget: int, overhead: int = 3) -> DataFrame:
    """The windows of rows (doc_id, lengths), the tokens of a document's units: without a shuffle, and a row for each unit and no more."""
    validate_sizes(None, budget, overhead)

    def found(b: blocks.Block):
        l, r = blocks.grown(b, budget, overhead)
        return b.doc, {"center": b.ordinal, "first": b.ordinal[l], "last": b.ordinal[r], "truncated": b.n + overhead >= budget}

    return blocks.mapped(lengths, found, "center bigint, first bigint, last bigint, truncated boolean")


def fixed_window(start, end, length, budget: int, overhead: int = 3):
    """(first, last) tokens of a window around tokens [start, end): the room left is split in halves; all Columns."""
    room = F.greatest(F.lit(budget - overhead) - (end - start), F.lit(0))
    return F.greatest(start - F.floor(room / 2), F.lit(0)), F.least(end + (room - F.floor(room / 2)), length)


def pruned(windows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, window, start, end, center): windows bound to chunks (doc_id, window, first, last), without repeats and strict parts.

    Sorted by start and falling end, a region is part of another exactly if an earlier one
    reaches as far; one window function decides.
    """
    on = windows.join(chunks.select("doc_id", "window", F.col("first").alias("cf"), F.col("last").alias("cl")), "doc_id").where("center between cf and cl")
    bound = on.select("doc_id", "window", "center", F.greatest("first", "cf").alias("start"), (F.least("last", "cl") + 1).alias("end"))
    once = bound.groupBy("doc_id", "window", "start", "end").agg(F.min("center").alias("center"))
    reach = F.max("end").over(Window.partitionBy("doc_id", "window").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    return once.withColumn("reach", reach).where("reach is null or reach < end").drop("reach")


def pruned_of_lengths(lengths: DataFrame, budget: int, size: int, overhead: int = 3) -> DataFrame:
    """What `pruned` has of the windows and the chunks of `size` tokens of rows (doc_id, lengths); a document's windows and chunks meet in its own row."""
    validate_sizes(size, budget, overhead)

    def found(b: blocks.Block):
        l, r = blocks.grown(b, budget, overhead)
        unit, window, chunk = blocks.members(b, size)
        head = np.flatnonzero(np.diff(chunk, prepend=-1))
        tail = np.append(head[1:], len(unit)) - 1
        start, end = np.maximum(l[unit], unit[head][chunk]), np.minimum(r[unit], unit[tail][chunk]) + 1
        by = np.lexsort((unit, -end, start, chunk))
        unit, window, chunk, start, end = (x[by] for x in (unit, window, chunk, start, end))
        once = np.ones(len(unit), bool)
        once[1:] = (chunk[1:] != chunk[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        unit, window, chunk, start, end = (x[once] for x in (unit, window, chunk, start, end))
        far = chunk * (len(b.n) + 2) + end  # larger in a later chunk
        kept = np.ones(len(unit), bool)
        kept[1:] = np.maximum.accumulate(far)[:-1] < far[1:]
        unit, window, start, end = (x[kept] for x in (unit, window, start, end))
        return b.doc[unit], {"window": window, "start": b.ordinal[start], "end": b.ordinal[end - 1] + 1, "center": b.ordinal[unit]}

    return blocks.mapped(lengths, found, "window bigint, start bigint, end bigint, center bigint")
