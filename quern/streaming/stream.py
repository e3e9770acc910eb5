"""Questions and documents that arrive as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.chunking import content_digest


def answered(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of queries goes through the batch plan `answer`; a batch that is repeated after a failure overwrites its own directory."""

    def batch(rows: DataFrame, number: int) -> None:
        answer(rows).write.mode("overwrite").json(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_stream(documents: DataFrame, time: str = "ts", within: str = "1 day") -> DataFrame:
    """Documents whose content was not seen within the watermark."""
    return documents.withColumn("digest", content_digest()).withWatermark(time, within).dropDuplicatesWithinWatermark(["digest"])


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value): tumbling windows over events (ts, event_type, value), batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
