"""The chunk catalogue: metadata rows, lookups, validation and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import document_number


def pivoted(metadata: DataFrame, keys: list[str], documents: DataFrame | None = None) -> DataFrame:
    """(id, *keys): entity-attribute-value rows (id, key, string_value, int_value) as columns of strings; documents (id, document) may be missing."""
    value = F.coalesce(F.col("string_value"), F.col("int_value").cast("string"))
    rows = metadata.where(F.col("key").isin(keys)).withColumn("v", value).groupBy("id").agg(*(F.max(F.when(F.col("key") == k, F.col("v"))).alias(k) for k in keys))
    return rows if documents is None else rows.join(documents.select("id", "document"), "id", "left")


def window_lookup(ids: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, window_ids): the windows (id, window_ids) of each id; an unknown id is its own window."""
    rows = ids.join(windows, "id", "left")
    return rows.select("id", F.coalesce("window_ids", F.array("id")).alias("window_ids"))


def differences(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, state): rows that are missing, unexpected, or different in any other column."""
    columns = [c for c in expected.columns if c != key]
    a = expected.select(F.col(key), F.xxhash64(*columns).alias("_a"), F.struct(*columns).alias("_x"))
    b = stored.select(F.col(key), F.struct(*columns).alias("_y"))
    rows = a.join(b, key, "full")
    state = F.when(F.col("_y").isNull(), "missing").when(F.col("_x").isNull(), "unexpected").when(~F.col("_x").eqNullSafe(F.col("_y")), "different")
    return rows.select(key, state.alias("state")).where("state is not null")


def id_checks(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row of counts: ids on one side alone, and repeats on each side."""
    count = lambda df: df.groupBy(key).agg(F.count("*").alias("n"))
    rows = count(left).withColumnRenamed("n", "l").join(count(right).withColumnRenamed("n", "r"), key, "full")
    return rows.agg(
        F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"),
        F.coalesce(F.sum(F.col("l") - 1), F.lit(0)).alias("left_repeats"), F.coalesce(F.sum(F.col("r") - 1), F.lit(0)).alias("right_repeats"),
    )


def in_document_order(documents: DataFrame, name: str = "name") -> DataFrame:
    """Numbered documents by number, then the others by name."""
    n = document_number(F.col(name))
    return documents.orderBy(n.isNull(), n, name)


def ordered_by_first(rows: DataFrame) -> DataFrame:
    """(doc_id, start, place): documents by the least old id that they hold."""
    return rows.groupBy("doc_id").agg(F.min("subchunk_id").alias("start"))
