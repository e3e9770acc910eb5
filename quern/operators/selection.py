"""Selection of passages under a token budget, for all queries in one plan.

The greedy loops are prefix computations: a subchunk is charged to the first-ranked region
that holds it, and a running sum of the charges decides where a query stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def ranked_regions(regions: DataFrame) -> DataFrame:
    """regions (query_id, chunk_rank, region_id, score, ...) with region_rank: by score, then retrieval order."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_rank", "region_id")
    return regions.withColumn("region_rank", F.row_number().over(by))


def select_regions(regions: DataFrame, token_counts: DataFrame, budget: int) -> DataFrame:
    """Subchunks (query_id, region_rank, chunk_rank, region_id, subchunk_id, tokens) of the regions taken.

    regions (query_id, chunk_rank, region_id, score, start, end), members [start, end);
    token_counts (subchunk_id, tokens).  Only subchunks not taken before are charged; the first
    region that would overflow ends the query, as does a full budget. A subchunk without a count is an error.
    """
    ranked = ranked_regions(regions)
    members = ranked.select("query_id", "region_rank", "chunk_rank", "region_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("subchunk_id"))
    novel = members.withColumn("first", F.min("region_rank").over(Window.partitionBy("query_id", "subchunk_id"))).where("region_rank = first").drop("first")
    charged = novel.dropDuplicates(["query_id", "subchunk_id"]).join(token_counts.select("subchunk_id", "tokens"), "subchunk_id", "left")
    charged = charged.where(F.assert_true(F.col("tokens").isNotNull(), F.lit("a subchunk has no token count")).isNull())
    by = Window.partitionBy("query_id").orderBy("region_rank")
    cost = charged.groupBy("query_id", "region_rank").agg(F.sum("tokens").alias("cost"))
    total = F.sum("cost").over(by.rowsBetween(*_UP_TO_HERE))
    taken = cost.withColumn("total", total).where((F.col("total") <= budget) & (F.col("total") - F.col("cost") < budget))
    return charged.join(taken.select("query_id", "region_rank"), ["query_id", "region_rank"]).select("query_id", "region_rank", "chunk_rank", "region_id", "subchunk_id", "tokens")


def select_subchunks(candidates: DataFrame, budget: int) -> DataFrame:
    """The subchunks taken by score until the budget is reached; the last may overshoot it.

    candidates (query_id, chunk_rank, subchunk_id, score, tokens): of equal subchunks the best
    scored counts, the first retrieved among equals.
    """
    once = Window.partitionBy("query_id", "subchunk_id").orderBy(F.desc("score"), "chunk_rank")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_rank", "subchunk_id")
    rows = candidates.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
    rows = rows.withColumn("rank", F.row_number().over(by)).withColumn("before", F.sum("tokens").over(by.rowsBetween(*_UP_TO_HERE)) - F.col("tokens"))
    return rows.where(F.col("before") < budget).drop("before")


def passages(selected: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, chunk_rank, region_id, first, last, passage): each region's maximal runs of consecutive subchunks, joined by spaces."""
    by = Window.partitionBy("query_id", "region_rank").orderBy("subchunk_id")
    runs = selected.withColumn("run", F.col("subchunk_id") - F.row_number().over(by))
    rows = runs.join(texts.select("subchunk_id", "text"), "subchunk_id")
    return (
        rows.groupBy("query_id", "chunk_rank", "region_rank", "region_id", "run")
        .agg(F.min("subchunk_id").alias("first"), F.max("subchunk_id").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("subchunk_id", "text"))), lambda x: x["text"]), " ").alias("passage"))
        .select("query_id", "chunk_rank", "region_id", "first", "last", "passage")
    )


def reassembled(retrieved: DataFrame, runs: DataFrame) -> DataFrame:
    """(query_id, chunk_rank, passages): the retrieved chunks in their order, each with its passages by source position, or none."""
    lists = runs.groupBy("query_id", "chunk_rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "last", "passage"))), lambda x: x["passage"]).alias("passages"))
    return retrieved.join(lists, ["query_id", "chunk_rank"], "left").withColumn("passages", F.coalesce("passages", F.array().cast("array<string>")))


def all_passages(retrieved: DataFrame, texts: DataFrame) -> DataFrame:
    """Without selection: every subchunk of every retrieved chunk (query_id, chunk_rank, start, end), shared ones repeated."""
    members = retrieved.select("query_id", "chunk_rank", F.explode(F.sequence("start", F.col("end") - 1)).alias("subchunk_id"))
    return members.join(texts.select("subchunk_id", "text"), "subchunk_id").select("query_id", "chunk_rank", "subchunk_id", F.col("text").alias("passage"))


def fallback_first(sizes: DataFrame, selected: DataFrame) -> DataFrame:
    """(chunk_id, index): the selected indices [0, size) of each chunk of sizes (chunk_id, size); index 0 where a non-empty chunk has none."""
    valid = selected.join(sizes, "chunk_id").where((F.col("index") >= 0) & (F.col("index") < F.col("size"))).select("chunk_id", "index").distinct()
    none = sizes.where("size > 0").join(valid, "chunk_id", "left_anti").select("chunk_id", F.lit(0).alias("index"))
    return valid.unionByName(none)


#: Selection methods by name; None keeps everything.
METHODS = {None: all_passages, "late_interaction_subchunk": select_subchunks, "late_interaction_region": select_regions}


def method(name: str | None):
    if name not in METHODS:
        raise ValueError(f"unknown selection method {name!r}; known: {sorted(m for m in METHODS if m)}")
    return METHODS[name]
