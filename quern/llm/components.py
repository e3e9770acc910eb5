"""Connected components of a graph of links, by alternating large-star and small-star steps.

No step brings a node's neighbours together in one task: minima are aggregated, and joined
back to the links.  Every step's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common as C


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b), a > b. Large: every neighbour above a node is linked to the least node around it; small: every neighbour below."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the least node that it reaches."""
    links = C.stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = _state(links)
    for _ in range(most):
        large = C.stored(_star(links, True))
        small = C.stored(_star(large, False))
        C.removed(links.sparkSession, links, large)
        links, after = small, _state(small)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
