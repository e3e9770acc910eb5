"""The two-bit residual codec of token vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import EPSILON, dot, norm, normalized, packed, quantized, unpacked

#: Centroids that may be broadcast: a codec has at most 16 sqrt(n).
MOST_CENTROIDS = 1 << 16
#: Vectors that train one centre, and the most held out for the quartiles.
PER_CENTROID, HELD_OUT = 100, 50_000
#: Vectors of a sample to one task: a limit leaves all of them in a single one.
SAMPLE_PART = 2_000


def trained_centroids(vectors: DataFrame, k: int, iterations: int = 4, seed: int = 123) -> DataFrame:
    """(centroid, vector): k-means centres of vectors (id, vector), normalised."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if k >= vectors.count():
        raise ValueError("there must be fewer centroids than vectors")
    model = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="v").fit(vectors.select(array_to_vector("vector").alias("v")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "centroid bigint, vector array<double>").withColumn("vector", normalized(F.col("vector")))


def split_sample(vectors: DataFrame, k: int, per: int = PER_CENTROID, held_out: int = HELD_OUT) -> tuple[DataFrame, DataFrame]:
    """(training, held out) of vectors (id, vector), by a hash of the id: a twentieth is held out, and neither part exceeds its bound."""
    aside = F.pmod(F.xxhash64("id"), F.lit(20)) == 0
    least = lambda rows, n: rows.orderBy(F.xxhash64("id"), "id").limit(n).repartition(-(-n // SAMPLE_PART), "id")
    return least(vectors.where(~aside), k * per), least(vectors.where(aside), held_out)


def built(vectors: DataFrame, k: int, per: int = PER_CENTROID, held_out: int = HELD_OUT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(codes, centroids, buckets): centres of a training sample, quartiles of the residuals of vectors held out from it, and all vectors encoded."""
    training, aside = split_sample(vectors, k, per, held_out)
    centroids = trained_centroids(training, k)
    buckets = bucket_values(residuals(assigned(aside, centroids)))
    return encoded(assigned(vectors, centroids), buckets), centroids, buckets


def assigned(vectors: DataFrame, centroids: DataFrame, digits: int = 6) -> DataFrame:
    """vectors (id, vector) with centroid and c: the centre of largest inner product, the smaller number among equals.

    The centres are broadcast, MOST_CENTROIDS at most; a batch of vectors is one matrix product.
    """
    table = centroids.select("centroid", "vector").orderBy("centroid").limit(MOST_CENTROIDS + 1).collect()
    if len(table) > MOST_CENTROIDS:
        raise ValueError("too many centroids to broadcast")
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in table], np.int64), np.array([r[1] for r in table], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, c = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("vector").flatten(), np.float64).reshape(batch.num_rows, -1)
            best = np.concatenate([np.round(x[i : i + 1024] @ c.T, digits).argmax(1) for i in range(0, len(x), 1024)])
            off = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(np.ascontiguousarray(v).ravel())) for v in (x, c[best])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists[0], pa.array(numbers[best]), lists[1]], ["id", "vector", "centroid", "c"])

    return vectors.select("id", "vector").mapInArrow(run, "id bigint, vector array<double>, centroid bigint, c array<double>")


def residuals(rows: DataFrame) -> DataFrame:
    return rows.withColumn("residual", F.zip_with("vector", "c", lambda x, y: x.cast("double") - y.cast("double")))


def bucket_values(rows: DataFrame) -> DataFrame:
    """One row (cutoffs, weights): quartiles of the residual values, and the middles of the quarters. Exact for what it is given: HELD_OUT vectors at most, those of the least hashes."""
    x = rows.orderBy(F.xxhash64("id"), "id").limit(HELD_OUT).select(F.explode("residual").alias("x"))
    return x.agg(F.percentile("x", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("cutoffs"), F.percentile("x", F.array(*map(F.lit, (0.125, 0.375, 0.625, 0.875)))).alias("weights"))


def encoded(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """(id, centroid, codes): residuals as bytes of four two-bit values."""
    values = F.transform("residual", lambda x: quantized(x, F.col("cutoffs")))
    return residuals(rows).join(F.broadcast(buckets)).select("id", "centroid", packed(values).alias("codes"))


def decoded(codes: DataFrame, centroids: DataFrame, buckets: DataFrame) -> DataFrame:
    """(id, vector, norm): centre plus bucket weights, normalised; norm is the length before."""
    rows = codes.join(centroids.select("centroid", F.col("vector").alias("c")), "centroid").join(F.broadcast(buckets))
    rough = rows.withColumn("r", F.zip_with("c", F.transform(unpacked(F.col("codes")), lambda b: F.get(F.col("weights"), b)), lambda x, y: x + y))
    return rough.select("id", normalized(F.col("r")).alias("vector"), F.greatest(norm(F.col("r")), F.lit(EPSILON)).alias("norm"))


def record_bytes(dim: int, interleaved: bool = True) -> int:
    """Bytes of a stored token: centre number, codes, and a length where it is interleaved."""
    if dim % 4:
        raise ValueError("the dimension must be a multiple of 4")
    return dim // 4 + (8 if interleaved else 4)


def looked_up(ids: DataFrame, store: DataFrame) -> DataFrame:
    """The stored vectors (subchunk_id, position, vector) of each id, as ordered lists; empty where there is none."""
    rows = ids.select("subchunk_id").distinct().join(store, "subchunk_id", "left")
    return rows.groupBy("subchunk_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "vector")))), lambda x: x["vector"]).alias("vectors"))


def first_copy(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
