"""Vector functions as Column expressions, in double precision, and the two-bit residual code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least length that a vector is divided by (single-precision epsilon).
EPSILON = 1.1920928955078125e-07


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """The length is bound once a vector, not computed once an element."""
    length = F.array(F.greatest(norm(a), F.lit(EPSILON)))
    return F.get(F.transform(length, lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Larger is nearer: cosine, inner product, or minus the squared distance."""
    if metric == "cosine":
        return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPSILON))
    if metric == "ip":
        return dot(a, b)
    if metric == "l2":
        return -F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    raise ValueError(f"unknown metric {metric!r}")


def default_centroids(n: Column) -> Column:
    """The largest power of two up to 16 sqrt(n), n at most."""
    return F.least(F.pow(F.lit(2.0), F.floor(F.log2(16 * F.sqrt(n)))), n).cast("bigint")


def quantized(x: Column, cutoffs: Column) -> Column:
    """Number of the three cutoffs below x."""
    return sum(((x > cutoffs[i]).cast("int") for i in range(1, 3)), (x > cutoffs[0]).cast("int"))


def packed(values: Column) -> Column:
    """Bytes (as numbers) of two-bit values, four a byte: the first in the top bits, each with its low bit first.

    The values are bound once a vector, not computed again for each use of each byte.
    """
    swapped = lambda v: F.shiftleft(v.bitwiseAND(F.lit(1)), 1) + F.shiftright(v, 1)
    at = lambda a, i, k: swapped(F.get(a, i * 4 + k))
    bytes_of = lambda a: F.transform(F.sequence(F.lit(0), (F.size(a) / 4).cast("int") - 1), lambda i: at(a, i, F.lit(0)) * 64 + at(a, i, F.lit(1)) * 16 + at(a, i, F.lit(2)) * 4 + at(a, i, F.lit(3)))
    return F.get(F.transform(F.array(values), bytes_of), F.lit(0))


def unpacked(numbers: Column) -> Column:
    bit = lambda b, k: F.shiftright(b, k).bitwiseAND(F.lit(1))
    return F.flatten(F.transform(numbers, lambda b: F.array(*(bit(b, 7 - 2 * k) + 2 * bit(b, 6 - 2 * k) for k in range(4)))))
