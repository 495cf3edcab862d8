"""Vector kernels as column expressions; everything is computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    """An array<float> as array<double>; products of floats would lose digits."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null when the sizes differ, as zip_with pads with null."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, eps: float = 0.0, clip: bool = False) -> Column:
    """dot / (|a||b| + eps); 0 where a norm is 0; clip cuts negative values to 0."""
    den = norm(a) * norm(b)
    out = F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(den == 0, F.lit(1.0)).otherwise(den + F.lit(eps)))
    return F.greatest(out, F.lit(0.0)) if clip else out


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """v / |v|; the zero vector stays as it is."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n == 0, x).otherwise(x / F.when(n == 0, F.lit(1.0)).otherwise(n)))


def online_centroid(c: Column, x: Column, n: Column) -> Column:
    """The mean of n vectors from the mean c of the n-1 before and the n-th, x."""
    return F.zip_with(doubles(c), doubles(x), lambda a, b: (a * (n - 1) + b) / n)
