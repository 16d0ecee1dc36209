"""Vector arithmetic on ARRAY<DOUBLE> columns, inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda v: v / n)).otherwise(a)


def centroid(df: DataFrame, vec: str, dims: int, *by: str) -> DataFrame:
    """Mean vector by key: one average for each dimension, combined before the shuffle."""
    means = df.groupBy(*by).agg(*[F.avg(F.col(vec)[i]).alias(f"_{i}") for i in range(dims)], F.count(F.lit(1)).alias("n"))
    return means.select(*by, F.array(*[F.col(f"_{i}") for i in range(dims)]).alias("centroid"), "n")


def add_all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
