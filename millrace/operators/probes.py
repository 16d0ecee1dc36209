"""Probes and comparisons of representations, from aggregates whose size does not grow with the rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_cka(x: list[Column], y: list[Column]) -> Column:
    """An aggregate expression: |cov(x, y)|^2 / (|cov(x, x)| |cov(y, y)|), Frobenius norms."""
    norm2 = lambda a, b: sum((F.pow(F.covar_pop(p, q), F.lit(2)) for p in a for q in b[1:]), sum((F.pow(F.covar_pop(p, b[0]), F.lit(2)) for p in a[1:]), F.pow(F.covar_pop(a[0], b[0]), F.lit(2))))
    return norm2(x, y) / F.sqrt(norm2(x, x) * norm2(y, y))


def kernel_discrepancy(df: DataFrame, group: str, vec: str, dims: int, features: int = 256, bandwidths: tuple[float, ...] = (0.5, 1.0, 2.0), seed: int = 9) -> DataFrame:
    """Squared mean discrepancy under Gaussian kernels between the first group, by name, and each other one.

    A kernel is approximated by ``features`` random cosines with a fixed seed, so a group is one mean vector:
    linear in the rows, where all pairs would be quadratic.
    """
    rng = np.random.default_rng(seed)
    omega = np.concatenate([rng.standard_normal((features, dims)) / b for b in bandwidths])
    phase = rng.uniform(0, 2 * np.pi, len(omega))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, g in b.groupby(group):
                z = np.cos(np.stack(g[vec].to_numpy()) @ omega.T + phase).sum(axis=0)
                yield pd.DataFrame({"key": [str(key)] * len(z), "i": np.arange(len(z)), "v": z, "n": [len(g)] * len(z)})

    rows = df.where(F.col(group).isNotNull() & F.col(vec).isNotNull()).select(group, vec).mapInPandas(sums, "key string, i int, v double, n long")
    means = rows.groupBy("key", "i").agg((F.sum("v") / F.sum("n")).alias("m"))
    first = means.agg(F.min("key").alias("first"))
    base = means.join(F.broadcast(first), F.col("key") == F.col("first")).select("i", F.col("m").alias("m0"), "first")  # as many rows as features
    out = means.where(F.col("m").isNotNull()).join(F.broadcast(base), "i").where("key <> first")
    return out.groupBy("first", "key").agg((2 * F.sum((F.col("m") - F.col("m0")) * (F.col("m") - F.col("m0"))) / features).alias("mmd2"))


def normal_tail(z: Column) -> Column:
    """P(|N| > |z|)."""

    @F.pandas_udf("double")
    def tail(s: pd.Series) -> pd.Series:
        return s.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))

    return tail(z)


def crossfit_residual(df: DataFrame, target: str, columns: list[str], fold: str) -> DataFrame:
    """item and residual of every row under boosted trees fitted on the other folds."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    x = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):  # as many as there are folds
        model = GBTRegressor(labelCol=target, maxIter=3, maxDepth=3, seed=1).fit(x.where(F.col(fold) != k))
        part = model.transform(x.where(F.col(fold) == k)).select("item", fold, (F.col(target) - F.col("prediction")).alias("residual"))
        out = part if out is None else out.unionByName(part)
    return out


def balanced_probe(df: DataFrame, vec: str, label: str, train: Column) -> DataFrame:
    """classes and balanced accuracy of a logistic probe on the rows that are not ``train``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("features", array_to_vector(vec)).withColumn(label, F.col(label).cast("double"))
    model = LogisticRegression(labelCol=label, regParam=1e-3, maxIter=30).fit(x.where(train))
    recall = model.transform(x.where(~train)).groupBy(label).agg(F.avg((F.col("prediction") == F.col(label)).cast("int")).alias("recall"))
    return recall.agg(F.count(F.lit(1)).alias("classes"), F.avg("recall").alias("balanced_accuracy"))
