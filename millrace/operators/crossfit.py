"""Nested cross-validation and permutation importance; the driver sees sums and coefficients, never rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.models import gram_sums
from millrace.operators.running import running_sums
from millrace.operators.sampling import group_folds
from millrace.operators.verification import midranks
from millrace.session import staged

#: Components kept and ridge penalties that the inner folds choose from.
GRID = ((4, 1.0), (4, 100.0), (16, 1.0), (16, 100.0))


def prior_ridge(sums: np.ndarray, dim: int, k: int, alpha: float) -> np.ndarray:
    """Weights on (1, prior, x) from sums over rows: a line in the prior, then ridge on whitened components of x for what is left."""
    s, m = sums[: dim * dim].reshape(dim, dim), sums[dim * dim : dim * dim + dim]
    n, w = s[0, 0], np.zeros(dim)
    if n < 3:
        w[0] = m[0] / n if n else 0
        return w
    line = np.linalg.lstsq(s[:2, :2], m[:2], rcond=None)[0]
    rest, mean = (m - s[:, :2] @ line)[2:], s[0, 2:] / n
    cov = s[2:, 2:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd < 1e-9] = 1
    lam, vec = np.linalg.eigh(cov / np.outer(sd, sd))
    lam, vec = lam[::-1][:k] * n / (n - 1), vec[:, ::-1][:, :k]
    lam, vec = lam[lam > 1e-9], vec[:, lam > 1e-9]
    beta = (vec.T @ (rest / sd)) / np.sqrt(lam) / (n - 1 + alpha)  # the line leaves a mean of zero
    w[2:] = vec @ (beta / np.sqrt(lam)) / sd
    w[:2] = line
    w[0] -= w[2:] @ mean
    return w


def nested_ridge(df: DataFrame, key: str, vec: str, y: str, prior: str, group: str, outer: int = 5, inner: int = 3, grid: tuple = GRID) -> DataFrame:
    """key, y, fold, k, alpha and prediction: each outer fold predicted with the grid point whose Spearman is best over inner folds.

    Groups are dealt to outer and to inner folds by two hashes, so every training set of either level is a sum
    of ``outer * inner`` cells and one pass gives them all. A second pass scores the grid. Rows with a null in
    ``vec``, ``y`` or ``prior`` are left out; of equal grid points the first is taken.
    """
    spark = df.sparkSession
    t = df.select(key, group, F.col(y).cast("double").alias("y"), F.concat(F.array(F.col(prior).cast("double")), vec).alias("x")).where(f"y is not null and x is not null and x[0] is not null and {group} is not null")
    dealt = group_folds(t, group, outer, 7).join(group_folds(t, group, inner, 8).withColumnRenamed("fold", "inner"), group)
    t = staged(t.join(dealt, group).select(key, "y", "x", F.col("fold").cast("int").alias("fold"), F.col("inner").cast("int").alias("inner")), "folds")
    rows = gram_sums(t.withColumn("cell", F.col("fold") * inner + F.col("inner")), "x", "y", "cell").orderBy("key", "i").toPandas()
    schema = f"{key} {dict(t.dtypes)[key]}, y double, fold int, k int, alpha double, prediction double"
    if rows.empty:
        return spark.createDataFrame([], schema)
    cells = {int(c): g["v"].to_numpy() for c, g in rows.groupby("key")}
    size = len(next(iter(cells.values())))
    dim = int(round((-1 + np.sqrt(1 + 4 * (size - 1))) / 2))
    total = lambda ok: sum((v for c, v in cells.items() if ok(*divmod(c, inner))), np.zeros(size))
    tried = np.array([[[prior_ridge(total(lambda f, g: f != o and g != i), dim, *point) for point in grid] for i in range(inner)] for o in range(outer)])  # noqa: B023

    def guesses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.c_[np.ones(len(b)), np.stack(b["x"].to_numpy())]
                for o in range(outer):
                    at = (b["fold"] != o).to_numpy()
                    p = np.einsum("rd,rgd->rg", x[at], tried[o][b["inner"].to_numpy()[at]])
                    yield pd.DataFrame({"o": o, "inner": np.repeat(b["inner"].to_numpy()[at], len(grid)), "g": np.tile(np.arange(len(grid)), len(p)), "y": np.repeat(b["y"].to_numpy()[at], len(grid)), "p": p.ravel()})

    by = ["o", "inner", "g"]
    scored = t.select("y", "x", "fold", "inner").mapInPandas(guesses, "o int, inner int, g int, y double, p double")
    ranked = midranks(midranks(scored, "p", by, "rp"), "y", by, "ry")
    spearman = ranked.groupBy(*by).agg(F.corr("rp", "ry").alias("s")).groupBy("o", "g").agg(F.avg(F.coalesce(F.nanvl("s", F.lit(0.0)), F.lit(0.0))).alias("s")).collect()  # outer folds times grid
    best = {o: max((r["s"], -r["g"]) for r in spearman if r["o"] == o) for o in {r["o"] for r in spearman}}
    chosen = [-int(best[o][1]) if o in best else 0 for o in range(outer)]
    final = np.array([prior_ridge(total(lambda f, g: f != o), dim, *grid[chosen[o]]) for o in range(outer)])  # noqa: B023

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                fold = b["fold"].to_numpy()
                p = (np.c_[np.ones(len(b)), np.stack(b["x"].to_numpy())] * final[fold]).sum(axis=1)
                yield pd.DataFrame({key: b[key], "y": b["y"], "fold": fold, "k": [grid[chosen[f]][0] for f in fold], "alpha": [grid[chosen[f]][1] for f in fold], "prediction": p})

    return t.mapInPandas(predict, schema)


def shuffled_rows(t: DataFrame, key: str, columns: list[str], repeats: int) -> DataFrame:
    """``t`` once for each repeat from 1 on, with donor: the columns of the row that a seeded hash order puts in its place."""
    rows = t.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats)))).withColumn("_h", F.md5(F.concat_ws("|", "repeat", key)))
    rows = rows.withColumn("_o", F.struct("_h", key)).withColumn("_c", F.lit(1).cast("long"))
    placed = running_sums(rows, ["repeat"], "_o", ["_c"], F.substring("_h", 1, 3)).drop("_h", "_o", "_c")
    donors = placed.where("repeat = 0").select("below__c", F.struct(*columns).alias("donor"))
    return placed.where("repeat > 0").join(donors, "below__c").drop("below__c")


def permutation_importance(df: DataFrame, key: str, y: str, columns: list[str], fold: str, held: int = 0, repeats: int = 5) -> DataFrame:
    """feature, spearman_drop and std: how far shuffling a column of the held-out fold lowers Spearman, over repeats.

    ``key`` is unique. Boosted trees are fitted on the other folds; a Spearman without spread counts as 0.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    pack = VectorAssembler(inputCols=columns, outputCol="features")
    model = GBTRegressor(labelCol=y, maxIter=5, maxDepth=3, seed=1).fit(pack.transform(df.where(F.col(fold) != held)))
    t = staged(midranks(df.where(F.col(fold) == held).select(key, y, *columns), y, name="ry"), "held-out")
    variant = lambda c: F.struct(F.lit(c).alias("feature"), *[(F.col("donor")[x] if x == c else F.col(x)).alias(x) for x in columns])
    moved = shuffled_rows(t, key, columns, repeats).select("ry", "repeat", F.explode(F.array(*[variant(c) for c in columns])).alias("v")).select("ry", "repeat", "v.*")
    rows = moved.unionByName(t.select("ry", F.lit(0).alias("repeat"), F.lit("").alias("feature"), *columns))
    ranked = midranks(model.transform(pack.transform(rows)).select("ry", "repeat", "feature", "prediction"), "prediction", ["repeat", "feature"], "rp")
    s = ranked.groupBy("repeat", "feature").agg(F.coalesce(F.nanvl(F.corr("ry", "rp"), F.lit(0.0)), F.lit(0.0)).alias("s"))
    base = s.where("repeat = 0").select(F.col("s").alias("base"))
    drop = F.col("base") - F.col("s")
    return s.where("repeat > 0").crossJoin(F.broadcast(base)).groupBy("feature").agg(F.avg(drop).alias("spearman_drop"), F.stddev_pop(drop).alias("std"))  # one row
