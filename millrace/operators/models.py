"""Tabular models whose fits are aggregates or Spark ML estimators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.replicates import interval, sums_by_replicate
from millrace.operators.sampling import hash_key
from millrace.session import staged


def platt(df: DataFrame) -> DataFrame:
    """Coefficients of logistic calibrators fitted on the training split: score alone, and score, gap and their product."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    t = df.where("split_a = 'train'").select("y", "score", F.col("gap").cast("double").alias("gap"), (F.col("score") * F.col("gap")).alias("cross"))
    rows = []
    for name, cols in (("score", ["score"]), ("attribute_aware", ["score", "gap", "cross"])):
        x = VectorAssembler(inputCols=cols, outputCol="features").transform(t)
        m = LogisticRegression(labelCol="y", regParam=1e-4, maxIter=50).fit(x)
        rows += [(name, c, float(w)) for c, w in zip(["intercept", *cols], [m.intercept, *m.coefficients], strict=True)]
    return df.sparkSession.createDataFrame(rows, "model string, term string, weight double")


def stratum_logistic(df: DataFrame, stratum: str, x: str, y: str, cells: int = 200, rounds: int = 30) -> DataFrame:
    """Slope and intercept by stratum from counts of rounded scores, so a group is at most ``cells`` rows whatever its size.

    Strata of under ten rows or one class get nulls.
    """
    cell = F.round(F.col(x) * (cells / 2)) / (cells / 2)
    binned = df.groupBy(stratum, cell.alias("x")).agg(F.sum(y).alias("p"), F.count(F.lit(1)).alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, p, n = (pdf[c].to_numpy(float) for c in ("x", "p", "n"))
        out = {stratum: [pdf[stratum].iloc[0]], "n": [int(n.sum())], "slope": [None], "intercept": [None]}
        if n.sum() >= 10 and 0 < p.sum() < n.sum():
            b = np.zeros(2)
            design = np.stack([np.ones_like(x), x], 1)
            for _ in range(rounds):
                mu = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
                h = design.T @ (design * (n * mu * (1 - mu))[:, None]) + 1e-6 * np.eye(2)
                b = b + np.clip(np.linalg.solve(h, design.T @ (p - n * mu)), -5, 5)
            out |= {"slope": [float(b[1])], "intercept": [float(b[0])]}
        return pd.DataFrame(out)

    kind = dict(df.dtypes)[stratum]
    return binned.groupBy(stratum).applyInPandas(fit, f"{stratum} {kind}, n long, slope double, intercept double")


def pca_composite(daily: DataFrame) -> DataFrame:
    """Scores of the first component; the 3 x 3 correlation matrix is one aggregate."""
    r = daily.select("user_id", "day", *[F.log((F.col(c) + 1) / (F.col("views") + 1)).alias(c) for c in ("likes", "comments", "reposts")])
    cols = ["likes", "comments", "reposts"]
    s = r.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols], *[F.corr(a, b).alias(f"c_{a}_{b}") for a in cols for b in cols]).first()
    if s[f"m_{cols[0]}"] is None:
        return r.select("user_id", "day", F.lit(0.0).alias("composite"))
    corr = np.array([[s[f"c_{a}_{b}"] if s[f"c_{a}_{b}"] is not None else float(a == b) for b in cols] for a in cols])
    w = np.linalg.eigh(corr)[1][:, -1]
    w = w * (1 if w[0] >= 0 else -1)
    z = [(F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] + 1e-9) * float(k) for c, k in zip(cols, w, strict=True)]
    return r.select("user_id", "day", (z[0] + z[1] + z[2]).alias("composite"))


def kmeans_profile(df: DataFrame, key: str, vec: str, y: str, profile: list[str], ks: tuple[int, ...] = (3, 4, 5, 6, 7, 8), sample: int = 5_000, seed: int = 3, draws: int = 1_000) -> DataFrame:
    """For each cluster its size, mean of ``y`` with a bootstrap interval, and means of ``profile``; k has the best silhouette.

    As many clusters are chosen on the ``sample`` rows that come first in a seeded hash order; the clusters are
    fitted on all rows. With no more rows than the smallest k there is one cluster.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    x = df.select(key, y, *profile, vec).where(F.col(vec).isNotNull()).withColumn("features", array_to_vector(vec))
    few = staged(df.select(key, vec).where(F.col(vec).isNotNull()).orderBy(hash_key(key, seed), key).limit(sample), "sample").withColumn("features", array_to_vector(vec))
    n = few.count()
    ks = [k for k in ks if k < n]
    silhouette = {k: ClusteringEvaluator().evaluate(KMeans(k=k, seed=seed, maxIter=10).fit(few).transform(few)) for k in ks}
    k = max(silhouette, key=silhouette.get) if ks else 1
    found = KMeans(k=k, seed=seed, maxIter=20).fit(x).transform(x) if ks else x.withColumn("prediction", F.lit(0))
    rows = staged(found.select(key, F.col(y).cast("double").alias(y), *profile, F.col("prediction").alias("cluster")), "clustered")
    inside = lambda c, v: F.when((F.col("cluster") == c) & F.col(y).isNotNull(), v)
    sums = sums_by_replicate(rows, [inside(c, v) for c in range(k) for v in (F.col(y), F.lit(1.0))], draws, [F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))])
    drawn = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cluster"), F.when(F.col(f"s{2 * c + 1}") > 0, F.col(f"s{2 * c}") / F.col(f"s{2 * c + 1}")).alias("v")) for c in range(k)])).alias("r")).select("r.*")
    size = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias(y), *[F.avg(c).alias(c) for c in profile])
    return size.join(interval(drawn, "cluster").select("cluster", "lo", "hi"), "cluster", "left").withColumn("silhouette", F.lit(silhouette.get(k)).cast("double"))


def gram_sums(df: DataFrame, vec: str, y: str, by: str) -> DataFrame:
    """Partial sums of x x', x y, y and n for each key and batch, added up by Spark."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, g in b.groupby(by):
                x = np.stack(g[vec].to_numpy()).astype(float)
                x = np.concatenate([np.ones((len(x), 1)), x], 1)
                t = g[y].to_numpy(float)
                a = np.concatenate([(x.T @ x).ravel(), x.T @ t, [t @ t]])
                yield pd.DataFrame({"key": [int(key)] * len(a), "i": np.arange(len(a)), "v": a})

    return df.select(by, vec, F.col(y).cast("double").alias(y)).mapInPandas(partial, "key long, i long, v double").groupBy("key", "i").agg(F.sum("v").alias("v"))


def ridge_probe(df: DataFrame, vec: str, y: str, fold: str, alpha: float = 1.0) -> DataFrame:
    """Mean absolute error on each fold of a ridge fitted on the others, and of their mean; D x D sums only reach the driver."""
    rows = gram_sums(df, vec, y, fold).orderBy("key", "i").toPandas()
    if rows.empty:
        return df.sparkSession.createDataFrame([], "fold long, mae double, mae_mean double")
    stats = {k: g["v"].to_numpy() for k, g in rows.groupby("key")}
    dim = int(round((-1 + np.sqrt(1 + 4 * (len(next(iter(stats.values()))) - 1))) / 2))
    total, out = sum(stats.values()), None
    for k, own in stats.items():
        rest = total - own
        gram, moment = rest[: dim * dim].reshape(dim, dim), rest[dim * dim : dim * dim + dim]
        penalty = alpha * np.eye(dim)
        penalty[0, 0] = 0
        b = np.linalg.lstsq(gram + penalty, moment, rcond=None)[0]
        mean = float(moment[0] / max(gram[0, 0], 1))
        guess = F.aggregate(F.zip_with(F.col(vec), F.array(*[F.lit(float(w)) for w in b[1:]]), lambda p, q: p * q), F.lit(float(b[0])), lambda s, p: s + p)
        part = df.where(F.col(fold) == k).agg(F.lit(int(k)).cast("long").alias("fold"), F.avg(F.abs(F.col(y) - guess)).alias("mae"), F.avg(F.abs(F.col(y) - mean)).alias("mae_mean"))
        out = part if out is None else out.unionByName(part)
    return out


def overlap_weights(df: DataFrame, arm: str, columns: list[str]) -> DataFrame:
    """Effective size and mean propensity by arm under overlap weights from cross-fitted logistic models."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    folds = sorted(r[0] for r in df.select("fold").distinct().collect())  # as many as there are folds
    out = None
    for k in folds:
        m = LogisticRegression(labelCol=arm, regParam=1e-3, maxIter=30).fit(x.where(F.col("fold") != k))
        part = m.transform(x.where(F.col("fold") == k)).select(arm, vector_to_array("probability")[1].alias("e"))
        out = part if out is None else out.unionByName(part)
    w = F.when(F.col(arm) == 1, 1 - F.col("e")).otherwise(F.col("e"))
    return out.withColumn("w", w).groupBy(arm).agg(F.count(F.lit(1)).alias("n"), (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("ess"), F.avg("e").alias("propensity"))


def bayesian_head(df: DataFrame, by: str, vec: str, y: str, dims: int, ridge: float = 1.0) -> DataFrame:
    """Posterior mean of a linear head by key; its sums are built-in aggregates, its solve is on dims x dims numbers."""
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    s = df.groupBy(by).agg(*[F.sum(F.col(vec)[i] * F.col(vec)[j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(F.col(vec)[i] * F.col(y)).alias(f"b{i}") for i in range(dims)], F.count(F.lit(1)).alias("n"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            means = []
            for _, r in b.iterrows():
                a = ridge * np.eye(dims)
                for i, j in pairs:
                    a[i, j] += r[f"g{i}_{j}"]
                    if i != j:
                        a[j, i] += r[f"g{i}_{j}"]
                means.append(np.linalg.solve(a, np.array([r[f"b{i}"] for i in range(dims)], float)).tolist())
            yield pd.DataFrame({by: b[by], "n": b["n"], "mean": means})

    return s.mapInPandas(solve, f"{by} {dict(df.dtypes)[by]}, n long, mean array<double>")


#: Up to so many players the fixed point is found on the driver, from one count for each pair of them; beyond, by joins.
DRIVER_PLAYERS = 500


def bradley_terry(games: DataFrame, rounds: int = 200, tol: float = 1e-6) -> DataFrame:
    """player and strength (mean 1) from rows (w, l), by the minorise-maximise fixed point.

    A player without a win keeps the strength of the round before, up to the scaling. Rows with a null or equal ends do not count.
    """
    counts = staged(games.where("w is not null and l is not null and w <> l").groupBy("w", "l").agg(F.count(F.lit(1)).alias("n")), "games")
    players = counts.select(F.explode(F.array("w", "l")).alias("player")).distinct()
    if players.limit(DRIVER_PLAYERS + 1).count() > DRIVER_PLAYERS:
        return _strengths_by_joins(counts, rounds, tol)
    spark, kind = games.sparkSession, dict(games.dtypes)["w"]
    names = sorted(r[0] for r in players.collect())
    if not names:
        return spark.createDataFrame([], f"player {kind}, strength double")
    at = {p: i for i, p in enumerate(names)}
    wins = np.zeros((len(names),) * 2)
    for r in counts.collect():
        wins[at[r["w"]], at[r["l"]]] += r["n"]
    total, s = wins + wins.T, np.ones(len(names))
    for _ in range(rounds):
        new = wins.sum(axis=1) / np.maximum((total / (s[:, None] + s[None, :])).sum(axis=1), 1e-12)
        new = np.where(new > 0, new, s)
        new /= new.mean()
        if np.allclose(new, s, rtol=tol):
            s = new
            break
        s = new
    return spark.createDataFrame([(p, float(v)) for p, v in zip(names, s, strict=True)], f"player {kind}, strength double")


def _strengths_by_joins(counts: DataFrame, rounds: int, tol: float) -> DataFrame:
    """The same fixed point with a row for each player: a round joins the opponents' strengths to the games and sums them up."""
    both = counts.unionByName(counts.select(F.col("l").alias("w"), F.col("w").alias("l"), "n"))
    games = staged(both.groupBy(F.col("w").alias("player"), F.col("l").alias("other")).agg(F.sum("n").alias("n")), "pairs")
    wins = counts.groupBy(F.col("w").alias("player")).agg(F.sum("n").alias("wins"))
    s = staged(games.select("player").distinct().join(wins, "player", "left").na.fill(0, ["wins"]).withColumn("strength", F.lit(1.0)), "strengths")
    for _ in range(rounds):
        theirs = s.select(F.col("player").alias("other"), F.col("strength").alias("theirs"))
        mine = games.join(s, "player").join(theirs, "other")
        sums = mine.groupBy("player").agg(F.sum(F.col("n") / (F.col("strength") + F.col("theirs"))).alias("d"), F.first("strength").alias("old"), F.first("wins").alias("wins"))
        new = staged(sums.select("player", "wins", "old", F.when(F.col("wins") > 0, F.col("wins") / F.greatest("d", F.lit(1e-12))).otherwise(F.col("old")).alias("strength")), "strengths")
        mean = new.agg(F.avg("strength")).first()[0]
        new = new.withColumn("strength", F.col("strength") / mean)
        still = new.where(F.abs(F.col("strength") - F.col("old")) > 1e-8 + tol * F.abs("old")).limit(1).count()
        s = new.select("player", "wins", "strength")
        if not still:
            break
    return s.select("player", "strength")
