"""A Bayesian linear head for each key: batch posterior, online updates of a stream, predictive mean and variance.

The posterior's precision is prior_precision * I + sum of w x x' / noise, its moment the sum of w x y / noise.  Both are sums, so
a batch, any cut of a stream into micro-batches, and any order give the same state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Head:
    """``dims`` inputs; a new key's weights have mean 0 and variance 1 / prior_precision; observations have variance ``noise``."""

    dims: int
    prior_precision: float = 1.0
    noise: float = 1.0

    def schema(self, key: str, kind: str) -> str:
        return f"{key} {kind}, n long, precision array<double>, moment array<double>"


def partial_sums(df: DataFrame, head: Head, key: str, vec: str, y: str, weight: str | None = None) -> DataFrame:
    """key, n, precision and moment sums without the prior, one row for each key of an Arrow batch: what a hot key sends on is small.

    Rows with a null key, vector, target or weight, or with another number of components, are left out.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(key).alias(key), F.col(vec).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), w.alias("w"))
    rows = rows.where(F.col(key).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull()).where((F.size("x") == head.dims) & F.forall("x", lambda c: c.isNotNull()))
    noise = head.noise

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, at in b.groupby(key, sort=False).indices.items():
                x, part = np.stack(b["x"].to_numpy()[at]), b.iloc[at]
                wx = x * (part["w"].to_numpy() / noise)[:, None]
                out.append((k, len(at), (wx.T @ x).ravel().tolist(), (wx.T @ part["y"].to_numpy()).tolist()))
            yield pd.DataFrame(out, columns=[key, "n", "precision", "moment"])

    return rows.mapInPandas(run, head.schema(key, dict(rows.dtypes)[key]))


def batch_posterior(df: DataFrame, head: Head, key: str, vec: str, y: str, weight: str | None = None) -> DataFrame:
    """key, n, precision and moment of all rows."""
    d, parts = head.dims, partial_sums(df, head, key, vec, y, weight)
    sums = [F.sum(F.col("precision")[i]) for i in range(d * d)] + [F.sum(F.col("moment")[i]) for i in range(d)]
    s = parts.groupBy(key).agg(F.sum("n").alias("n"), F.array(*sums).alias("s"))
    prior = F.array(*[F.lit(head.prior_precision if i % (d + 1) == 0 else 0.0) for i in range(d * d)])
    return s.select(key, "n", F.zip_with(F.slice("s", 1, d * d), prior, lambda a, b: a + b).alias("precision"), F.slice("s", d * d + 1, d).alias("moment"))


class HeadState(StatefulProcessor):
    """Keeps n, precision and moment of a key and adds partial sums to them."""

    def __init__(self, head: Head, key: str) -> None:
        self.head, self.key = head, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("head", "n long, precision array<double>, moment array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = self.head.dims
        if self.state.exists():
            n, precision, moment = self.state.get()
            precision, moment = np.array(precision), np.array(moment)
        else:
            n, precision, moment = 0, self.head.prior_precision * np.eye(d).ravel(), np.zeros(d)
        for part in rows:
            n += int(part["n"].sum())
            precision = precision + np.stack(part["precision"].to_numpy()).sum(axis=0)
            moment = moment + np.stack(part["moment"].to_numpy()).sum(axis=0)
        self.state.update((n, precision.tolist(), moment.tolist()))
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "precision": [precision.tolist()], "moment": [moment.tolist()]})

    def close(self) -> None:
        pass


def update_stream(stream: DataFrame, head: Head, root: str, key: str, vec: str, y: str, weight: str | None = None) -> None:
    """Works off what is new in ``stream``; state and progress are kept under ``root``, so a later call, or one after a crash, goes on from there.

    Each micro-batch leaves the heads it changed in a folder of its own number, which a repeated batch replaces.
    """
    spark = stream.sparkSession
    parts = partial_sums(stream, head, key, vec, y, weight)
    heads = parts.groupBy(key).transformWithStateInPandas(HeadState(head, key), head.schema(key, dict(parts.dtypes)[key]), "Update", "None")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/heads/epoch={epoch}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query keeps the provider that it starts with
    try:
        q = heads.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    q.awaitTermination()


def heads(spark: SparkSession, root: str, head: Head, key: str, kind: str) -> DataFrame:
    """The last state of every key that ``update_stream`` has written under ``root``."""
    rows = spark.read.option("basePath", f"{root}/heads").schema(head.schema(key, kind) + ", epoch long").parquet(f"{root}/heads")
    return rows.groupBy(key).agg(F.max_by(F.struct("n", "precision", "moment"), "epoch").alias("s")).select(key, "s.*")


def solved(state: DataFrame, head: Head) -> DataFrame:
    """``state`` with the posterior's ``mean`` and ``covariance`` (flat), one small solve for each key."""
    d, fields = head.dims, state.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cov = [np.linalg.inv(np.array(p).reshape(d, d)) for p in b["precision"]]
            yield b[fields].assign(mean=[(c @ m).tolist() for c, m in zip(cov, b["moment"])], covariance=[c.ravel().tolist() for c in cov])

    types = dict(state.dtypes)
    return state.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in fields) + ", mean array<double>, covariance array<double>")


def predict(rows: DataFrame, state: DataFrame, head: Head, key: str, vec: str) -> DataFrame:
    """``rows`` with head_mean and head_variance: the predictive mean and variance at ``vec``; a key without a state has the prior's."""
    s = solved(state, head).select(F.col(key).alias("_key"), "mean", "covariance")
    x, d = F.col(vec), head.dims
    out = rows.join(s, F.col(key) == F.col("_key"), "left")
    mean = F.coalesce(sum((x[i] * F.col("mean")[i] for i in range(1, d)), x[0] * F.col("mean")[0]), F.lit(0.0))
    known = F.aggregate(F.sequence(F.lit(0), F.lit(d * d - 1)), F.lit(0.0), lambda a, i: a + F.get(F.col("covariance"), i) * F.get(x, (i / d).cast("int")) * F.get(x, i % d))
    prior = F.aggregate(x, F.lit(0.0), lambda a, c: a + c * c / head.prior_precision)
    return out.select(*rows.columns, mean.alias("head_mean"), (F.coalesce(known, prior) + head.noise).alias("head_variance"))
