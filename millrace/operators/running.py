"""Running totals over a global order, in two levels so that no task holds all rows.

Rows are cut into buckets by a monotone function of the order; bucket totals are summed over
the few buckets, and each bucket's rows are summed within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, by: list[str], order: str, values: list[str], bucket: Column, descending: bool = False) -> DataFrame:
    """``df`` with below_<v> for each value: its sum over the rows before, in the order, within ``by``.

    ``bucket`` grows with ``order``. Rows of equal order must be one row.
    """
    key = F.desc if descending else F.asc
    df = df.withColumn("_b", bucket)
    totals = df.groupBy(*by, "_b").agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    outer = Window.partitionBy(*by).orderBy(key("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_k{c}") for c in by], F.col("_b").alias("_kb"), *[F.coalesce(F.sum(f"_t{v}").over(outer), F.lit(0)).alias(f"_o{v}") for v in values])
    inner = Window.partitionBy(*by, "_b").orderBy(key(order)).rowsBetween(Window.unboundedPreceding, -1)
    df = df.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_i{v}") for v in values])
    cond = F.col("_b").eqNullSafe(F.col("_kb"))
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k{c}"))
    out = df.join(totals, cond)
    drop = ["_b", "_kb", *[f"_k{c}" for c in by], *[f"_{p}{v}" for p in "oi" for v in values]]
    return out.select("*", *[(F.col(f"_o{v}") + F.col(f"_i{v}")).alias(f"below_{v}") for v in values]).drop(*drop)


def score_bucket(score: str, width: float = 1 / 256) -> Column:
    return F.floor(F.col(score) / F.lit(width))
