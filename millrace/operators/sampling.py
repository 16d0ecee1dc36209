"""Deterministic sampling and splits in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.running import running_sums


def hash_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def hash_priority(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with position: its place, from 1, in the order of a seeded hash of ``key`` (two-level, no global sort)."""
    rows = df.withColumn("_h", hash_key(key, seed)).withColumn("_o", F.struct("_h", key)).withColumn("_c", F.lit(1).cast("long"))
    out = running_sums(rows, [], "_o", ["_c"], F.substring("_h", 1, 3))
    return out.withColumn("position", F.col("below__c") + 1).drop("_h", "_o", "_c", "below__c")


def group_folds(df: DataFrame, group: str, folds: int, seed: int) -> DataFrame:
    """group and fold: groups dealt to folds in hash order, so no group is in two folds."""
    g = hash_priority(df.select(group).distinct(), group, seed)
    return g.select(group, ((F.col("position") - 1) % folds).alias("fold"))


def hash_sample(df: DataFrame, key: str, strata: list[str], n: int, seed: int) -> DataFrame:
    """The ``n`` rows of each stratum whose hashes are smallest, with their inclusion probability.

    Rank limits are pushed below the shuffle by Spark's window group limit, so a large stratum sends n rows for each task.
    """
    total = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    ranked = df.withColumn("_h", hash_key(key, seed)).withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy("_h", key))).where(F.col("_r") <= n)
    return ranked.join(total, strata).withColumn("probability", F.least(F.lit(n), F.col("_n")) / F.col("_n")).drop("_h", "_r", "_n")
