"""Exact quantiles and positions in two levels, so that no task buffers a whole group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.running import running_sums, score_bucket


def quantiles(df: DataFrame, value: str, points: list[float], by: list[str] | None = None, width: float = 1 / 256, name: str = "q") -> DataFrame:
    """``by`` and the array ``name``: the linearly interpolated quantiles of ``value`` at ``points`` (0 to 1).

    Rows become counts of equal values, their running totals come bucket by bucket (buckets of ``width``),
    and each point takes the two values that stand at its rank.  Null values are left out; a group that has only nulls
    is absent, and without ``by`` an empty table gives one row of nulls.
    """
    by = by or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    run = running_sums(counted, by, value, ["_c"], score_bucket(value, width))
    totals = counted.groupBy(*[F.col(c).alias(f"_g{c}") for c in by]).agg(F.sum("_c").alias("_n"))
    if by:
        cond = F.lit(True)
        for c in by:
            cond = cond & F.col(c).eqNullSafe(F.col(f"_g{c}"))
        run = run.join(totals, cond)
    else:
        run = run.crossJoin(F.broadcast(totals))  # one row
    below, end = F.col("below__c"), F.col("below__c") + F.col("_c")
    at = lambda rank: F.max(F.when((below <= rank) & (rank < end), F.col(value).cast("double")))
    place = [F.lit(float(p)) * (F.col("_n") - 1) for p in points]
    # both values of a point, and how far it is from the first to the second
    picked = run.groupBy(*by).agg(*[x for i, h in enumerate(place) for x in (at(F.floor(h)).alias(f"_l{i}"), at(F.ceil(h)).alias(f"_h{i}"), F.max(h - F.floor(h)).alias(f"_f{i}"))])
    value_at = lambda i: F.col(f"_l{i}") + F.col(f"_f{i}") * (F.col(f"_h{i}") - F.col(f"_l{i}"))
    return picked.select(*by, F.array(*map(value_at, range(len(points)))).alias(name))


def positions(df: DataFrame, by: list[str], order: list[Column], bucket: Column, name: str = "position") -> DataFrame:
    """``df`` with the place of each row, from 0, in ``order`` within ``by``; ``bucket`` grows with the order, which has no ties."""
    one = df.withColumn("_order", F.struct(*order)).withColumn("_one", F.lit(1).cast("long"))
    return running_sums(one, by, "_order", ["_one"], bucket).withColumnRenamed("below__one", name).drop("_order", "_one")
