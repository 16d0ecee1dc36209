"""Bucketing functions with the exact boundaries of each use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket boundaries and labels.
PAIR_AGE_BUCKETS = ((0, 5), (6, 12), (13, 17), (18, 25), (26, 35), (36, 50), (51, 200))
GAP_BUCKETS = ((0, 5), (5, 10), (10, 15), (15, 25), (25, 200))
AGE_BANDS = ((18, "<18"), (30, "18-29"), (45, "30-44"))
DIGITIZE = (10, 20, 30, 40, 50, 60)


def _chain(cases: list[tuple[Column, Column]], other: Column) -> Column:
    out = F.when(*cases[0])
    for cond, value in cases[1:]:
        out = out.when(cond, value)
    return out.otherwise(other)


def pair_age_bucket(age: Column) -> Column:
    """Closed ranges; anything else is null."""
    return _chain([((age >= a) & (age <= b), F.lit(f"{a}-{b}")) for a, b in PAIR_AGE_BUCKETS], F.lit(None).cast("string"))


def gap_bucket(gap: Column) -> Column:
    """Half-open ranges; null is 'unknown', what no range holds is '25+'."""
    return _chain([(gap.isNull(), F.lit("unknown")), *[((gap >= a) & (gap < b), F.lit(f"{a}-{b}")) for a, b in GAP_BUCKETS]], F.lit("25+"))


def age_band(age: Column, unknown: str | None = None) -> Column:
    null = F.lit(unknown).cast("string")
    return _chain([(age.isNull(), null), *[(age < a, F.lit(n)) for a, n in AGE_BANDS]], F.lit("45+"))


def digitize(age: Column) -> Column:
    """The number of cut points at or below the value."""
    out = F.lit(0)
    for c in DIGITIZE:
        out = out + (age >= c).cast("int")
    return out


def retrieval_gap_bin(gap: Column) -> Column:
    return _chain([(gap.isNull(), F.lit(None).cast("string")), (gap < 1, F.lit("0")), (gap < 10, F.lit("1-9")), (gap < 20, F.lit("10-19")), (gap < 25, F.lit("20-24"))], F.lit("25+"))
