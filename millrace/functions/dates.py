"""Dates and epochs that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def iso_day(seconds: Column) -> Column:
    """yyyy-MM-dd of epoch seconds in UTC; null stays null."""
    return F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(seconds / 86400).cast("int")).cast("string")
