"""Governance operators: keyed pseudonyms and release checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hmac_sha256(key: str, value: Column) -> Column:
    """HMAC-SHA256 in lowercase hex, from two nested digests with the padded key as literals."""
    raw = key.encode()
    if len(raw) > 64:
        raise ValueError("the key must have 64 bytes at most")
    raw = raw.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in raw) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def release_violations(df: DataFrame, patterns: dict[str, str], columns: list[str]) -> DataFrame:
    """A row for each column and pattern that occurs in it, with the number of rows: must be empty before a release."""
    aggs = [F.count_if(F.col(c).rlike(p)).alias(f"{c}|{name}") for c in columns for name, p in patterns.items()]
    out = df.agg(*aggs).unpivot([], [f"`{c}|{n}`" for c in columns for n in patterns], "check_name", "violations")
    return out.where("violations > 0")
