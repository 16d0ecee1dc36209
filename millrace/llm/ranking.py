"""Places of rows in a global order, by ranges of the order: no task, and not the driver, sees all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm.common import fresh, partitions, staged

_LOW = (1 << 33) - 1


def placed(df: DataFrame, order: list[Column], place: str, value: str | None = None, below: str | None = None) -> DataFrame:
    """``df``, which is a table read from files, with ``place``: the number of rows before each row in ``order``.

    With ``value``, also ``below``: the sum of that column over the rows before.  Rows that are equal in
    the order stand in the order of their reading, and may be dealt to different tasks, so a key that
    very many rows share is no one task's.  The range shuffle numbers the rows of each partition; one count
    (and sum) for each partition goes through the driver.
    """
    spark = df.sparkSession
    salt, at = fresh(df, "order_salt"), fresh(df, "order_at")
    dealt = df.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order, F.col(salt)).sortWithinPartitions(*order, F.col(salt)).select(*df.columns)
    if value:
        dealt = _running(dealt, value, below)
    # partition number above 33 bits, row number within the partition below
    rows = staged(dealt.withColumn(at, F.monotonically_increasing_id()), "placed")
    part = F.shiftright(at, 33)
    sums = [F.sum(value).cast("long").alias("s")] if value else []
    offsets, n, s = [], 0, 0
    for r in sorted(rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), *sums).collect()):
        offsets.append((r["p"], n, s))
        n, s = n + r["n"], s + ((r["s"] or 0) if value else 0)
    p, first, before = (fresh(rows, c) for c in ("order_part", "order_first", "order_sum"))
    small = F.broadcast(spark.createDataFrame(offsets, f"{p} long, {first} long, {before} long"))  # one row for each partition
    out = rows.join(small, part == F.col(p))
    new = [(F.col(first) + F.col(at).bitwiseAND(F.lit(_LOW))).alias(place)]
    if value:
        new.append((F.col(before) + F.col(below)).alias(below))
    return out.select(*df.columns, *new)


def _running(df: DataFrame, value: str, below: str) -> DataFrame:
    """``df`` with ``below``: the sum of ``value`` over the rows before, in each partition as it stands; null counts as 0."""
    schema = StructType([*df.schema.fields, StructField(below, LongType())])

    def run(batches):
        total = 0
        for b in batches:
            v = b.column(value).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(v)
            yield b.append_column(below, pa.array(total + upto - v))
            total += int(upto[-1]) if len(v) else 0

    return df.mapInArrow(run, schema)
