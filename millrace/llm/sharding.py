"""Sharding along a Hilbert curve, so that a range of any of several dimensions lies in few files.

Each dimension is quantised into ``2**bits`` cells that hold about as many rows each, from the counts of
all its values; a row's cells are a point of a grid, and the Hilbert curve's index of the point
is its place in one order that keeps near points near.  Rows are dealt to ranges of that order
and cut into ``shards`` runs, by one of two laws: ``rows`` (counts at most one apart) or ``bytes``
(each row goes where the middle of its bytes falls, so a shard is off by one row's size at most).  Among rows
of one point, equal texts stand side by side.

Nothing comes together in one task: counts of values are aggregated, value ranges and rows are
placed by ranges, and the driver gets the edges of cells (``2**bits`` for each dimension) and one
count for each partition.  Rows are shuffled once.

Defined results: a null value is the lowest of its dimension; null text has no bytes and counts as empty; rows equal
in index, text checksum and ``doc_id`` stand in any order; with fewer rows than shards the
law ``rows`` spreads them; an empty table gives no rows; other columns are kept, but for those named as the results (``RESULTS``), which are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from millrace.llm.common import fresh, small_batches, staged
from millrace.llm.ranking import placed

RESULTS = ("shard_size", "shard_crc32", "shard_curve", "shard", "slot")


def cell_edges(df: DataFrame, dim: str, bits: int) -> list[tuple[object, int]]:
    """Ascending (smallest value, cell): of N rows, a value with b rows below it is in cell b * 2**bits / N, rounded down; nulls come first."""
    counts = staged(df.groupBy(dim).agg(F.count(F.lit(1)).alias("rows_n")), "values")
    n = counts.agg(F.sum("rows_n")).first()[0]
    if not n:
        return []
    below = placed(counts, [F.col(dim).asc_nulls_first()], "rows_place", "rows_n", "rows_below")
    cell = F.floor(F.col("rows_below") * (1 << bits) / n).cast("int").alias("cell")
    edges = below.where(F.col(dim).isNotNull()).groupBy(cell).agg(F.min(dim).alias("low")).collect()  # 2**bits rows at most
    return sorted((r["low"], r["cell"]) for r in edges)


def cell_of(dim: str, edges: list[tuple[object, int]]) -> Column:
    out = F.when(F.col(dim).isNull(), F.lit(0))
    for low, cell in reversed(edges):
        out = out.when(F.col(dim) >= F.lit(low), F.lit(cell))
    return out.otherwise(F.lit(0))


def hilbert_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """The index of grid points along the Hilbert curve: undo the turns of each level from the top, then read the Gray code."""
    x = np.stack([np.asarray(c, np.int64) for c in cells])
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for d in range(len(x)):
            flip = (x[d] >> level) & 1
            swap = np.where(flip, 0, (x[0] ^ x[d]) & below)
            x[0] ^= swap | np.where(flip, below, 0)
            x[d] ^= swap
    # one bit of each dimension after the other, from the top: the path's Gray code, whose running parity is the index
    index, parity = np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(len(x)):
            parity ^= (x[d] >> level) & 1
            index = index << 1 | parity
    return index


def curve(df: DataFrame, dims: list[str], bits: int) -> Column:
    """The Hilbert index of each row; the cells come from all rows of ``df``."""
    if bits * len(dims) > 62:
        raise ValueError("bits times dimensions must be 62 at most")

    @pandas_udf("long")
    def index(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([c.to_numpy() for c in cells], bits))

    return index(*[cell_of(d, cell_edges(df, d, bits)) for d in dims])


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the size of each row, its text's UTF-8 bytes and 8, and the text's checksum."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.drop(*RESULTS).select("*", (F.octet_length(text) + 8).cast("long").alias("shard_size"), F.crc32(text.cast("binary")).alias("shard_crc32"))


def assign(docs: DataFrame, dims: tuple[str, ...] = ("source", "lang", "shard_size"), shards: int = 24, bits: int = 4, law: str = "rows") -> DataFrame:
    """``docs``, a table read from files with the columns of ``measured``, with curve index, shard and gapless slot in the shard."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law}")
    docs = docs.drop(*RESULTS[2:])
    slim = staged(docs.select(*dict.fromkeys((*dims, "shard_size"))), "dims")
    n, total = slim.agg(F.count(F.lit(1)), F.sum("shard_size")).first()
    place, below = fresh(docs, "shard_place"), fresh(docs, "shard_below")
    rows = docs.withColumn("shard_curve", curve(slim, list(dims), bits))
    order = [F.col("shard_curve"), F.col("shard_crc32"), F.col("doc_id")]
    if law == "rows":
        out = placed(rows, order, place)
        shard = F.floor(F.col(place) * shards / F.lit(max(n, 1)))
    else:
        out = placed(rows, order, place, "shard_size", below)
        shard = F.least(F.lit(shards - 1), F.floor((F.col(below) + F.col("shard_size") / 2) * shards / F.lit(max(total or 1, 1))))
    out = out.withColumn("shard", shard.cast("int"))
    first = out.groupBy(F.col("shard").alias("s")).agg(F.min(place).alias("first"))
    out = out.join(F.broadcast(first), F.col("shard") == F.col("s"))  # one row for each shard
    return out.select(*docs.columns, "shard_curve", "shard", (F.col(place) - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, dims: tuple[str, ...] = ("source", "lang", "shard_size"), **options) -> DataFrame:
    """Writes ``docs``, a table read from files, as Parquet under ``path``/data, a folder for each shard, and returns the manifest, also under ``path``/manifest.

    The manifest has rows, bytes and the least and greatest value of each dimension for each shard.
    """
    spark = docs.sparkSession
    small_batches(spark)
    assign(measured(docs), dims, **options).write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/data")
    written = spark.read.parquet(f"{path}/data")
    bounds = [f(d).alias(f"{name}_{d}") for d in dims for f, name in ((F.min, "min"), (F.max, "max"))]
    holes = [F.count_if(F.col(d).isNull()).alias(f"nulls_{d}") for d in dims]
    written.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("shard_size").alias("bytes"), *bounds, *holes).coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_range(spark, path: str, **ranges: tuple[object, object]) -> DataFrame:
    """The rows whose dimensions lie in the given ranges, both ends included; only shards that can hold such rows are read."""
    manifest = spark.read.parquet(f"{path}/manifest")
    keep = F.lit(True)
    for d, (low, high) in ranges.items():
        keep = keep & (F.col(f"max_{d}") >= F.lit(low)) & (F.col(f"min_{d}") <= F.lit(high))
    shards = [r["shard"] for r in manifest.where(keep).select("shard").collect()]  # shards, not rows
    rows = spark.read.parquet(f"{path}/data").where(F.col("shard").isin(shards))
    for d, (low, high) in ranges.items():
        rows = rows.where(F.col(d).between(F.lit(low), F.lit(high)))
    return rows
