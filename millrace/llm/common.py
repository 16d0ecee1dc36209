"""Helpers shared by the operators: staging, Arrow text buffers, word and shingle hashes.

Words are the maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D`` of the
UTF-8 text, with A-Z taken as a-z.  Their 64-bit hashes are computed for a whole block
of documents at once with numpy, from one running polynomial over the block's bytes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text handled by one numpy block; bounds the memory of a task, not the texts.
BLOCK_BYTES = 2_000_000
_MULT = 0x9E3779B97F4A7C15


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); one of our own only where it is unset."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("millrace.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("millrace.shared.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512, size: str = "16m") -> None:
    """Arrow batches of few rows and few bytes: a batch of very long documents must fit a Python worker.  Settings of the session, read when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    # rows that the Parquet reader decodes at once: a batch of very long texts must fit an executor
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_, name__, ... that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_MULT) + U64(seed * 2 + 1))


BYTE = seeded(256, 11) | U64(1)
_BYTE_LOWER = BYTE.copy()
_BYTE_LOWER[65:91] = BYTE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_MULT, pow(_MULT, -1, 2**64))):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """H with H[j] - H[i] = the polynomial of data[i:j], still to be divided by the power i."""
    pw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((_BYTE_LOWER if lower else BYTE)[data] * pw[: len(data)], out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, ipw = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * ipw[start])


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets, without a copy; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes each; a longer document is a block of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): the words' byte ranges, and the index of each document's first word (n+1 values)."""
    solid = ~IS_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begin[cut] = solid[cut]
    stop[cut - 1] = solid[cut - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each document's first word)."""
    start, end, first = words(data, offsets)
    return spans_hash(prefix_hash(data, lower), start, end), first


_GRAM = seeded(64, 5) | U64(1)


def shingle_hashes(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every n-word shingle, document of it); a document of 1 to n-1 words has one shingle, all its words."""
    count = np.diff(first)
    if len(word) == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    m = len(word) - n + 1
    doc = np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0))
    if m > 0:
        acc = word[:m] * _GRAM[0]
        for k in range(1, n):
            acc += word[k : k + m] * _GRAM[k]
        at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(np.maximum(count - n + 1, 0))[:-1]]), np.maximum(count - n + 1, 0)) + np.arange(len(doc))
        out = mix(acc[at]) if len(at) else np.zeros(0, U64)
    else:
        out = np.zeros(0, U64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([_short(word[first[i] : first[i + 1]]) for i in short], U64)
        out, doc = np.concatenate([out, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc


def _short(word: np.ndarray) -> int:
    acc = np.array([(word * _GRAM[: len(word)]).sum(dtype=U64)]) + U64((len(word) * 2 + 1) * _MULT % 2**64)
    return int(mix(acc)[0])


def range_shards(df: DataFrame, key: str, rows_per_shard: int, least: int = 1) -> tuple[list, int]:
    """Ascending bounds that cut ``key`` into shards of about ``rows_per_shard`` rows, ``least`` of them at least (from a quantile sketch), and their count.

    The driver holds one number for each shard, none for rows.
    """
    got = df.agg(F.count(F.lit(1)).alias("n")).first()
    n = min(max(1, got["n"]), max(least, -(-got["n"] // rows_per_shard)))
    if n == 1:
        return [], 1
    cuts = df.agg(F.percentile_approx(key, F.array([F.lit(i / n) for i in range(1, n)]), 10 * n).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    return cuts, len(cuts) + 1


def shard_of(key: str, cuts: list) -> Column:
    """The number of bounds at or below the key, by a tree of comparisons log2(n) deep; a null key is in shard 0."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(tree(0, len(cuts)))
