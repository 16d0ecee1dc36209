"""Text regressors over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import staged

#: n-grams that a task takes at once; bounds its memory, not the texts.
WINDOW = 1 << 21
#: Possible n-grams of a window's alphabet up to which a table of all of them is used.
DENSE = 1 << 22


def ngram_ridge(df: DataFrame, n: int = 3, features: int = 1 << 8, ridge: float = 1.0) -> DataFrame:
    """Root mean squared error on the tenth of the rows whose hashed ids say so, of the model and of the training mean.

    Character n-grams are hashed, not looked up in a vocabulary, so no pass over the corpus collects one. Texts are read
    once; fit and error work on the counts of their n-grams by slot.
    """
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    held = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    x = df.select(held.alias("held"), F.col("target").cast("double").alias("target"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    x = staged(x.mapInArrow(gram_counts(n, features), "held boolean, target double, counts array<int>"), "grams")
    x = x.select("held", "target", array_to_vector(F.col("counts").cast("array<double>")).alias("tf"))
    x = Normalizer(inputCol="tf", outputCol="features").transform(x).drop("tf")
    train = x.where(~F.col("held"))
    model = LinearRegression(labelCol="target", regParam=ridge, maxIter=50, solver="l-bfgs").fit(train)
    mean = train.agg(F.avg("target")).first()[0] or 0.0
    out = model.transform(x.where("held"))
    e, m = F.col("prediction") - F.col("target"), F.col("target") - mean
    return out.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(m * m)).alias("rmse_mean"))


def gram_counts(n: int, features: int, window: int = WINDOW):
    """Replaces ``text`` by the counts of its character n-grams by slot, those of Spark's ``NGram`` and ``HashingTF``.

    Equal n-grams of a window are hashed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            points = np.frombuffer(("".join(texts) + "\0" * (n - 1)).encode("utf-32-le"), np.uint32)
            counts = np.zeros(len(texts) * features, np.int32)
            for first in range(0, len(points) - n + 1, window):
                last = min(first + window, len(points) - n + 1)
                lo, hi = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "left") + 1
                starts = ends[lo:hi] - sizes[lo:hi]
                cell = np.repeat(np.arange(hi - lo) * features, np.minimum(ends[lo:hi], last) - np.maximum(starts, first))
                cell += _slots(points[first : last + n - 1], n, features)
                # n-grams that would run into the next text go to a cell of their own
                tails = ends[lo:hi, None] - np.arange(1, n)
                tails = tails[(tails >= np.maximum(starts, first)[:, None]) & (tails < last)]
                cell[tails - first] = (hi - lo) * features
                counts[lo * features : hi * features] += np.bincount(cell, minlength=(hi - lo) * features + 1)[:-1].astype(np.int32)
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * features)
            yield pa.RecordBatch.from_arrays([b.column("held"), b.column("target"), pa.ListArray.from_arrays(offsets, pa.array(counts))], names=["held", "target", "counts"])

    return run


def _slots(points: np.ndarray, n: int, features: int) -> np.ndarray:
    """The slot of each n-gram of consecutive code points: joined by blanks, murmur3 of their UTF-8 bytes."""
    rank = np.zeros(0x110000, np.int32)
    rank[points] = 1
    alphabet = int(rank.sum())
    rank = np.cumsum(rank) - 1
    letters, size = rank[points], len(points) - n + 1
    code, bound = letters[:size], alphabet
    for k in range(1, n):
        if bound * alphabet >= 1 << 62:
            code, distinct = pd.factorize(code)
            bound = len(distinct)
        code, bound = code * alphabet + letters[k : k + size], bound * alphabet
    if bound > DENSE:
        code, distinct = pd.factorize(code)
        bound = len(distinct)
    place = np.full(bound, -1, np.int32)
    place[code] = np.arange(size, dtype=np.int32)
    met = np.flatnonzero(place >= 0)
    chars = points[place[met][:, None] + np.arange(n)]
    keys = [" ".join(g.tobytes().decode("utf-32-le")).encode() for g in chars]
    sizes, slots = np.array([len(k) for k in keys]), np.zeros(bound, np.int32)
    for s in np.unique(sizes):
        same = np.flatnonzero(sizes == s)
        slots[met[same]] = _murmur3(np.frombuffer(b"".join(keys[i] for i in same), np.uint8).reshape(-1, s)).astype(np.int32) % features
    return slots[code]


def _murmur3(rows: np.ndarray, seed: int = 42) -> np.ndarray:
    """32-bit murmur3 of each row of bytes."""
    size = rows.shape[1]
    turn = lambda v, r: v << np.uint32(r) | v >> np.uint32(32 - r)
    mixed = lambda k: turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = np.full(len(rows), seed, np.uint32)
    whole = size // 4 * 4
    words = np.ascontiguousarray(rows[:, :whole]).view("<u4")
    for k in range(whole // 4):
        h = turn(h ^ mixed(words[:, k]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    if size > whole:
        h = h ^ mixed(sum(rows[:, whole + k].astype(np.uint32) << np.uint32(8 * k) for k in range(size - whole)))
    h = h ^ np.uint32(size)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(by)
    return h
