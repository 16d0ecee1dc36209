"""Importance resampling to a target distribution, over hashed n-grams found with word-id suffix arrays.

A block of texts becomes a sequence of word ids (exact, by a dictionary of the block's words).
Its suffixes are sorted by their first ``max_n`` words - no order beyond that is ever looked
at - and the common prefixes of neighbours cut the order into runs: the suffixes of a run
begin with the same n-gram.  Each run is hashed once, from the hash of its first n - 1 words, and
its bucket is scattered back to the places where the n-gram occurs.  Counts of buckets of the corpus
and of the target give every bucket a gain, 1000 times the logarithm of the ratio of its
smoothed shares; a document's weight is the mean gain of its features, and the weight
with Gumbel noise drawn from the document's id orders the documents for a draw without replacement.

Two passes over the texts, no shuffle of texts: a task adds its counts up before they leave it (``n_buckets``
rows at most), and the gains, as many numbers, are sent to every task.  A text longer than a block is
worked off in pieces cut between words.  The draw finds its lowest score from the counts of
the scores - whole numbers of a bounded range, some ten thousands - and places only the rows from
there on, by ranges.

Defined results: a null text has no words, a text without words has weight 0; a null ``doc_id``
draws its noise as the id ``null`` and comes last among equal scores; rows that repeat a ``doc_id`` are
drawn one by one; an empty corpus gives no rows, an empty target leaves all gains to the smoothing; other columns are kept, but for
those named as this module's, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm.common import BLOCK_BYTES, blocks, small_batches, staged, text_buffer, words
from millrace.llm.ranking import placed

COLUMNS = ("importance_words", "importance_features", "importance_weight", "importance_score")
#: What each byte counts as: letters and digits of ASCII in lower case and all bytes above ASCII, else a space.
FOLD = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    FOLD[_a:_b] = np.arange(_a, _b)
FOLD[65:91] = np.arange(97, 123)


def suffix_order(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes, by their first ``depth`` words (prefix doubling); ``left`` counts the words from each place to its document's end."""
    rank, k = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        after = np.full(len(rank), -1, np.int64)
        after[:-k] = rank[k:]
        after[left <= k] = -1
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        new = np.cumsum(np.r_[False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        rank = np.empty_like(rank)
        rank[order] = new
        k *= 2
    return order


def common_prefixes(ids: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many words, up to ``depth``, each suffix of the order shares with the one before it."""
    out = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    for k in range(depth):
        a, b = order[at - 1], order[at]
        at = at[(left[a] > k) & (left[b] > k)]
        a, b = order[at - 1] + k, order[at] + k
        at = at[ids[a] == ids[b]]
        out[at] = k + 1
    return out


def gram_buckets(ids: np.ndarray, left: np.ndarray, names: list[bytes], max_n: int, n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, ...: the places where an n-gram begins, and its bucket."""
    order = suffix_order(ids, left, max_n)
    shared = common_prefixes(ids, left, order, max_n)
    crc = run = None
    for n in range(1, max_n + 1):
        new = shared < n
        new[:1] = True
        head = np.flatnonzero(new)
        head = head[left[order[head]] >= n]
        last = [names[i] for i in ids[order[head] + n - 1]]
        if n == 1:
            hashed = [crc32(w) for w in last]
        else:
            hashed = [crc32(b" " + w, c) for w, c in zip(last, crc[run[head]].tolist())]
        start = np.zeros(len(order), bool)
        start[head] = True
        run = np.cumsum(start) - 1
        crc = np.array(hashed, np.int64)
        whole = np.flatnonzero(left[order] >= n)
        yield order[whole], crc[run[whole]] % n_buckets


def _pieces(data: np.ndarray, offsets: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first document, folded bytes, their offsets, words that an earlier piece has counted)."""
    for i, j in blocks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * BLOCK_BYTES:
            yield i, FOLD[data[lo:hi]], offsets[i : j + 1] - lo, 0
            continue
        done = 0
        while lo < hi:
            end = min(hi, lo + BLOCK_BYTES)
            while end < hi and FOLD[data[end]] != 32:  # a word is never cut
                gap = np.flatnonzero(FOLD[data[end : end + BLOCK_BYTES]] == 32)
                end = end + int(gap[0]) if len(gap) else min(hi, end + BLOCK_BYTES)
            part = FOLD[data[lo:end]]
            yield i, part, np.array([0, len(part)]), done
            start, _, _ = words(part, np.array([0, len(part)]))
            done = min(max_n - 1, len(start))
            lo = lo + int(start[len(start) - done]) if done and end < hi else end
            if done and end < hi and lo + BLOCK_BYTES <= end:  # the words kept alone fill a block: the rest is one piece
                part = FOLD[data[lo:hi]]
                yield i, part, np.array([0, len(part)]), done
                break


def features(data: np.ndarray, offsets: np.ndarray, max_n: int, n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(document of each feature, its bucket, n) for each block and n."""
    for i, folded, at, done in _pieces(data, offsets, max_n):
        start, end, first = words(folded, at)
        if not len(start):
            continue
        letters = folded[folded != 32]
        cuts = np.r_[0, np.cumsum(end - start)].astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(letters)]).dictionary_encode()
        ids, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
        left = first[doc + 1] - np.arange(len(ids))
        for n, (place, bucket) in enumerate(gram_buckets(ids, left, names, max_n, n_buckets), 1):
            if done:
                new = place + n - 1 >= done
                place, bucket = place[new], bucket[new]
            yield i + doc[place], bucket, n


def bucket_counts(docs: DataFrame, max_n: int = 2, n_buckets: int = 10_000) -> np.ndarray:
    """How many features of the texts are in each bucket."""
    small_batches(docs.sparkSession)

    def run(batches):
        total = np.zeros(n_buckets, np.int64)
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            for _, bucket, _ in features(data, offsets, max_n, n_buckets):
                total += np.bincount(bucket, minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_buckets, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 * ln of the ratio of smoothed shares for each bucket, floored."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def score(docs: DataFrame, gain: np.ndarray, max_n: int = 2, seed: int = 2024) -> DataFrame:
    """``docs`` with the columns of ``COLUMNS``: words, features, mean gain, and the gain with noise."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(*COLUMNS)
    schema = StructType([*docs.schema.fields, *[StructField(c, LongType()) for c in COLUMNS[:3]]])
    shared = spark.sparkContext.broadcast(gain)  # n_buckets numbers

    def run(batches):
        g = shared.value
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            n_words, n_features, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for doc, bucket, n in features(data, offsets, max_n, len(g)):
                count = np.bincount(doc, minlength=b.num_rows)
                n_features += count
                if n == 1:
                    n_words += count
                total += np.bincount(doc, weights=g[bucket], minlength=b.num_rows).astype(np.int64)
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            for name, values in zip(COLUMNS, (n_words, n_features, weight)):
                b = b.append_column(name, pa.array(values))
            yield b

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return docs.mapInArrow(run, schema).withColumn(COLUMNS[3], F.col("importance_weight") + noise)


def drawn(scored: DataFrame, percent: int = 10, min_words: int = 20, rank: str = "importance_rank") -> DataFrame:
    """``scored``, a table read from files, with ``rank``: 1, 2, 3, ... of the rows drawn, the highest scores first; else null.

    Of the N rows with ``min_words`` words or more, percent * N / 100 are drawn, rounded down.
    """
    scored = scored.drop(rank)
    counts = scored.where(F.col("importance_words") >= min_words).groupBy("importance_score").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("importance_score", ascending=False)
    above = counts["n"].cumsum()
    quota = percent * int(counts["n"].sum()) // 100
    null = F.lit(None).cast("long").alias(rank)
    if not quota:
        return scored.select("*", null)
    lowest = int(counts["importance_score"][above >= quota].iloc[0])
    near = (F.col("importance_words") >= min_words) & (F.col("importance_score") >= lowest)
    order = [F.col("importance_score").desc(), F.col("doc_id").asc_nulls_last(), F.col("importance_weight").asc(), F.col("importance_features").asc()]
    first = placed(scored.where(near), order, rank)
    place = F.col(rank) + 1
    first = first.select(*scored.columns, F.when(place <= quota, place).alias(rank))
    return first.unionByName(scored.where(~near).select("*", null))


def fit(docs: DataFrame, target: DataFrame, max_n: int = 2, n_buckets: int = 10_000) -> np.ndarray:
    """The gain of each bucket."""
    return gains(bucket_counts(docs, max_n, n_buckets), bucket_counts(target, max_n, n_buckets))


def ranked(docs: DataFrame, target: DataFrame, max_n: int = 2, n_buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """Every row's id with its counts, weight, score and rank; texts are not carried along."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = staged(score(slim, fit(docs, target, max_n, n_buckets), max_n, seed).drop("text"), "importance")
    return drawn(out, percent, min_words)


def resample(docs: DataFrame, target: DataFrame, max_n: int = 2, n_buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """The rows of ``docs`` that the draw takes, with their columns."""
    columns = [c for c in docs.columns if c not in (*COLUMNS, "importance_rank")]
    out = drawn(staged(score(docs, fit(docs, target, max_n, n_buckets), max_n, seed), "importance"), percent, min_words)
    return out.where("importance_rank is not null").select(*columns, *COLUMNS, "importance_rank")
