"""Quality classifier: nearest-neighbour voting in a latent semantic space.

A text becomes a sparse vector of hashed features: its words (A-Z as a-z), the shapes of its
words, and how often a word repeats its predecessor; square roots of relative
frequencies, so that a document's length does not matter.  A truncated SVD of at most
``max_train`` labelled texts gives the latent space (randomised range finder, fixed seed).
The labelled vectors and the projection are broadcast - their size is fixed by
``max_train``, ``dims`` and the hash ranges, whatever the corpus - and every document is
compared with all labelled vectors in exact blocked products.  Its score is the mean label
of its ``k`` nearest ones, weighted by the fourth power of the cosine similarity (0 where it is negative), so that the nearest ones
decide where few rows of a label are known; of equally near ones those with the smaller ``doc_id`` come first.

Defined results: null text counts as empty; a text without words scores the labels' mean;
without any usable label every score is 0.5; with few rows of a label k falls to their number; several labels of one document count as the
smallest; of rows that repeat a labelled ``doc_id`` one is learned from, the text that hashes
lowest; a null ``doc_id`` is allowed; a text of any length is taken whole; an empty table gives no rows; other columns are kept, but for one named as the score is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.llm.common import U64, blocks, prefix_hash, seeded, small_batches, spans_hash, text_buffer, words

WORD_BUCKETS, SHAPE_BUCKETS = 1 << 13, 1 << 10
FEATURES = WORD_BUCKETS + SHAPE_BUCKETS + 4
#: Power of the similarity that weighs a vote; with 1 some held-out documents of label 0 pass where few labels are known.
POWER = 4
#: Byte classes of a shape: other, lower, upper, digit, above ASCII, full stop or comma, other marks.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[44, 46]] = 5


def features(data: np.ndarray, offsets: np.ndarray):
    """(document, feature, value) of a block, sorted by document and feature."""
    start, end, first = words(data, offsets)
    n_docs, count = len(offsets) - 1, np.diff(first)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    doc = np.repeat(np.arange(n_docs), count)
    h = spans_hash(prefix_hash(data, True), start, end)
    kind = _CLASS[data]
    bits = np.append((1 << kind).astype(np.uint8), np.uint8(0))
    has = np.bitwise_or.reduceat(bits, np.stack([start, end], 1).ravel())[::2]
    length = np.minimum(end - start, 24) // 3
    shape = has.astype(np.int64) * 8 + np.minimum(length, 7)
    shape = (shape * 7 + kind[end - 1]) % SHAPE_BUCKETS
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    again2 = np.zeros(len(h), bool)
    again2[2:] = (h[2:] == h[:-2]) & (doc[2:] == doc[:-2])
    cols = [doc * FEATURES + (h % U64(WORD_BUCKETS)).astype(np.int64), doc * FEATURES + WORD_BUCKETS + shape]
    extra = WORD_BUCKETS + SHAPE_BUCKETS
    cols += [doc[again] * FEATURES + extra, doc[again2] * FEATURES + extra + 1]
    key, n = np.unique(np.concatenate(cols), return_counts=True)
    d, f = key // FEATURES, key % FEATURES
    weight = np.where(f < WORD_BUCKETS, 1.0, np.where(f < extra, 1.5, 2.0))
    value = np.sqrt(n / count[d]) * weight
    # how varied the words are, from the same counts
    kinds = np.bincount(d[f < WORD_BUCKETS], minlength=n_docs)
    some = np.flatnonzero(count)
    d = np.concatenate([d, some])
    f = np.concatenate([f, np.full(len(some), extra + 2)])
    value = np.concatenate([value, 1 - np.sqrt(kinds[some] / count[some])])
    order = np.argsort(d, kind="stable")
    return d[order], f[order], value[order].astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    projection: np.ndarray  # features x dims
    vectors: np.ndarray  # labelled x dims, of unit length
    labels: np.ndarray
    k: int

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def embed(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, self.projection.shape[1]), np.float32)
        d, f, v = features(data, offsets)
        step = 1 << 16  # features multiplied at once
        for i in range(0, len(d), step):
            part = self.projection[f[i : i + step]] * v[i : i + step, None]
            begin = np.flatnonzero(np.r_[True, np.diff(d[i : i + step]) != 0])
            out[d[i : i + step][begin]] += np.add.reduceat(part, begin, axis=0)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(offsets) - 1, 0.5)
        v, order = self.embed(data, offsets), np.arange(len(self.labels)) * (4e-7 / len(self.labels))
        out, k = np.empty(len(v)), min(self.k, len(self.labels))
        for i in range(0, len(v), 256):
            # rounded so that equal vectors tie whatever the blocks are; ties go to the smaller labelled id
            cos = np.round((v[i : i + 256] @ self.vectors.T).astype(np.float64), 6)
            near = np.argpartition(-cos + order, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, near, 1), 0) ** POWER
            total = w.sum(axis=1)
            out[i : i + 256] = np.where(total > 0, (w * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 2000, dims: int = 48, k: int = 15) -> QualityModel:
    """Fits on at most ``max_train`` labelled rows, half of each label as far as there are, those whose ids hash lowest."""
    small_batches(docs.sparkSession)
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen: dict[int, int] = {}
    for q in (0, 1):
        rows = usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2).collect()
        chosen |= {r["doc_id"]: q for r in rows}
    if not chosen:
        return QualityModel(np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), k)

    def run(batches):
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            for i, j in blocks(offsets):
                d, f, v = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = np.searchsorted(d, np.arange(j - i + 1))
                fs, vs = ([x[at[n] : at[n + 1]] for n in range(j - i)] for x in (f.astype(np.int32), v))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.array(fs, pa.list_(pa.int32())), pa.array(vs, pa.list_(pa.float32()))], ["doc_id", "f", "v"])

    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")  # max_train ids at most
    # one text for each id, however many rows repeat it
    picked = picked.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted(picked.mapInArrow(run, "doc_id long, f array<int>, v array<float>").collect(), key=lambda r: r["doc_id"])
    rows = [r for r in rows if r["f"]]
    if not rows:
        return QualityModel(np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), k)
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        x[i, r["f"]] = r["v"]
    y = np.array([chosen[r["doc_id"]] for r in rows], float)
    k = max(1, min(k, int(y.sum()), int((1 - y).sum())))  # a label with fewer rows than k could not win among k neighbours
    dims = min(dims, len(rows))
    rng = np.random.default_rng(7)
    q = x @ (x.T @ (x @ rng.standard_normal((FEATURES, dims + 8), np.float32)))
    q, _ = np.linalg.qr(q)
    _, s, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    projection = np.ascontiguousarray(vt[:dims].T).astype(np.float32)
    vectors = x @ projection
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return QualityModel(projection, vectors, y, k)


def score(docs: DataFrame, model: QualityModel, column: str = "quality_score") -> DataFrame:
    """``docs`` with the score in ``column``, which replaces an input column of that name; no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # FEATURES * dims * 4 bytes and max_train * dims * 4 bytes
    docs = docs.drop(column)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])

    def run(batches):
        m = shared.value
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            got = [m.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets)]
            yield b.append_column(column, pa.array(np.concatenate(got) if got else np.zeros(0)))

    return docs.mapInArrow(run, schema)
