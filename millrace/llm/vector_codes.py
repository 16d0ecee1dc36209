"""Vector code compression: product codebooks, with segment-mean lower bounds in the search.

A vector's components become whole numbers, and the vector is cut into equal parts; each part is coded
by the nearest entry of its position's codebook.  The codebooks start as the parts of the vectors
with the smallest ids and are refined by rounds of assigning and averaging, in whole numbers.

The search for the nearest entry goes from coarse to fine.  Cut a part and an entry into segments: the squared
distance is the squared distance of the segments' means, weighted by their lengths, plus that of the residuals, and the
latter is no less than the squared difference of the residuals' norms.  One segment gives the first bound, for all
entries; the entry with the least one is measured exactly, entries whose bound exceeds that distance
go; twice as many segments bound the rest more closely, and so on; what survives is measured exactly in whole
numbers.  A margin far above rounding keeps the filter conservative, so codes are those of a full search.

A round sends the codebooks (parts x entries x length numbers) to the tasks and sums of the same size back, added
up for each task before the shuffle; vectors are not shuffled.

Defined results: rows with a null vector, a null or non-finite component are dropped, as are
vectors whose length differs from that of the first (smallest id) whose length the parts divide; components saturate
at ``LIMIT``; null ids come after all others and may be coded; rows that repeat an id are coded one by one; with fewer vectors
than entries the codebooks are smaller; an empty table gives no rows; other columns are kept, but
for those named as the results (``CODES``), which are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from millrace.llm.common import fresh, small_batches, staged

CODES = ("vector_code", "vector_error")
#: Largest whole number a component can be; distances of vectors of up to 2**10 components stay exact in 64 bits.
LIMIT = 1 << 24
#: Vectors compared with all entries of a part at once.
CHUNK = 4096
#: Labels up to this number are broadcast with their sums; more are joined by a shuffle.
BROADCAST_LABELS = 10_000
SALTS = 32


@dataclass(frozen=True)
class Codebooks:
    entries: np.ndarray  # parts x entries x length, whole numbers
    scale: int

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """vectors x parts of entry numbers -> the vectors that the codes stand for, in the units of the input."""
        return np.concatenate([self.entries[j][codes[:, j]] for j in range(len(self.entries))], axis=1) / self.scale


def _levels(x: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... segments: the segments' means times the roots of their lengths, and the residual's norm."""
    length, out, s = x.shape[1], [], 1
    square = (x.astype(np.float64) ** 2).sum(axis=1)
    while s < length:
        cut = np.arange(s + 1) * length // s
        mean = np.add.reduceat(x, cut[:-1], axis=1) / np.sqrt(np.diff(cut))
        rest = np.sqrt(np.maximum(square - (mean**2).sum(axis=1), 0))
        out.append(np.concatenate([mean, rest[:, None]], axis=1))
        s *= 2
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of the nearest entry for each row of ``x``, ties to the lower number, and how many exact distances it took."""
    entry, error, measured = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
    coarse = _levels(entries)
    largest = float((entries.astype(np.float64) ** 2).sum(axis=1).max())
    for i in range(0, len(x), CHUNK):
        part = x[i : i + CHUNK]
        levels = _levels(part)
        margin = 1e-6 * ((part.astype(np.float64) ** 2).sum(axis=1) + largest) + 1e-6
        if levels:
            bound = np.zeros((len(part), len(entries)))
            for c in range(levels[0].shape[1]):
                bound += (levels[0][:, c : c + 1] - coarse[0][:, c]) ** 2
            guess = bound.argmin(axis=1)
            upper = ((part - entries[guess]) ** 2).sum(axis=1)
            row, col = np.nonzero(bound <= (upper + margin)[:, None])
            for mine, theirs in zip(levels[1:], coarse[1:]):
                near = ((mine[row] - theirs[col]) ** 2).sum(axis=1) <= (upper + margin)[row]
                row, col = row[near], col[near]
        else:
            row, col = np.divmod(np.arange(len(part) * len(entries)), len(entries))
        exact = ((part[row] - entries[col]) ** 2).sum(axis=1)
        measured += len(exact)
        first = np.searchsorted(row, np.arange(len(part)))
        best = np.minimum.reduceat(exact, first)
        # entries are in ascending order within a row: the first at the least distance wins
        at = np.flatnonzero(exact == best[row])
        entry[i : i + len(part)] = col[at[np.searchsorted(row[at], np.arange(len(part)))]]
        error[i : i + len(part)] = best
    return entry, error, measured


def whole_numbers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(values * scale), -LIMIT, LIMIT).astype(np.int64).reshape(-1, dims)


def usable(vectors: DataFrame, vector: str, dims: int | None = None, parts: int = 1) -> DataFrame:
    """Rows whose vector has finite components only, and ``dims`` of them (else a multiple of ``parts``)."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    size = (F.size(v) == dims) if dims else (F.size(v) > 0) & (F.size(v) % parts == 0)
    return vectors.where(v.isNotNull() & size).where(fine)


def fit(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = 16, n_entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks from all usable rows; None where there are none."""
    small_batches(vectors.sparkSession, 4096)
    id_, vec = F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")
    rows = usable(vectors, vector, parts=parts).select(id_, vec)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return None
    dims = len(first[0]["v"])
    rows = usable(vectors, vector, dims).select(id_, vec)
    start = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(n_entries).collect()  # n_entries rows
    x = np.clip(np.floor(np.array([r["v"] for r in start]) * scale), -LIMIT, LIMIT).astype(np.int64)
    books = Codebooks(np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        books = _refined(rows, books)
    return books


def _refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes the floored mean of the parts nearest to it; one that has none stays."""
    parts, n, length = books.entries.shape
    names = [f"s{i}" for i in range(length)]

    def run(batches):
        count, total = np.zeros((parts, n), np.int64), np.zeros((parts, n, length), np.int64)
        for b in batches:
            x = whole_numbers(b.column("v"), books.dims, books.scale)
            for j in range(parts):
                mine = x[:, j * length : (j + 1) * length]
                entry, _, _ = nearest(mine, books.entries[j])
                count[j] += np.bincount(entry, minlength=n)
                for c in range(length):
                    total[j, :, c] += np.bincount(entry, weights=mine[:, c], minlength=n).astype(np.int64)
        part, entry = np.nonzero(count)
        columns = [pa.array(part), pa.array(entry), pa.array(count[part, entry]), *[pa.array(total[part, entry, c]) for c in range(length)]]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *names])

    sums = rows.select("v").mapInArrow(run, "part long, entry long, n long, " + ", ".join(f"{s} long" for s in names))
    out = books.entries.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).collect():  # parts x entries rows
        out[r["part"], r["entry"]] = [r[s] // r["n"] for s in names]
    return Codebooks(out, books.scale)


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """The usable rows with ``vector_code`` (one byte for each part, two from 257 entries on) and ``vector_error``; no shuffle."""
    small_batches(vectors.sparkSession, 4096)
    parts, n, length = books.entries.shape
    width = np.uint8 if n <= 256 else np.dtype(">u2")
    rows = usable(vectors.drop(*CODES), vector, books.dims)
    inner = fresh(rows, "vector_v")
    rows = rows.withColumn(inner, F.col(vector).cast("array<double>"))
    schema = StructType([*rows.drop(inner).schema.fields, StructField(CODES[0], BinaryType()), StructField(CODES[1], LongType())])

    def run(batches):
        for b in batches:
            x = whole_numbers(b.column(inner), books.dims, books.scale)
            code, error = np.empty((len(x), parts), width), np.zeros(len(x), np.int64)
            for j in range(parts):
                entry, off, _ = nearest(x[:, j * length : (j + 1) * length], books.entries[j])
                code[:, j] = entry
                error += off
            out = b.drop_columns([inner])
            yield out.append_column(CODES[0], pa.array([c.tobytes() for c in code], pa.binary())).append_column(CODES[1], pa.array(error))

    return rows.mapInArrow(run, schema)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded``, a table read from files, with ``label_error``: the sum of ``vector_error`` over equal labels, nulls together."""
    key, total, salt = (fresh(coded, c) for c in ("label_key", "label_total", "label_salt"))
    coded = coded.drop("label_error")
    sums = coded.groupBy(F.col(label).alias(key)).agg(F.sum("vector_error").alias(total))
    sums = staged(sums, "label-sums")
    same = F.col(label).eqNullSafe(F.col(key))
    if sums.count() <= BROADCAST_LABELS:
        out = coded.join(F.broadcast(sums), same)
    else:  # a label may hold a third of the rows: its rows are dealt over SALTS tasks, its sum is sent to each
        right = sums.withColumn(salt + "2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = coded.withColumn(salt, F.pmod(F.xxhash64("vector_code", "vector_error"), F.lit(SALTS)).cast("int"))
        out = left.join(right, same & (F.col(salt) == F.col(salt + "2")))
    return out.select(*coded.columns, F.col(total).alias("label_error"))
