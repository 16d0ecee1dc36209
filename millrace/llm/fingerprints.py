"""Document fingerprints by one-permutation MinHash.

Each distinct word shingle is hashed once; the top bits pick one of ``bins`` bins and a bin
keeps its smallest hash.  Empty bins borrow from a bin that has a value, picked by a fixed
sequence of hashes of (bin, attempt) - optimal densification.  A bin then stores the low
``bits`` bits of its (mixed) minimum, packed.  The likeness of two fingerprints is the
share of equal bins, corrected for values that agree by chance: (m - c) / (1 - c) with
c = 2**-bits, clipped to 0..1.

Defined results: null text counts as empty; a text without words has the fingerprint ''
(likeness 1 to another such text, 0 to any other); a text of fewer words than a shingle
has one shingle, all its words; a text of any length is taken whole (a long one is a numpy block of its own, about
34 bytes of memory for each of its bytes); rows may repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import U64, blocks, mix, partitions, range_shards, seeded, shard_of, shingle_hashes, small_batches, text_buffer, word_hashes

_FULL = U64(2**64 - 1)
#: Attempts by hash; a bin still empty then takes the occupied bin that its hash picks by rank.
ATTEMPTS = 256


class Fingerprinter:
    """bins: a power of two; bits: 1, 2, 4 or 8."""

    def __init__(self, n_words: int = 5, bins: int = 512, bits: int = 4):
        self.n_words, self.bins, self.bits = n_words, bins, bits
        self.shift = U64(64 - bins.bit_length() + 1)
        self.donor = (seeded(bins * ATTEMPTS, 31).reshape(ATTEMPTS, bins) % U64(bins)).astype(np.int64)
        self.rank = seeded(bins, 37) >> U64(1)

    def minima(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents x bins minima, densified; which documents have any word)."""
        n = len(offsets) - 1
        out, some = np.full((n, self.bins), _FULL), np.zeros(n, bool)
        for i, j in blocks(offsets):
            word, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            h, doc = shingle_hashes(word, first, self.n_words)
            np.minimum.at(out[i:j].reshape(-1), doc * self.bins + (h >> self.shift).astype(np.int64), h)
            some[i:j] = np.diff(first) > 0
        return self.densify(out, some), some

    def densify(self, out: np.ndarray, some: np.ndarray) -> np.ndarray:
        row, col = np.nonzero((out == _FULL) & some[:, None])
        was, filled = out.copy(), out
        for a in range(ATTEMPTS):
            if not len(row):
                return filled
            got = was[row, self.donor[a, col]]
            hit = got != _FULL
            filled[row[hit], col[hit]] = got[hit]
            row, col = row[~hit], col[~hit]
        for r, c in zip(row, col, strict=True):
            own = np.flatnonzero(was[r] != _FULL)
            filled[r, c] = was[r, own[int(self.rank[c]) % len(own)]]
        return filled

    def codes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents x bins of small codes, which documents have any word)."""
        low, some = self.minima(data, offsets)
        return (mix(low) & U64(2**self.bits - 1)).astype(np.uint8), some

    def pack(self, codes: np.ndarray) -> np.ndarray:
        per = 8 // self.bits
        shifts = (np.arange(per) * self.bits).astype(np.uint8)
        return np.bitwise_or.reduce(codes.reshape(len(codes), -1, per) << shifts, axis=2).astype(np.uint8)

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        shifts = (np.arange(8 // self.bits) * self.bits).astype(np.uint8)
        return ((packed[:, :, None] >> shifts) & np.uint8(2**self.bits - 1)).reshape(len(packed), -1)

    def texts(self, codes: np.ndarray, some: np.ndarray) -> list[str]:
        packed = self.pack(codes)
        return [p.tobytes().hex() if s else "" for p, s in zip(packed, some, strict=True)]

    def likeness(self, a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
        chance = 2.0**-self.bits
        out = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
        return np.where(some_a & some_b, out, (some_a == some_b).astype(float))


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def fingerprint(docs: DataFrame, n_words: int = 5, bins: int = 512, bits: int = 4) -> DataFrame:
    """doc_id and fingerprint (lowercase hex) of every row of ``docs``; no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        printer = Fingerprinter(n_words, bins, bits)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(printer.texts(*printer.codes(*text_buffer(b.column("text")))), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


EDIT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame, n_words: int = 5, bins: int = 512, bits: int = 4, rows_per_shard: int = 20_000) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has the last quarter of its code points replaced by the beginning of
    the next document in ``doc_id`` order (after the last: the first).  Texts are shuffled
    once, to shards that are ranges of ``doc_id``; the first row of each shard also goes to
    the shard before it.  Rows that repeat a ``doc_id`` follow each other by text, a null
    ``doc_id`` comes first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts, n_shards = range_shards(docs.select("doc_id"), "doc_id", rows_per_shard, partitions(spark))
    docs = docs.withColumn("shard", shard_of("doc_id", cuts))
    # the smallest id of each shard that has rows (null ids first) and the shard before it: one row for each shard
    heads = docs.groupBy("shard").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls"))
    w, everything = Window.orderBy("shard"), Window.partitionBy()
    heads = heads.select(F.col("shard").alias("of"), F.when(~F.col("nulls"), F.col("least")).alias("least"), F.coalesce(F.lag("shard").over(w), F.max("shard").over(everything)).alias("before"))
    dealt = docs.join(F.broadcast(heads), F.col("shard") == F.col("of"), "left")
    own = F.struct("shard", F.lit(False).alias("tail"))
    again = F.when(F.col("doc_id").eqNullSafe(F.col("least")), F.struct(F.col("before").alias("shard"), F.lit(True).alias("tail")))
    dealt = dealt.withColumn("to", F.explode(F.array_compact(F.array(own, again)))).select("to.shard", "to.tail", "doc_id", "text")
    dealt = dealt.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "tail", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        printer = Fingerprinter(n_words, bins, bits)
        held = None  # (shard, doc_id, text): the last row, whose successor is not known yet
        for b in batches:
            shard, tail, doc, text = (b.column(c).to_pylist() for c in ("shard", "tail", "doc_id", "text"))
            if held:
                shard, tail, doc, text = [held[0], *shard], [False, *tail], [held[1], *doc], [held[2], *text]
            use = [i for i in range(len(doc) - 1) if not tail[i] and shard[i] == shard[i + 1]]
            held = (shard[-1], doc[-1], text[-1]) if doc and not tail[-1] else None
            for k in range(0, len(use), 256):
                yield _edited(printer, use[k : k + 256], doc, text)

    return dealt.mapInArrow(run, EDIT)


def _edited(printer: Fingerprinter, use: list[int], doc: list, text: list[str]) -> pa.RecordBatch:
    cut = {i: len(text[i]) // 4 for i in use}
    edited = [(text[i][: len(text[i]) - cut[i]] + text[i + 1][: cut[i]]).encode() for i in use]
    at = {i: k for k, i in enumerate(sorted({*use, *(i + 1 for i in use)}))}
    codes, some = printer.codes(*join_texts([text[i].encode() for i in at]))
    codes2, some2 = printer.codes(*join_texts(edited))
    a, b = [at[i] for i in use], [at[i + 1] for i in use]
    cols = [
        pa.array([doc[i] for i in use], pa.int64()),
        pa.array([len(text[i]) for i in use], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
        pa.array(printer.texts(codes[a], some[a]), pa.string()),
        pa.array(printer.texts(codes2, some2), pa.string()),
        pa.array(printer.likeness(codes[a], codes2, some[a], some2)),
        pa.array(printer.likeness(codes[a], codes[b], some[a], some[b])),
    ]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in EDIT.split(", ")])
