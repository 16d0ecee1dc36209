"""Similarity search of a stated query set against all rows, in pairs of blocks, and joins on band or attribute."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import staged

#: Rows of a block of queries, and of a block of the gallery: what one task holds at a time.
QUERY_BLOCK, GALLERY_BLOCK = 16_384, 65_536
#: Queries in one product with a block of the gallery.
STEP = 128


def search(queries: DataFrame, gallery: DataFrame, k: int | None, key: str = "item", vec: str = "vec", least: float | None = None, below: float | None = None, differ: tuple[str, ...] = ()) -> DataFrame:
    """query, item, sim, rank: the k most similar other rows of each query (ties: smaller key), at least ``least`` and under ``below`` similar, in whose ``differ`` columns (of no nulls) both differ.

    With ``k`` None, all such rows and no rank.  Keys are unique.  Every block of queries meets every block of the
    gallery in one keyed shuffle; a pair of blocks sends on k rows for each of its queries.
    """
    cols = [key, vec, *differ]

    def near(q: pa.Table, g: pa.Table) -> pa.Table:
        out = []
        for ids, own, item, theirs, sim in _products(q, g, cols, cols):
            for a, b in zip(own, theirs, strict=True):
                sim[a[:, None] == b] = -np.inf
            if below is not None:
                sim[sim >= below] = -np.inf
            if least is not None:
                sim[sim < least] = -np.inf
            if k is None:
                row, col = np.nonzero(sim > -np.inf)
            else:
                order = np.lexsort((np.broadcast_to(item, sim.shape), -sim), axis=1)[:, :k]
                row, at = np.nonzero(np.take_along_axis(sim, order, 1) > -np.inf)
                col = order[row, at]
            out.append((ids[row], item[col], sim[row, col]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(columns, ["query", "item", "sim"])

    out = _block_pairs(queries.select(*cols), gallery.select(*cols), key, near, "query long, item long, sim double")
    if k is None:
        return out
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "item")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block_pairs(queries: DataFrame, gallery: DataFrame, key: str, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on every pair of a block of queries and a block of the gallery."""
    n_q, n_g = (max(1, -(-t.count() // size)) for t, size in ((queries, QUERY_BLOCK), (gallery, GALLERY_BLOCK)))
    gallery = gallery.select(*[F.col(c).alias(f"g_{c}") for c in gallery.columns])  # the two may be parts of one table
    block = lambda n, c=key: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_q", block(n_q)).withColumn("_g", each(n_g)).groupBy("_q", "_g")
    g = gallery.withColumn("_g", block(n_g, f"g_{key}")).withColumn("_q", each(n_q)).groupBy("_q", "_g")
    return q.cogroup(g).applyInArrow(work, schema)


def _products(q: pa.Table, g: pa.Table, cols: list[str], other: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]]:
    """(keys of some queries, their further columns, keys of the gallery block, its further columns, similarities); ``cols`` and ``other`` name key, vector and further columns of the two, a row is not compared with itself."""
    if not q.num_rows or not g.num_rows:
        return

    def parts(t: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        v = t.column(names[1]).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
        return t.column(names[0]).to_numpy(), v, [t.column(c).to_numpy() for c in names[2:]]

    ids, matrix, own = parts(q, cols)
    item, v, theirs = parts(g, [f"g_{c}" for c in other])
    for i in range(0, len(ids), STEP):
        sim = np.round(matrix[i : i + STEP] @ v.T, 9)  # rounded as the comparison with other engines needs it
        sim[ids[i : i + STEP, None] == item] = -np.inf
        yield ids[i : i + STEP], [c[i : i + STEP] for c in own], item, theirs, sim


def first_ranks(queries: DataFrame, gallery: DataFrame, label: str, key: str = "item", vec: str = "vec") -> DataFrame:
    """query, rank: one more than the rows that are more similar than the best row of the query's label; queries without such a row are left out.

    Two passes over pairs of blocks: the best similarity, then a count above it.  Each pair gives one row
    for each query, so no list of a query's similarities is ever made.
    """
    cols = [key, vec, label]

    def best(q: pa.Table, g: pa.Table) -> pa.Table:
        out = []
        for ids, (mine,), _, (theirs,), sim in _products(q, g, cols, cols):
            sim[mine[:, None] != theirs] = -np.inf
            top = sim.max(axis=1)
            out.append((ids[top > -np.inf], top[top > -np.inf]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(columns, ["query", "best"])

    tops = _block_pairs(queries.select(*cols), gallery.select(*cols), key, best, "query long, best double").groupBy("query").agg(F.max("best").alias("best"))
    tops = staged(tops, "best")

    def above(q: pa.Table, g: pa.Table) -> pa.Table:
        out = [(ids, (sim > top[:, None]).sum(axis=1)) for ids, (top,), _, _, sim in _products(q, g, [key, vec, "best"], [key, vec])]
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        return pa.table(columns, ["query", "n"])

    asked = queries.select(key, vec).join(tops.withColumnRenamed("query", key), key).select(key, vec, "best")
    return _block_pairs(asked, gallery.select(key, vec), key, above, "query long, n long").groupBy("query").agg((F.sum("n") + 1).alias("rank"))


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: int) -> DataFrame:
    """Pairs with |left - right| <= tolerance on integer values: an equi-join on buckets of the tolerance's width."""
    width = tolerance + 1
    near = left.withColumn("_b", F.explode(F.array(*[F.floor(F.col(left_value) / width) + k for k in (-1, 0, 1)])))
    other = right.withColumn("_b", F.floor(F.col(right_value) / width))
    return near.join(other, "_b").where(F.abs(F.col(left_value) - F.col(right_value)) <= tolerance).drop("_b")
