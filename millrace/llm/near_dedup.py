"""Near-duplicate documents by an LSH forest over MinHash signatures, with links confirmed on full shingle sets.

Signature.  ``trees * prefix`` minima of the set's hashed word shingles.  Tree t orders the
documents by the signature read from position ``t * prefix`` on, wrapping around: the
first ``prefix`` values as one key, then ``TAIL`` further values.

Candidates.  Documents that share a key stand together; within such a region each is
paired with its neighbour in the sorted order, whose common prefix is the longest, so
the depth that is compared follows the density of the region.  It is also paired with the
region's pivot, the smallest id so far.  The number of pairs is linear in the rows however
large a region is, and the sort is dealt by ranges of the full order, so a region of any
size spreads over tasks; what meets at the borders of tasks is paired afterwards.

Links.  Documents with equal sets are one class from the start.  Pivot pairs are confirmed
on the full sets first, then neighbour pairs whose components still differ.  Regions that
then still hold several components are finished exactly (``finish``).  In a region of one
block every pair of rows from different components is compared on the full sets by a product
of the shingle matrix, whatever its tails say.  The rows of larger regions meet by rare
shingles instead: a link must share one among the first few of both sets in order of rarity,
so variants of one text that differ too much to be links meet nowhere.  So two documents
that share a key in any tree and are a link always end in one component (a region of two
rows has only its neighbour pair, which the tails pre-check).  Components come from joins
(``components``).

Defined results: null or empty text has an empty set and is linked with nothing; rows that
repeat a ``doc_id`` count as one document that has all their sets; a null ``doc_id`` is
linked with nothing and kept; a text of any length is taken whole; an empty table gives no rows; other columns are ignored.

What grows: m rows that agree in one of their rarest shingles and are no links are compared in about
(m / ``BLOCK_ROWS``)**2 / 2 pairs of blocks, spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import U64, blocks, mix, partitions, seeded, shingle_hashes, small_batches, staged, text_buffer, word_hashes
from millrace.llm.components import connected_components

#: Signature values behind the key that order a region and pre-check a pair, one byte each.
TAIL = 32
#: Ids up to this number are broadcast to pick the documents of candidate pairs (8 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 500_000
#: Rows and shingles of a block of an open region, about; two blocks are compared at a time, which bounds a task's memory.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 500_000
#: Shingles in one step of a block product.
STEP = 4096
#: Hash slots that count shingles, to tell rare from frequent ones: 8 bytes each on the driver and in a task.
COUNTERS = 1 << 20


def set_hashes(data: np.ndarray, offsets: np.ndarray, n_words: int):
    """The sorted distinct shingle hashes of each document."""
    for i, j in blocks(offsets):
        part = offsets[i : j + 1] - offsets[i]
        word, first = word_hashes(data[offsets[i] : offsets[j]], part)
        h, doc = shingle_hashes(word, first, n_words)
        at = np.searchsorted(doc, np.arange(j - i + 1))
        for k in range(j - i):
            yield np.unique(h[at[k] : at[k + 1]])


def signatures(docs: DataFrame, n_words: int, values: int) -> DataFrame:
    """doc_id, n_shingles, set_id (128 bits) and the MinHash signature of each document."""
    mult = seeded(values, 71) | U64(1)

    def run(batches):
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            sizes, ids, sigs = [], [], []
            for h in set_hashes(data, offsets, n_words):
                sizes.append(len(h))
                if not len(h):
                    ids.append(b"")
                    sigs.append(b"")
                    continue
                ids.append(np.array([mix(h ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64), mix(h ^ U64(0x14057B7EF767814F)).sum(dtype=U64)]).tobytes())
                low = np.full(values, U64(2**64 - 1))
                for k in range(0, len(h), 2048):
                    np.minimum(low, (h[k : k + 2048, None] * mult).min(axis=0), out=low)
                sigs.append((low >> U64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_id", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sig binary")


def forest_rows(reps: DataFrame, trees: int, prefix: int) -> DataFrame:
    """A row for each document and tree: key, tail, rep, n."""
    values = trees * prefix
    gram = seeded(prefix, 19) | U64(1)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(text_buffer(b.column("sig"))[0], "<u4").reshape(-1, values)
            order = (np.arange(trees)[:, None] * prefix + np.arange(prefix + TAIL)) % values
            turned = sig[:, order]  # documents x trees x depth
            key = mix((turned[:, :, :prefix].astype(U64) * gram).sum(axis=2, dtype=U64) + np.arange(1, trees + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
            tail = (mix(turned[:, :, prefix:].astype(U64)) & U64(255)).astype(np.uint8)
            n = len(sig)
            flat = pa.Array.from_buffers(pa.binary(TAIL), n * trees, [None, pa.py_buffer(np.ascontiguousarray(tail).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), flat, pa.array(np.repeat(b.column("rep").to_numpy(), trees)), pa.array(np.repeat(b.column("n_shingles").to_numpy(), trees))], ["key", "tail", "rep", "n"])

    return reps.mapInArrow(run, "key long, tail binary, rep long, n long")


PAIRS = "a long, b long, kind int, part int, key long, tail binary, n long"


def _agree(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, ratio: float) -> np.ndarray:
    return ((x == y).sum(axis=1) >= tail_agree(100 * ratio)) & (np.minimum(nx, ny) >= ratio * np.maximum(nx, ny))


def _neighbours(ratio: float):
    """Pairs of a sorted partition. kind 0: with the pivot; 1: with the neighbour; 2, 3: the partition's first and last row."""

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        pivot = None  # (key, rep, tail, n)
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            key, rep, n = (b.column(c).to_numpy() for c in ("key", "rep", "n"))
            tail = text_buffer(b.column("tail"))[0].reshape(m, TAIL)
            rows: list[list] = []
            if last is None:
                rows.append([[rep[0]], [rep[0]], [2], [key[0]], [tail[0].tobytes()], [n[0]]])
            else:
                key, rep, n, tail = np.r_[last[0], key], np.r_[last[1], rep], np.r_[last[2], n], np.vstack([last[3], tail])
            same = key[1:] == key[:-1]
            at = np.flatnonzero(same)
            if len(at):
                ok = at[_agree(tail[at], tail[at + 1], n[at], n[at + 1], ratio) & (rep[at] != rep[at + 1])]
                rows.append([np.minimum(rep[ok], rep[ok + 1]), np.maximum(rep[ok], rep[ok + 1]), np.full(len(ok), 1), key[ok], [None] * len(ok), n[ok]])
                # the row of the smallest id so far in each region, which may have begun in an earlier batch
                begin = np.flatnonzero(np.r_[True, ~same])
                of = np.cumsum(np.r_[True, ~same]) - 1
                low = np.empty(len(key), np.int64)
                head = (rep[0], tail[0], n[0]) if pivot is None or pivot[0] != key[0] or pivot[1] > rep[0] else pivot[1:]
                for s, e in zip(begin, np.r_[begin[1:], len(key)], strict=True):
                    if e - s > 1:
                        ids = rep[s:e].copy()
                        if s == 0:
                            ids[0] = head[0]
                        running = np.minimum.accumulate(ids)
                        new = np.r_[True, running[1:] != running[:-1]]
                        low[s:e] = s + np.maximum.accumulate(np.where(new, np.arange(e - s), 0))
                tails, ns, reps = tail.copy(), n.copy(), rep.copy()
                reps[0], tails[0], ns[0] = head
                x = at + 1
                p = low[at]  # the pivot before x
                ok = _agree(tails[p], tail[x], ns[p], n[x], ratio) & (reps[p] != rep[x])
                x, p = x[ok], p[ok]
                rows.append([np.minimum(reps[p], rep[x]), np.maximum(reps[p], rep[x]), np.zeros(len(x), int), key[x], [None] * len(x), n[x]])
                end = low[len(key) - 1] if same[-1] else None
                pivot = (key[-1], reps[end], tails[end], ns[end]) if end is not None else None
            else:
                pivot = None
            last = (key[-1], rep[-1], n[-1], tail[-1:])
            yield _batch(rows, part)
        if last is not None:
            yield _batch([[[last[1]], [last[1]], [3], [last[0]], [last[3].tobytes()], [last[2]]]], part)

    return run


def _batch(rows, part):
    cat = [np.concatenate([np.asarray(r[k]) for r in rows]) if k != 4 else [x for r in rows for x in r[4]] for k in range(6)] if rows else [[]] * 6
    a, b, kind, key, tail, n = cat
    cols = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kind, pa.int32()), pa.array(np.full(len(a), part), pa.int32()), pa.array(key, pa.int64()), pa.array(tail, pa.binary()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PAIRS.split(", ")])


def candidates(reps: DataFrame, trees: int, prefix: int, ratio: float) -> DataFrame:
    """a, b, kind: distinct candidate pairs of class representatives; kind 0 if any tree's pivot gave the pair."""
    spark = reps.sparkSession
    rows = forest_rows(reps, trees, prefix)
    dealt = rows.repartitionByRange(partitions(spark), "key", "tail", "rep").sortWithinPartitions("key", "tail", "rep")
    found = staged(dealt.mapInArrow(_neighbours(ratio), PAIRS), "forest")
    pairs = found.where("kind < 2").select("a", "b", "kind")
    # the last row of a partition beside the first row of the next one that has rows: two rows for each partition
    w = Window.orderBy("part", "kind")
    border = found.where("kind >= 2").select("part", "kind", "key", "a", F.lead("key").over(w).alias("key2"), F.lead("a").over(w).alias("a2"))
    border = border.where("kind = 3 and key = key2 and a <> a2").select(F.least("a", "a2").alias("a"), F.greatest("a", "a2").alias("b"), F.lit(0).alias("kind"))
    return staged(pairs.unionByName(border).groupBy("a", "b").agg(F.min("kind").alias("kind")), "pairs")


def confirm(pairs: DataFrame, docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= percent * union."""
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "involved")
    pick = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = staged(shingle_sets(docs.join(pick, "doc_id", "left_semi").distinct(), n_words), "sets")
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    # the smaller id, which may be in very many pairs, comes last: its set is met where the pairs are and not shuffled with them
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    inter = F.size(F.array_intersect("ha", "hb"))
    checked = both.select("a", "b", inter.alias("i"), (F.size("ha") + F.size("hb")).alias("s")).where(f"i > 0 and 100 * i >= {percent} * (s - i)")
    return staged(checked.select("a", "b").distinct(), "confirmed")


def shingle_sets(docs: DataFrame, n_words: int) -> DataFrame:
    """doc_id and the sorted distinct shingle hashes of each row."""

    def run(batches):
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            sets = [h.view(np.int64) for h in set_hashes(data, offsets, n_words)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "hashes"])

    return docs.mapInArrow(run, "doc_id long, hashes array<long>")


def region_rows(reps: DataFrame, trees: int, prefix: int) -> DataFrame:
    """key, rep, comp, n for each document and tree; the keys are those of ``forest_rows``."""
    gram = seeded(prefix, 19) | U64(1)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(text_buffer(b.column("sig"))[0], "<u4").reshape(-1, trees, prefix).astype(U64)
            key = mix((sig * gram).sum(axis=2, dtype=U64) + np.arange(1, trees + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
            rep, comp, n = (np.repeat(b.column(c).to_numpy(), trees) for c in ("rep", "comp", "n_shingles"))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(rep), pa.array(comp), pa.array(n)], ["key", "rep", "comp", "n"])

    return reps.mapInArrow(run, "key long, rep long, comp long, n long")


def block_links(rep: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same rows as all pairs of different components with 100 * intersection >= percent * union."""
    m = len(rep)
    n = np.array([len(x) for x in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), n)
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[col] > 1  # what only one row has meets nothing
    place = np.cumsum(count > 1) - 1
    col, row = place[col[shared]], row[shared]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    both = np.zeros((m, m), np.int64)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, STEP):
        i, j = np.searchsorted(col, [c, c + STEP])
        x = np.zeros((m, int(col[j - 1]) - c + 1), np.float32)
        x[row[i:j], col[i:j] - c] = 1
        np.add(both, x @ x.T, out=both, casting="unsafe")  # whole numbers up to STEP, exact in 32 bits
    link = (comp[:, None] != comp[None, :]) & (both > 0) & (100 * both >= percent * (n[:, None] + n[None, :] - both))
    low = np.arange(m)
    while True:  # every row takes the first row that it reaches
        new = np.minimum(low, np.where(link, low[None, :], m).min(axis=1, initial=m))
        if (new == low).all():
            break
        low = new
    at = np.flatnonzero(low != np.arange(m))
    return rep[low[at]], rep[at]


def _units(percent: int):
    """Links of a partition sorted by (key, u, v): the rows of one such unit are compared with each other."""

    def solve(rows):
        rep, comp, sets = (sum((r[k] for r in rows), []) for k in range(3))
        a, b = block_links(np.array(rep), np.array(comp), sets, percent)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in ("key", "u", "v")])
            data, offs = batch.column("hashes").flatten().to_numpy(), np.r_[0, np.cumsum(batch.column("hashes").value_lengths().to_numpy())]
            rep, comp = (batch.column(c).to_pylist() for c in ("rep", "comp"))
            begin = np.flatnonzero(np.r_[True, (ids[:, 1:] != ids[:, :-1]).any(axis=0)])
            for s, e in zip(begin, np.r_[begin[1:], batch.num_rows], strict=True):
                unit = tuple(ids[:, s])
                if unit != now and rows:
                    yield solve(rows)
                    rows = []
                now = unit
                rows.append((rep[s:e], comp[s:e], [data[offs[k] : offs[k + 1]] for k in range(s, e)]))
        if rows:
            yield solve(rows)

    return run


def rarity(sets: DataFrame) -> np.ndarray:
    """How often the shingles of ``COUNTERS`` hash slots occur in ``sets``: one number for each slot, whatever the rows."""

    def run(batches):
        count = np.zeros(COUNTERS, np.int64)
        for b in batches:
            count += np.bincount(_slots(b.column("hashes").flatten().to_numpy()), minlength=COUNTERS)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["slot", "n"])

    found = sets.select("hashes").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def _slots(h: np.ndarray) -> np.ndarray:
    return (mix(h.view(U64)) % U64(COUNTERS)).astype(np.int64)


def prefix_rows(sets: DataFrame, count: np.ndarray, percent: int) -> DataFrame:
    """key, rep, comp, n, index: a row for each shingle by which a set (rep, comp, hashes) may meet a link.

    Shingles stand in one order for all sets, rarest slot first.  Of two sets that are a link,
    the larger has a shingle of the other's among the first n - ceil(n p) + 1 of its n, and
    there it is among the first m - ceil(2 m p / (1 + p)) + 1 of the smaller one's m (``index``).
    A shingle that is alone in its slot is alone in the table, meets nothing, and gives no row.
    """

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column("hashes").flatten().to_numpy()
            n = b.column("hashes").value_lengths().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            often = count[_slots(flat)]
            order = np.lexsort((flat, often, row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            probe, index = n + (-n * percent) // 100 + 1, n + (-2 * n * percent) // (100 + percent) + 1
            keep = (place < probe[row]) & (often[order] > 1)
            at, of = order[keep], row[keep]
            rep, comp = (b.column(c).to_numpy()[of] for c in ("rep", "comp"))
            yield pa.RecordBatch.from_arrays([pa.array(flat[at]), pa.array(rep), pa.array(comp), pa.array(n[of]), pa.array((place[keep] < index[of]))], ["key", "rep", "comp", "n", "index"])

    return sets.select("rep", "comp", "hashes").mapInArrow(run, "key long, rep long, comp long, n long, index boolean")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def open_groups(rows: DataFrame, least: int, label: str) -> DataFrame:
    """The rows of groups of ``least`` rows or more that hold several components and a row to index; groups of the same rows are kept once."""
    groups = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("index").alias("some"),
        F.bit_xor(F.xxhash64("rep", "index")).alias("x"), F.bit_xor(F.xxhash64("rep", "index", F.lit(7))).alias("y"),
    )
    groups = groups.where(f"rows >= {least} and lo < hi and some").groupBy("rows", "x", "y").agg(F.min("key").alias("key"))
    return staged(rows.join(_few(staged(groups.select("key"), f"{label}-keys")), "key"), label)


def block_plan(rows: DataFrame) -> DataFrame:
    """key, main, others, mains: into how many blocks each group's rows are cut.

    Rows of ``main`` blocks need no comparison among themselves: those of the largest
    component, or those that are not to be indexed if they are more (``main`` is null then).
    """
    per = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"), F.sum(F.expr("int(not index)")).alias("loose"), F.sum(F.expr("if(index, 0, n)")).alias("loose_size"))
    per = per.groupBy("key").agg(F.max(F.struct("rows", "size", "comp")).alias("top"), *[F.sum(c).alias(c) for c in ("rows", "size", "loose", "loose_size")])
    blocks_of = lambda r, s: F.ceil(F.greatest(r / BLOCK_ROWS, s / BLOCK_SHINGLES)).cast("int")
    whole, by_comp = blocks_of(F.col("rows"), F.col("size")) == 1, F.col("top.rows") >= F.col("loose")
    r, s = F.when(by_comp, F.col("top.rows")).otherwise(F.col("loose")), F.when(by_comp, F.col("top.size")).otherwise(F.col("loose_size"))
    return per.select("key", F.when(~whole & by_comp, F.col("top.comp")).alias("main"), F.when(whole, 1).otherwise(blocks_of(F.col("rows") - r, F.col("size") - s)).alias("others"), F.when(whole, 0).otherwise(blocks_of(r, s)).alias("mains"))


def compared(rows: DataFrame, plan: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links among the rows of each group, by products of pairs of its blocks."""
    alone = F.expr("others + mains = 1")
    dealt = rows.join(_few(plan), "key").withColumn("in_main", F.when(alone, F.lit(False)).when(F.col("main").isNotNull(), F.col("comp") == F.col("main")).otherwise(~F.col("index")))
    number = F.when(F.col("in_main"), F.col("others") + F.expr("pmod(xxhash64(rep), greatest(mains, 1))")).otherwise(F.expr("pmod(xxhash64(rep), others)")).cast("int")
    dealt = dealt.withColumn("block", number)
    # a group of several blocks has main and other ones
    partner = F.when(alone, F.array(F.lit(0))).when(F.col("in_main"), F.expr("sequence(0, others - 1)")).otherwise(F.filter(F.expr("sequence(0, others + mains - 1)"), lambda k: k != F.col("block")))
    dealt = dealt.select("key", "rep", "comp", "block", F.explode(partner).alias("other")).select("key", "rep", "comp", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"))
    full = dealt.join(sets.select(F.col("rep").alias("of"), "hashes"), F.col("rep") == F.col("of")).select("key", "u", "v", "rep", "comp", "hashes")
    full = full.repartition(partitions(rows.sparkSession), "key", "u", "v").sortWithinPartitions("key", "u", "v")
    return full.mapInArrow(_units(percent), "a long, b long")


def finish(reps: DataFrame, root: DataFrame, docs: DataFrame, n_words: int, percent: int, trees: int, prefix: int) -> DataFrame:
    """a, b: the links that regions of several components still hold, so that no pair of a region is left untried.

    A region that is one block is compared as it is.  The rows of larger ones are joined by
    their rare shingles (``prefix_rows``), so only rows that may be links meet.
    """
    known = reps.join(root, F.col("rep") == F.col("node"), "left").select("rep", "n_shingles", "sig", F.coalesce("root", "rep").alias("comp"))
    rows = region_rows(staged(known, "rooted"), trees, prefix).withColumn("index", F.lit(True))
    # two rows have been tried as neighbours
    rows = open_groups(rows, 3, "open-rows")
    plan = staged(block_plan(rows), "blocks")
    small, large = plan.where("others + mains = 1"), plan.where("others + mains > 1").select("key")
    members = lambda df, *more: df.select("rep", *more).distinct()
    ids = staged(members(rows).withColumnRenamed("rep", "doc_id"), "open-ids")
    sets = staged(shingle_sets(docs.join(_few(ids), "doc_id", "left_semi").distinct(), n_words).withColumnRenamed("doc_id", "rep"), "open-sets")
    links = compared(rows, small, sets, percent)
    if large.limit(1).count():
        wide = staged(sets.join(_few(staged(members(rows.join(_few(large), "key"), "comp"), "large-ids")), "rep"), "large-sets")
        met = open_groups(prefix_rows(wide, rarity(wide), percent), 2, "prefix-rows")
        links = links.unionByName(compared(met, staged(block_plan(met), "prefix-blocks"), wide, percent))
    return staged(links.distinct(), "finished")


def key_length(percent: int, trees: int, most: int = 5) -> int:
    """The longest key, ``most`` values or fewer, of which two documents at the threshold share one in any tree but once in 10,000 times."""
    fit = [k for k in range(1, most + 1) if (1 - (percent / 100) ** k) ** trees <= 1e-4]
    if not fit:
        raise ValueError(f"{trees} trees do not find links at {percent} %; take more")
    return fit[-1]


def tail_agree(percent: float) -> int:
    """Tail values that agree at the threshold, three and a third standard deviations below the mean: 18 of 32 at 80 %."""
    s = percent / 100
    return int(TAIL * s - 3.34 * (TAIL * s * (1 - s)) ** 0.5)


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80, trees: int = 24, prefix: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text); the key's length follows from the threshold."""
    prefix = prefix or key_length(percent, trees)
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    ratio = percent / 100
    sig = staged(signatures(docs, n_words, trees * prefix), "signatures")
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    reps = staged(classes, "classes")
    pairs = candidates(reps, trees, prefix, ratio)
    links = confirm(pairs.where("kind = 0"), known, n_words, percent)
    root = connected_components(links)
    ra, rb = (root.select(F.col("node").alias(f"n{c}"), F.col("root").alias(f"r{c}")) for c in "ab")
    open_pairs = pairs.where("kind = 1").join(ra, F.col("a") == F.col("na"), "left").join(rb, F.col("b") == F.col("nb"), "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    more = confirm(staged(open_pairs, "open"), known, n_words, percent)
    member = sig.join(reps.select("set_id", "rep"), "set_id", "left")
    # rows that repeat a doc_id with another text tie their classes together
    twice = sig.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo < hi").limit(1).count()
    links = links.unionByName(more)
    root = connected_components(links)
    last = finish(reps, root, known, n_words, percent, trees, prefix)
    links = root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(last)
    if twice:
        links = links.unionByName(member.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    if twice or last.limit(1).count():
        root = connected_components(links)
    node = F.coalesce("doc_id", "rep") if twice else F.coalesce("rep", "doc_id")
    out = member.select("doc_id", "n_shingles", node.alias("of")).join(root, F.col("of") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "of").alias("component_id")).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, n_words: int = 5, percent: int = 80, **options) -> DataFrame:
    """``docs`` with one document of each component: the smallest ``doc_id``; of rows that repeat it, the one whose text hashes lowest."""
    out = near_duplicates(docs, n_words, percent, **options)
    gone = staged(out.where("not kept").select("doc_id").distinct(), "gone")
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    twice = staged(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "twice")
    if not twice.limit(1).count():
        return left
    again = left.join(twice, "doc_id", "left_semi")
    first = again.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64(*docs.columns))).alias("row")).select("row.*")
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(first)
