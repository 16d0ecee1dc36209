"""Bootstraps over any unit: multiplicities from MD5 digests, so that other engines find the same ones.

A digest of (seed, block, unit) holds the draws of ``DRAWS`` replicates, twenty bits each.
Areas under the curve take one pass over rows that are dealt and sorted by score: a task
holds running sums for each replicate and gives three numbers for each, so what is
shuffled are the rows, once, and not rows times replicates.

Rows are narrow and their draws dear, so rows are dealt to a stated number of tasks (``_tasks``): by their bytes,
Spark would join them into few.  What a task holds is bounded by ``STEP`` and ``HELD`` whatever the rows and replicates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.running import running_sums, score_bucket
from millrace.session import staged

try:  # the same digests without the set-up of a call into OpenSSL, which takes longer than a digest
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: Distribution function of Poisson(1) at 0, 1, ...
CDF = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
DRAWS = 6
#: Numbers of one step of a task: rows times replicates.
STEP = 100_000
#: Bytes of units' draws that a task keeps, one for each replicate.
HELD = 16_000_000
#: Rows of a task, where there are enough to occupy all cores.
ROWS = 50_000


def multiplicity(unit: Column, seed: int | str) -> Column:
    """A Poisson(1) count for column rep from the digest of (seed, block of replicates, unit); nothing is shuffled."""
    at = F.col("rep") - 1
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.floor(at / DRAWS).cast("string"), unit.cast("string")))
    u = F.conv(F.substring(digest, at % DRAWS * 5 + 1, F.lit(5)), 16, 10).cast("int") / F.lit(1048576.0)
    return sum(((u >= c).cast("int") for c in CDF[1:]), (u >= CDF[0]).cast("int"))


def replicate(df: DataFrame, n: int, weight: Column) -> DataFrame:
    """Each row in each of ``n`` replicates that draws it, with rep and w; ``weight`` may use rep.  For rows that are units already."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("w", weight).where("w > 0")


@lru_cache(maxsize=8)
def _heads(seed: str, blocks: int) -> list[bytes]:
    return [f"{seed}|{b}|".encode() for b in range(blocks)]


def _digests(unit: str, blocks: int) -> np.ndarray:
    """The digests of a unit (with its seed before the first bar), one row for each block."""
    seed, name = unit.split("|", 1)
    tail = name.encode()
    return np.frombuffer(b"".join([md5(head + tail).digest() for head in _heads(seed, blocks)]), np.uint8).reshape(blocks, 16)


@lru_cache(maxsize=1)
def _counts() -> np.ndarray:
    """The count of each draw of twenty bits."""
    return np.searchsorted(np.array(CDF), np.arange(1 << 20) / 1048576.0, side="right").astype(np.uint8)


def poisson(unit: str, n: int) -> np.ndarray:
    """The counts of ``multiplicity`` for replicates 1 to n."""
    d = _digests(unit, -(-n // DRAWS))[:, :15].reshape(-1, 3, 5).astype(np.int32)  # two draws in five bytes
    v = np.stack([d[..., 0] << 12 | d[..., 1] << 4 | d[..., 2] >> 4, (d[..., 2] & 15) << 16 | d[..., 3] << 8 | d[..., 4]], 2)
    return _counts()[v.ravel()[:n]]


def coin(unit: str, n: int) -> np.ndarray:
    """n fair bits, the first of them 0: the observed order.  A unit that begins with ! gets the opposite bits."""
    other = unit.startswith("!")
    x = np.unpackbits(_digests(unit.lstrip("!"), -(-n // 128)).ravel())[:n]
    x[0] = 0
    return 1 - x if other else x


AREA = "part int, groups array<string>, p array<double>, n array<double>, u array<double>"


def _weights(n: int, draw: Callable[[str, int], np.ndarray]):
    """Units of rows -> rows x replicates; a row weighs the product of its different units' draws."""
    known: dict[str, np.ndarray] = {}
    most, ones = max(1, HELD // n), np.ones(n, np.uint8)

    def drawn(x: str) -> np.ndarray:
        if x not in known:
            if len(known) >= most:
                known.clear()
            known[x] = draw(x, n)
        return known[x]

    def weights(units: list[list[str]]) -> np.ndarray:
        own = [list(dict.fromkeys(us)) for us in units]
        out = np.ones((len(units), n))
        for k in range(max(map(len, own), default=0)):
            out *= np.stack([drawn(us[k]) if k < len(us) else ones for us in own])
        return out

    return weights


def _tasks(rows: DataFrame) -> int:
    """Tasks for rows that are read back: all cores, then one for each ``ROWS``."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))


def sums_by_replicate(df: DataFrame, values: list[Column], n: int, units: list[Column], draw: Callable = poisson) -> DataFrame:
    """rep and s0, s1, ...: the weighted sum of each of ``values`` (null: 0) in each replicate; nothing but sums and the rows, once, is shuffled."""
    names = [f"s{k}" for k in range(len(values))]

    def run(batches):
        weights, total = _weights(n, draw), np.zeros((len(names), n))
        step = max(1, STEP // n)
        for b in batches:
            units, x = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), float).reshape(-1, len(names))
            for i in range(0, len(x), step):
                total += x[i : i + step].T @ weights(units[i : i + step])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, n + 1), pa.int32()), *(pa.array(c) for c in total)], ["rep", *names])

    rows = staged(df.select(F.array(*units).alias("units"), F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values]).alias("values")), "drawn")
    out = rows.repartition(_tasks(rows)).mapInArrow(run, "rep int, " + ", ".join(f"{c} double" for c in names))
    return out.groupBy("rep").agg(*[F.sum(c).alias(c) for c in names])


def _areas(n: int, draw: Callable[[str, int], np.ndarray]):
    """For each group of a partition sorted by (groups, score): sums of both classes and of the pairs in order, by replicate.

    Of ``state``, u counts each pair twice, so that ties are whole numbers; score, bp and bn are the last score and the weights of its rows so far.
    """

    def run(batches):
        weights = _weights(n, draw)
        part, group, state = TaskContext.get().partitionId(), None, None

        def finish():
            p, q, u = state[:3]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([list(group)], pa.list_(pa.string())), *(pa.array([x], pa.list_(pa.float64())) for x in (p, q, u / 2))], [c.split()[0] for c in AREA.split(", ")])

        step = max(1, STEP // n)
        for b in batches:
            groups, score, y, units = (b.column(c).to_pylist() for c in ("groups", "score", "y", "units"))
            i = 0
            while i < len(y):
                j = i
                while j < len(y) and j - i < step and groups[j] == groups[i]:
                    j += 1
                if tuple(groups[i]) != group:
                    if group is not None:
                        yield finish()
                    group, state = tuple(groups[i]), [np.zeros(n), np.zeros(n), np.zeros(n), None, np.zeros(n), np.zeros(n)]
                w, s, one = weights(units[i:j]), np.array(score[i:j]), np.array(y[i:j]) == 1
                p, q, u, last, bp, bn = state
                # places of scores; infinite ones and NaN, which sorts last, equal themselves
                place = np.r_[0, np.cumsum(~((s[1:] == s[:-1]) | np.isnan(s[:-1])))]
                again = last is not None and (s[0] == last or np.isnan(last))
                wp, wn, sp, sn = w[one], w[~one], place[one], place[~one]
                # pairs inside the step, then with the rows before it, of which those of the step's first score count half
                u += (wp * ((np.sign(sp[:, None] - sn) + 1) @ wn)).sum(axis=0) + 2 * wp.sum(axis=0) * q
                if again:
                    u += bp * wn[sn == 0].sum(axis=0) - bn * wp[sp == 0].sum(axis=0)
                p += wp.sum(axis=0)
                q += wn.sum(axis=0)
                if place[-1] or not again:
                    bp, bn = np.zeros(n), np.zeros(n)
                state = [p, q, u, s[-1], bp + wp[sp == place[-1]].sum(axis=0), bn + wn[sn == place[-1]].sum(axis=0)]
                i = j
        if group is not None:
            yield finish()

    return run


def auc_by_replicate(df: DataFrame, score: str, n: int, units: list[Column], by: tuple[str, ...] = (), draw: Callable = poisson) -> DataFrame:
    """rep, ``by`` and v, the weighted area (ties one half) of each of ``n`` replicates; none where a class has no weight.

    ``units``: strings 'seed|unit'; a row weighs the product of the draws of its different units.
    ``df`` has y (1 or 0).  A null score leaves the row out.
    """
    rows = df.where(F.col(score).isNotNull() & F.col("y").isNotNull()).select(F.array(*[F.col(c).cast("string") for c in by]).cast("array<string>").alias("groups"), F.col(score).cast("double").alias("score"), "y", F.array(*units).alias("units"))
    rows = staged(rows, "scored")  # read twice: for the ranges and for the areas
    dealt = rows.repartitionByRange(_tasks(rows), "groups", "score").sortWithinPartitions("groups", "score")
    a = dealt.mapInArrow(_areas(n, draw), AREA)
    a = a.select("part", "groups", F.posexplode(F.arrays_zip("p", "n", "u")).alias("rep", "x")).select("part", "groups", (F.col("rep") + 1).alias("rep"), "x.*")
    # one row for each task, group and replicate
    before = F.coalesce(F.sum("n").over(Window.partitionBy("groups", "rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    a = a.withColumn("u", F.col("u") + F.col("p") * before).groupBy("groups", "rep").agg(F.sum("u").alias("u"), (F.sum("p") * F.sum("n")).alias("d")).where("d > 0")
    kinds = dict(df.dtypes)
    return a.select("rep", *[F.col("groups")[i].cast(kinds[c]).alias(c) for i, c in enumerate(by)], (F.col("u") / F.col("d")).alias("v"))


def interval(per_rep: DataFrame, *by: str) -> DataFrame:
    """valid, mean, lo and hi (2.5 % and 97.5 % points) of v over replicates; replicates without a value don't count."""
    r = lambda c: F.round(F.round(c, 12), 6)  # noqa: E731  # a tie stays one whatever the order of the sums
    return per_rep.groupBy(*by).agg(F.count("v").alias("valid"), r(F.avg("v")).alias("mean"), r(F.percentile("v", 0.025)).alias("lo"), r(F.percentile("v", 0.975)).alias("hi"))


def paired_permutation(df: DataFrame, first: str, second: str, key: Column, n: int, seed: int) -> DataFrame:
    """p = (c + 1) / (n + 1), c the permutations whose difference of areas is at least the observed one, and the difference.

    A coin for each row and permutation swaps the two scores.  Both are one pool of points: in a permutation a point counts for the first area or
    for the second.  Pairs of points of the two areas cancel out but for their sum, so the difference is linear in the coins:
    with g the points of the other class that a point of the pool is on the right side of (ties one half), each row adds half of its points' difference
    in g, with the coin's sign.  The g are counted once, and a permutation is one weighted sum.  Rows without y or a score are left out.
    """
    rows = df.where(F.col("y").isNotNull() & F.col(first).isNotNull() & F.col(second).isNotNull()).select(F.concat(F.lit(f"{seed}|"), key).alias("unit"), (F.col("y") == 1).alias("one"), F.col(first).cast("double").alias("a"), F.col(second).cast("double").alias("b"))
    rows = staged(rows, "paired")
    total = rows.agg(F.count_if("one").cast("double").alias("p"), F.count_if(~F.col("one")).cast("double").alias("q"))
    points = rows.select("one", F.explode(F.array("a", "b")).alias("s")).groupBy("s").agg(F.count_if("one").alias("p"), F.count_if(~F.col("one")).alias("q"))
    below = running_sums(points, [], "s", ["p", "q"], F.when(F.isnan("s"), F.lit((1 << 63) - 1)).otherwise(score_bucket("s"))).crossJoin(F.broadcast(total.select((2 * F.col("p")).alias("all_p"))))  # one row
    g = staged(below.select("s", (F.col("below_q") + F.col("q") / 2).alias("g1"), (F.col("all_p") - F.col("below_p") - F.col("p") / 2).alias("g0")), "placed")
    for c in ("a", "b"):
        rows = rows.join(g.select(F.col("s").alias(c), F.col("g1").alias(f"{c}1"), F.col("g0").alias(f"{c}0")), c)
    gain = F.when(F.col("one"), F.col("b1") - F.col("a1")).otherwise(F.col("b0") - F.col("a0"))
    gains = staged(rows.select("unit", gain.alias("g")), "gains")
    whole = total.crossJoin(gains.agg(F.sum("g").alias("g")))  # one row
    drawn = sums_by_replicate(gains, [F.col("g")], n + 1, [F.col("unit")], draw=coin).crossJoin(F.broadcast(whole)).where("p > 0 and q > 0")
    d = drawn.select("rep", F.round(F.abs((F.col("s0") - F.col("g") / 2) / (F.col("p") * F.col("q"))), 12).alias("d"))
    seen = d.where("rep = 1").select(F.col("d").alias("d0"))
    out = d.where("rep > 1").crossJoin(F.broadcast(seen))  # one row
    return out.agg(((F.count_if(F.col("d") >= F.col("d0")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"), F.first("d0").alias("difference"))
