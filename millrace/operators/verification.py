"""Verification metrics over (score, label) rows: everything is a block of equal scores and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.running import running_sums, score_bucket


def blocks(df: DataFrame, score: str, label: str, by: list[str] | None = None, weight: Column | None = None, descending: bool = False) -> DataFrame:
    """A row for each score: p and n (weights of its positives and negatives), below_p and below_n before it in the order."""
    by = by or []
    w = F.lit(1).cast("long") if weight is None else weight
    p, n = (F.sum(F.when(F.col(label) == v, w).otherwise(F.lit(0))).alias(c) for v, c in ((1, "p"), (0, "n")))
    return running_sums(df.groupBy(*by, score).agg(p, n), by, score, ["p", "n"], score_bucket(score), descending)


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None, weight: Column | None = None, name: str = "auc") -> DataFrame:
    """Mann-Whitney area with ties at one half; null where a class is missing."""
    b = blocks(df, score, label, by, weight)
    area = F.sum(F.col("p") * (F.col("below_n") + F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))
    return b.groupBy(*(by or [])).agg(area.alias(name))


def leave_one_out_auc(df: DataFrame, score: str, label: str, subjects: list[str], everyone: DataFrame, name: str = "auc") -> DataFrame:
    """subject and ``name``, the area over the rows that name it in none of the columns ``subjects``, for each subject of ``everyone``.

    No row is copied for the subjects that it does not name: from the area of all rows goes what a subject's
    rows win or lose against all rows of the other class, less the pairs within the subject, which that counts twice.
    Doubled areas are whole numbers and are summed as such.  Null scores are left out; null where a class is missing.
    """
    df = df.where(F.col(score).isNotNull())
    whole = lambda c: c.cast("decimal(19,0)")
    won = lambda p, n, below: whole(p) * whole(2 * below + n)
    all_ = blocks(df, score, label).select(F.col(score).alias("_s"), *[F.col(c).alias(f"all_{c}") for c in ("p", "n", "below_p", "below_n")])
    total = all_.agg(F.coalesce(F.sum("all_p"), F.lit(0)).alias("total_p"), F.coalesce(F.sum("all_n"), F.lit(0)).alias("total_n"), F.sum(won(F.col("all_p"), F.col("all_n"), F.col("all_below_n"))).alias("total_u"))
    named = df.select(score, label, F.explode(F.array_distinct(F.array(*subjects))).alias("subject")).where("subject is not null")
    own = blocks(named, score, label, ["subject"]).join(all_, F.col(score) == F.col("_s")).crossJoin(F.broadcast(total))  # one row
    above_p = F.col("total_p") - F.col("all_below_p") - F.col("all_p")
    touched = won(F.col("p"), F.col("all_n"), F.col("all_below_n")) + won(F.col("n"), F.col("all_p"), above_p) - won(F.col("p"), F.col("n"), F.col("below_n"))
    per = own.groupBy("subject").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(touched).alias("u"))
    left = everyone.select("subject").join(per, "subject", "left").crossJoin(F.broadcast(total)).na.fill(0, ["p", "n"])  # one row
    area = (F.col("total_u") - F.coalesce("u", F.lit(0))).cast("double") / 2
    pairs = (F.col("total_p") - F.col("p")).cast("double") * (F.col("total_n") - F.col("n"))
    return left.select("subject", (area / F.nullif(pairs, F.lit(0.0))).alias(name))


def rates(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """far and tar of each threshold 'score at least', one row for each score."""
    by = by or []
    b = blocks(df, score, label, by, descending=True)
    total = df.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("_P"), F.count_if(F.col(label) == 0).alias("_N"))
    joined = b.join(total, by) if by else b.crossJoin(F.broadcast(total))  # one row
    return joined.select(*by, score, ((F.col("below_n") + F.col("n")) / F.col("_N")).alias("far"), ((F.col("below_p") + F.col("p")) / F.col("_P")).alias("tar"))


def eer(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """The smallest larger one of false accept and false reject rates."""
    return rates(df, score, label, by).groupBy(*(by or [])).agg(F.min(F.greatest(F.col("far"), 1 - F.col("tar"))).alias("eer"))


def tar_at_far(df: DataFrame, score: str, label: str, target: float, by: list[str] | None = None) -> DataFrame:
    """Tie-safe: the best true accept rate among thresholds whose false accept rate is at most the target."""
    r = rates(df, score, label, by)
    return r.groupBy(*(by or [])).agg(F.coalesce(F.max(F.when(F.col("far") <= target, F.col("tar"))), F.lit(0.0)).alias("tar"))


def midranks(df: DataFrame, value: str, by: list[str] | None = None, name: str = "rank", width: float = 1 / 256) -> DataFrame:
    """``df`` with the average-tie rank of ``value``, from 1."""
    by = by or []
    counted = running_sums(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c")), by, value, ["c"], score_bucket(value, width))
    ranks = counted.select(*[F.col(c).alias(f"_r{c}") for c in by], F.col(value).alias("_v"), (F.col("below_c") + (F.col("c") + 1) / 2).alias(name))
    cond = F.col(value).eqNullSafe(F.col("_v"))
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r{c}"))
    return df.join(ranks, cond).drop("_v", *[f"_r{c}" for c in by])


def delong(df: DataFrame, first: str, second: str, label: str, key: str) -> DataFrame:
    """Areas of two scores on the same rows, the variance of their difference and z.

    A positive's component is the share of negatives that it beats, a negative's the share of positives
    that beat it, ties at one half; both come from the running totals of its score's block.
    """
    sides = []
    for name, score in (("v1", first), ("v2", second)):
        b = blocks(df, score, label)
        total = b.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
        b = b.crossJoin(F.broadcast(total)).select(  # one row
            F.col(score).alias("_s"), ((F.col("below_n") + F.col("n") / 2) / F.col("all_n")).alias("beats"), ((F.col("all_p") - F.col("below_p") - F.col("p") / 2) / F.col("all_p")).alias("beaten"))
        sides.append(df.select(key, label, F.col(score).alias("_x")).join(b, F.col("_x") == F.col("_s")).select(key, label, F.when(F.col(label) == 1, F.col("beats")).otherwise(F.col("beaten")).alias(name)))
    v = sides[0].join(sides[1].drop(label), key)
    pos = lambda c: F.when(F.col(label) == 1, F.col(c))
    d = F.col("v1") - F.col("v2")
    out = v.agg(F.avg(pos("v1")).alias("auc1"), F.avg(pos("v2")).alias("auc2"), F.var_samp(F.when(F.col(label) == 1, d)).alias("vp"), F.var_samp(F.when(F.col(label) == 0, d)).alias("vn"), F.count_if(F.col(label) == 1).alias("all_p"), F.count_if(F.col(label) == 0).alias("all_n"))
    var = F.col("vp") / F.col("all_p") + F.col("vn") / F.col("all_n")
    return out.select("auc1", "auc2", var.alias("var"), ((F.col("auc1") - F.col("auc2")) / F.sqrt(var)).alias("z"))


def calibration_bins(df: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    b = F.floor(F.least(F.col(prob) * bins, F.lit(bins - 1)))
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("confidence"), F.avg(label).alias("accuracy"))


def ece_brier(df: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed, and the Brier score."""
    per = df.groupBy(F.floor(F.least(F.col(prob) * bins, F.lit(bins - 1))).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(prob).alias("c"), F.avg(label).alias("a"), F.sum((F.col(prob) - F.col(label)) * (F.col(prob) - F.col(label))).alias("sq"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"))


def total_variation(df: DataFrame, value: str, label: str) -> DataFrame:
    """Half the L1 distance of the two classes' distributions of ``value`` and the accuracy of an oracle that sees only it."""
    n = df.groupBy(value).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    t = n.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    tv = n.crossJoin(F.broadcast(t)).agg((F.sum(F.abs(F.col("p") / F.col("all_p") - F.col("q") / F.col("all_q"))) / 2).alias("tv"))  # one row
    return tv.select("tv", ((1 + F.col("tv")) / 2).alias("oracle_accuracy"))


def ks_distance(df: DataFrame, value: str, label: str, width: float = 1 / 256) -> DataFrame:
    """The largest gap between the classes' empirical distribution functions."""
    b = df.groupBy(value).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    r = running_sums(b, [], value, ["p", "n"], score_bucket(value, width))
    t = b.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    gap = F.abs((F.col("below_p") + F.col("p")) / F.col("all_p") - (F.col("below_n") + F.col("n")) / F.col("all_n"))
    return r.crossJoin(F.broadcast(t)).agg(F.max(gap).alias("ks"))  # one row


def top_k(df: DataFrame, k: int, order: list[Column], *by: str, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
