"""Blinded annotation packs: what has to hold before they go out and after they come back, and the refusal if it does not.

A pack is a table with ``task``, ``place`` (its order), ``response`` and payload columns. Checks give one row each with the number
of violations; ``refuse`` raises if any is above 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blind(key: str, seed: str) -> Column:
    """An opaque task id."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256), 1, 12)


def _differ(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns], F.lit(False))


def _report(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.unpivot([], p.columns, "check_name", "violations").select("check_name", F.coalesce(F.col("violations").cast("long"), F.lit(0).cast("long")).alias("violations")) for p in parts])


def _repeats(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("task").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias(name))


def outgoing_checks(a: DataFrame, b: DataFrame, key: DataFrame, payload: list[str], shown: list[str], leak: str) -> DataFrame:
    """check_name and violations of two annotators' packs and their closed key (task, source).

    Repeated tasks, tasks that a pack or the key lacks, payloads that differ, responses that are there already, ``shown`` columns that hold the
    task's source or match the pattern ``leak``; and the packs' order: as many violations as tasks if no task stands elsewhere.
    """
    n = lambda c: F.count_if(c)
    one = lambda t: t.dropDuplicates(["task"])
    left, right, closed = one(a).alias("l"), one(b).alias("r"), one(key).alias("k")
    both = left.join(right, F.col("l.task") == F.col("r.task"), "full").join(closed, F.coalesce("l.task", "r.task") == F.col("k.task"), "full")
    met = F.col("l.task").isNotNull() & F.col("r.task").isNotNull()
    moved = n(met & (F.col("l.place") != F.col("r.place")))
    sides = both.agg(
        n(F.col("l.task").isNull()).alias("missing_a"), n(F.col("r.task").isNull()).alias("missing_b"), n(F.col("k.task").isNull()).alias("missing_key"),
        n(met & _differ("l", "r", payload)).alias("payload"), F.when(moved > 0, 0).otherwise(n(met)).alias("same_order"))
    every = a.select("task", "response", *shown).unionByName(b.select("task", "response", *shown)).join(key.select("task", F.col("source").cast("string").alias("source")).dropDuplicates(["task"]), "task", "left")
    leaks = reduce(lambda x, y: x | y, [F.coalesce(F.col(c).cast("string").rlike(leak) | F.col(c).cast("string").contains(F.col("source")), F.coalesce(F.col(c).cast("string").rlike(leak), F.lit(False))) for c in shown], F.lit(False))
    return _report([_repeats(a, "repeated_a"), _repeats(b, "repeated_b"), _repeats(key, "repeated_key"), sides, every.agg(n(F.col("response").isNotNull()).alias("answered"), n(leaks).alias("leaked"))])


def returned_checks(sent: DataFrame, returned: DataFrame, frozen: list[str], responses: list[str]) -> DataFrame:
    """check_name and violations of a pack that came back: repeated, lost and added tasks, tasks in another place, frozen fields that changed, responses that are missing or not allowed."""
    n = lambda c: F.count_if(c)
    s, r = sent.dropDuplicates(["task"]).alias("s"), returned.dropDuplicates(["task"]).alias("r")
    both = s.join(r, F.col("s.task") == F.col("r.task"), "full")
    here = F.col("s.task").isNotNull() & F.col("r.task").isNotNull()
    sides = both.agg(
        n(F.col("r.task").isNull()).alias("lost"), n(F.col("s.task").isNull()).alias("added"), n(here & ~F.col("s.place").eqNullSafe(F.col("r.place"))).alias("moved"), n(here & _differ("s", "r", frozen)).alias("frozen"),
        n(here & F.col("r.response").isNull()).alias("unanswered"), n(here & F.col("r.response").isNotNull() & ~F.col("r.response").isin(responses)).alias("not_allowed"))
    return _report([_repeats(returned, "repeated"), sides])


def refuse(report: DataFrame) -> None:
    """ValueError that names the violated checks, if there are any; the driver sees one row for each check."""
    bad = sorted((r["check_name"], r["violations"]) for r in report.where("violations > 0").collect())
    if bad:
        raise ValueError("refused: " + ", ".join(f"{c} ({n})" for c, n in bad))
