"""Mixing sources to target weights: capped water-filling and seeded repetition.

Sources take weights by their order; each target is its weight's share of the budget,
clamped at ``max_epochs`` times the source's size, the excess shared again by weight until
none is above.  Sorted by cap over weight, the clamped sources are a prefix of the sources,
so the level at which the water stands comes from running sums.

A source whose target is q times its size and a rest takes every document q times, and once
more the documents that come first in a seeded hash order, up to the rest; the document
that crosses it is taken if its middle lies before.  That order is resolved in two steps:
sums by source and the hash's first digits, then the documents of one such bucket of each
source.  No step brings the rows of a source together.

Defined results: null text has size 0; a null source is a source, the last; documents that
share a ``doc_id`` are taken or left together; an empty table gives no rows; other columns
stay in ``with_repetitions`` and are dropped in ``mix_sources``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import staged

#: Sources up to this number are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"
MIX = ("mix_size", "mix_source_size", "mix_target", "mix_reps")


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def water_fill(sources: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """source, source_size -> also weight and target. One row for each source, so the two global orders are small."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array([F.lit(w) for w in weights])
    s = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", rest / left)
    # the first source that its level does not fill up sets the level of all after it
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(all_rows).getField("level"))
    return s.select("source", "source_size", "weight", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).alias("target"))


def plan(sized: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int, digits: int = 3) -> DataFrame:
    """For each source: source_size, target, whole repetitions, and the last hash key that is taken once more.

    ``sized`` has source, key and size.
    """
    by_bucket = staged(sized.groupBy("source", F.substring("key", 1, digits).alias("bucket")).agg(F.sum("size").alias("size")), "buckets")
    targets = water_fill(by_bucket.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    targets = staged(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cum = by_bucket.withColumn("below", F.coalesce(F.sum("size").over(w), F.lit(0)))
    t = targets.select(F.col("source").alias("s2"), "rest")
    small = F.broadcast(t) if targets.count() <= BROADCAST_SOURCES else t
    edge = cum.join(small, F.col("source").eqNullSafe(F.col("s2"))).where("below < rest and below + size > rest").select("source", "bucket", "below", "rest")
    edge = staged(edge, "edges")
    e = edge.select(F.col("source").alias("s3"), "bucket", "below", "rest")
    e = F.broadcast(e) if edge.count() <= BROADCAST_SOURCES else e
    inside = sized.join(e, F.col("source").eqNullSafe(F.col("s3")) & (F.substring("key", 1, digits) == F.col("bucket")))
    inside = inside.groupBy("source", "below", "rest", "key").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    taken = inside.withColumn("at", F.col("below") + F.coalesce(F.sum("size").over(upto), F.lit(0))).where(F.col("at") + F.col("size") / 2 <= F.col("rest"))
    last = taken.groupBy("source").agg(F.max("key").alias("last"))
    # a source whose rest ends at a bucket's border takes all buckets below it
    full = cum.join(small, F.col("source").eqNullSafe(F.col("s2"))).where("below + size <= rest and size > 0").groupBy("source").agg(F.max("bucket").alias("full"))
    out = targets
    for extra, name in ((last, "last"), (full, "full")):
        extra = extra.withColumnRenamed("source", "sx")
        out = out.join(extra, F.col("source").eqNullSafe(F.col("sx")), "left").drop("sx")
    upper = F.coalesce(F.col("last"), F.concat("full", F.lit("g")))  # 'g' comes after every hex digit
    return staged(out.select("source", "source_size", "weight", "target", "whole", F.coalesce(upper, F.lit("")).alias("upper")), "plan")


def with_repetitions(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_epochs: int = 3, seed: int = 17, digits: int = 3, size_column: str | None = None) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_reps, how often the mix takes each row; they replace input columns of these names."""
    out = _repetitions(docs, weights, share, max_epochs, seed, digits, size_column)
    return out.select(*[F.col("mix_row")[c].alias(c) for c in docs.columns if c.lower() not in MIX], *MIX)


def _repetitions(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, max_epochs: int = 3, seed: int = 17, digits: int = 3, size_column: str | None = None) -> DataFrame:
    """mix_row, the row as a struct, and the columns of ``MIX``."""
    size = F.col(size_column) if size_column else text_size(F.col("text"))
    sized = docs.select("source", hash_key(seed).alias("key"), size.alias("size"))
    p = plan(sized if size_column else staged(sized, "sized"), weights, share, max_epochs, digits)
    right = p.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("whole").alias("mix_whole"), F.col("upper").alias("mix_upper"))
    right = F.broadcast(right) if p.count() <= BROADCAST_SOURCES else right
    out = docs.select(F.struct(*docs.columns).alias("mix_row"), F.col("source").alias("mix_of"), hash_key(seed).alias("mix_key"), size.alias("mix_size"))
    out = out.join(right, F.col("mix_of").eqNullSafe(F.col("mix_source")))
    reps = F.col("mix_whole") + F.when((F.col("mix_whole") < max_epochs) & (F.col("mix_key") <= F.col("mix_upper")), 1).otherwise(0)
    return out.withColumn("mix_reps", reps).select("mix_row", *MIX)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes) for every row; the size is computed once."""
    sized = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_size(F.col("text")).alias("size")), "sizes")
    out = with_repetitions(sized, size_column="size", **options)
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_reps")).alias("taken"))


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    out = _repetitions(docs, **options)
    return out.select("mix_row", F.explode(F.array_repeat(F.lit(1), F.col("mix_reps").cast("int")))).select("mix_row.*")
