"""Greedy matching in a stated order, found in parallel rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import staged


def greedy_matching(edges: DataFrame, a: str, b: str, order: list[str], bipartite: bool = False, max_rounds: int = 200) -> DataFrame:
    """The edges that a greedy pass in the order of ``order``, a and b takes, no node twice.

    An edge that comes first at both of its ends is taken by the pass whatever else happens, so
    a round takes all such edges at once and drops what they touch.  Minima are
    combined before the shuffle, so a hot node is one row for each task.  With ``bipartite`` the two
    ends are different kinds of nodes even where their ids are equal.  Null ends are ignored.
    """
    tag = lambda c, side: F.struct(F.lit(side if bipartite else 0).alias("side"), F.col(c).alias("id"))
    left = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b, tag(a, 0).alias("_u"), tag(b, 1).alias("_v"), F.struct(*order, a, b).alias("_p"))
    open_ = staged((left if bipartite else left.where(F.col(a) != F.col(b))).distinct(), "open")
    taken = None
    for _ in range(max_rounds):
        low = open_.select(F.explode(F.array("_u", "_v")).alias("_n"), "_p").groupBy("_n").agg(F.min("_p").alias("_low"))
        first = open_
        for end in ("_u", "_v"):
            first = first.join(low.select(F.col("_n").alias(end), F.col("_low").alias("_p")), [end, "_p"], "left_semi")
        got = staged(first.select(a, b, "_u", "_v"), "taken")
        if not got.limit(1).count():
            return taken if taken is not None else got.select(a, b)
        taken = got.select(a, b) if taken is None else taken.unionByName(got.select(a, b))
        used = got.select(F.explode(F.array("_u", "_v")).alias("_n"))
        for end in ("_u", "_v"):
            open_ = open_.join(used.withColumnRenamed("_n", end), end, "left_anti")
        open_ = staged(open_, "open")
    raise RuntimeError(f"matching did not settle in {max_rounds} rounds")


def nearest_matching(queries: DataFrame, items: DataFrame, tolerance: int, by: list[str], differ: str, seed: int, block: int = 20_000, max_rounds: int = 10_000) -> DataFrame:
    """query and item: what ``greedy_matching`` takes in the order of distance, hash, query and item, without a list of candidates.

    ``queries``: query, value, ``by`` and ``differ``; ``items``: item and the same columns; keys are unique.  Candidates are equal in ``by``, differ in ``differ``
    and lie at most ``tolerance`` (whole numbers) apart in value.  In a round every open query asks for its first item of the nearest distance not yet
    used up that is free or held by a later pair; an item keeps the first that asks, and whom it lets go is open again.  As both sides
    go by one order, this ends in the pairs of the greedy pass.  A query meets its items as arrays of a block and passes on
    one for each block, so rows are queries times blocks.  Rows with nulls are ignored.
    """
    cols = [*by, differ]
    n = max(1, -(-items.count() // block))
    fixed = items.select("item", "value", *cols).dropna().withColumn("_k", F.pmod(F.xxhash64("item"), F.lit(n)))
    open_ = staged(queries.select("query", "value", *cols).dropna().withColumn("off", F.lit(0)), "open")
    asked, held, kind = open_, None, dict(open_.dtypes)["query"]
    for _ in range(max_rounds):
        if not open_.limit(1).count():
            return held.select("query", "item") if held is not None else asked.join(fixed.select("item"), F.lit(False)).select("query", "item")
        order = F.struct("off", "h", "query").alias("held")
        known = fixed.withColumn("held", F.lit(None).cast(f"struct<off: int, h: string, query: {kind}>")) if held is None else fixed.join(held.select("item", order), "item", "left")
        blocks = known.groupBy("value", *by, "_k").agg(F.collect_list(F.struct("item", differ, "held")).alias("xs"))
        asks = open_.withColumn("value", F.explode(F.array_distinct(F.array(F.col("value") - F.col("off"), F.col("value") + F.col("off")))))
        named = lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query").cast("string"), x["item"].cast("string"))).alias("h"), x["item"].alias("item"), x["held"].alias("held"))
        fits = lambda s: s["held"].isNull() | (F.struct(F.col("off"), s["h"].alias("h"), F.col("query")) < s["held"])
        first = F.array_min(F.filter(F.transform(F.filter("xs", lambda x: x[differ] != F.col(differ)), named), fits))
        found = asks.join(blocks, ["value", *by]).select("query", first.alias("m")).where("m is not null").groupBy("query").agg(F.min(F.struct("m.h", "m.item")).alias("m"))
        tried = staged(open_.join(found, "query", "left"), "tried")
        own = tried.where("m is not null").select("query", "value", *cols, "off", "m.h", "m.item")
        everyone = own if held is None else own.unionByName(held)
        best = everyone.groupBy("item").agg(F.min(F.struct("off", "h", "query")).alias("w")).select("item", F.col("w.query").alias("query"), F.lit(True).alias("won"))
        settled = staged(everyone.join(best, ["item", "query"], "left"), "settled")
        held = settled.where("won").drop("won")
        further = tried.where("m is null").withColumn("off", F.col("off") + 1).where(F.col("off") <= tolerance)
        open_ = staged(settled.where("won is null").select("query", "value", *cols, "off").unionByName(further.select("query", "value", *cols, "off")), "open")
    raise RuntimeError(f"matching did not settle in {max_rounds} rounds")
