"""Maximum matching of a bipartite graph, and least-cost assignment, in rounds of joins.

No step brings a node's edges or the rows to the driver: what goes there are counts that say whether a
round found anything.  All tables of a round are written and read again, so a lost executor
repeats one round at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import staged


@dataclass(frozen=True)
class Matching:
    """``pairs``: the matched edges. ``stuck_left``, ``stuck_right``: what unmatched left nodes reach by alternating paths.

    All neighbours of ``stuck_left`` are in ``stuck_right``, and it is larger by the number of unmatched left nodes: the
    certificate that no matching has more edges (Hall, König).  Both are the same for every maximum matching.
    """

    pairs: DataFrame
    stuck_left: DataFrame
    stuck_right: DataFrame


def maximum_matching(edges: DataFrame, a: str, b: str, seed: int = 17, max_phases: int = 1000) -> Matching:
    """A matching of most edges between the nodes of ``a`` and those of ``b``.

    Each phase grows one tree of alternating paths from every unmatched left node, level by level; a right
    node joins the one tree whose edge hashes lowest, so trees share no node, and every tree that
    reaches an unmatched right node gives one augmenting path.  All these paths are flipped at once, walking
    back from the last level to the roots.  A phase without such a path proves the matching maximum.

    Rows with a null end and repeated rows are ignored; equal ids on both sides are different nodes; no rows give no pairs.
    """
    named = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct()
    e = staged(named, "edges")
    lefts = staged(e.select("u").distinct(), "lefts")
    mates = e.limit(0)
    for phase in range(max_phases):
        roots = staged(lefts.join(mates, "u", "left_anti").select("u", F.col("u").alias("root")), "roots")
        levels, found = _grow(e, mates, roots, seed + phase)
        if not found:
            stuck_right = _union([lv.select("v") for lv in levels]) if levels else mates.select("v").limit(0)
            stuck_left = _union([roots.select("u"), *[lv.where("mate is not null").select(F.col("mate").alias("u")) for lv in levels]])
            return Matching(*[d.withColumnsRenamed({"u": a, "v": b}) for d in (mates, stuck_left, stuck_right)])
        flipped = staged(_paths(levels), "paths")
        mates = staged(mates.join(flipped, "u", "left_anti").unionByName(flipped), "mates")
    raise RuntimeError(f"matching did not settle in {max_phases} phases")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _grow(e: DataFrame, mates: DataFrame, roots: DataFrame, seed: int) -> tuple[list[DataFrame], bool]:
    """Levels (v, parent u, root, mate) of disjoint trees, and whether any reached an unmatched right node."""
    levels, found, frontier = [], False, roots
    while True:
        seen = frontier.join(e, "u")
        if levels:
            seen = seen.join(_union([lv.select("v") for lv in levels]), "v", "left_anti")
        low = F.min(F.struct(F.xxhash64("u", "v", F.lit(seed)).alias("h"), "u", "root")).alias("m")
        claimed = seen.groupBy("v").agg(low).select("v", "m.u", "m.root")
        level = staged(claimed.join(mates.select("v", F.col("u").alias("mate")), "v", "left"), "level")
        n, free = level.agg(F.count(F.lit(1)), F.count_if(F.col("mate").isNull())).first()
        if not n:
            return levels, found
        levels.append(level)
        found = found or bool(free)
        if n == free:
            return levels, found
        # a tree that has reached an unmatched node stops growing
        frontier = level.where("mate is not null").select(F.col("mate").alias("u"), "root").join(_ends(level), "root", "left_anti")


def _ends(level: DataFrame) -> DataFrame:
    return level.where("mate is null").groupBy("root").agg(F.min("v").alias("v"))


def _paths(levels: list[DataFrame]) -> DataFrame:
    """The new pairs (u, v) of all augmenting paths, from their ends back to their roots."""
    pairs, on = [], None
    for d in range(len(levels) - 1, -1, -1):
        last = _ends(levels[d]) if on is None else _ends(levels[d]).unionByName(on)
        step = levels[d].join(last, ["root", "v"]).select("root", "u", "v")
        if d % 4 == 3:
            step = staged(step, "path")  # bounds the plan of long paths
        pairs.append(step.select("u", "v"))
        if d:
            before = levels[d - 1].where("mate is not null").select("root", F.col("mate").alias("u"), F.col("v").alias("w"))
            on = step.join(before, ["root", "u"]).select("root", F.col("w").alias("v"))
    return _union(pairs)


@dataclass(frozen=True)
class Assignment:
    """``pairs``: a, b, cost and the columns of the stratum. ``report``: for each stratum its targets, those a maximum matching reaches, whether it is complete, and its total cost (null unless complete)."""

    pairs: DataFrame
    report: DataFrame


def least_cost_assignment(edges: DataFrame, a: str, b: str, cost: str, by: tuple[str, ...] = (), feasible: bool = False, max_rounds: int = 5000) -> Assignment:
    """Gives every ``a`` its own ``b`` at least total ``cost`` (a whole number, 0 or more), each stratum of ``by`` for itself.

    An auction: every target without a partner bids for the one that is best at current prices, as much as makes it
    no better than the target's second choice, and a step; the highest bid takes the partner, whose former target bids again.
    Costs are multiplied by the stratum's targets + 1 and the step is 1, so the total is within less than 1 of
    the least, which makes it the least.  Prices start at 0 and partners that nobody wants keep it, as the proof demands where
    there are more partners than targets; steps that fall from coarse to fine would leave prices on them, so
    there is one step.  The number of rounds grows with the largest cost where several targets
    fight for too few partners; ``max_rounds`` ends such a run with an error.

    A stratum in which not every target can have a partner, by a maximum matching, is reported as incomplete and gets no pairs;
    ``feasible`` says that there is none such, and spares the matching.  Null ends and costs are ignored; of rows
    that repeat an edge the cheapest counts; a negative cost is an error.
    """
    keys = [F.col(c) for c in by]
    rows = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(cost).isNotNull())
    u, v = F.struct(*keys, F.col(a).alias("_a")).alias("u"), F.struct(*keys, F.col(b).alias("_b")).alias("v")
    priced = staged(rows.select(F.struct(F.lit(0).alias("_all"), *keys).alias("s"), u, v, F.col(cost).cast("long").alias("c")).groupBy("s", "u", "v").agg(F.min("c").alias("c")), "priced")
    if priced.where("c < 0").limit(1).count():
        raise ValueError("costs must not be negative")
    matched = priced.select("u").distinct() if feasible else maximum_matching(priced, "u", "v").pairs
    targets = priced.groupBy("s").agg(F.count_distinct("u").alias("targets"), F.max("c").alias("top"))
    reached = matched.join(priced.select("s", "u").distinct(), "u").groupBy("s").agg(F.count(F.lit(1)).alias("reached"))
    strata = staged(targets.join(reached, "s", "left").na.fill(0, ["reached"]), "strata")
    full = strata.where("targets = reached").select("s", (F.col("targets") + 1).alias("m"), F.expr("2 * (top * (targets + 1) + 1) * (targets + 1)").alias("alone"))
    e = staged(priced.join(full, "s").select("u", "v", (F.col("c") * F.col("m")).alias("c"), "alone"), "scaled")
    lefts = staged(e.select("u").distinct(), "lefts")
    n, state = lefts.count(), None
    for _ in range(max_rounds):
        if (0 if state is None else state.count()) == n:
            break
        state = _bid(e, lefts, state)
    else:
        raise RuntimeError(f"assignment did not settle in {max_rounds} rounds")
    owners = state.select(F.col("owner").alias("u"), "v") if state is not None else e.select("u", "v").limit(0)
    taken = staged(owners.join(priced, ["u", "v"]), "taken")
    totals = taken.groupBy("s").agg(F.sum("c").alias("cost"))
    complete = (F.col("targets") == F.col("reached")).alias("complete")
    report = strata.join(totals, "s", "left").select(*[F.col("s")[c].alias(c) for c in by], "targets", "reached", complete, "cost")
    return Assignment(taken.select(*[F.col("s")[c].alias(c) for c in by], F.col("u._a").alias(a), F.col("v._b").alias(b), F.col("c").alias(cost)), report)


def _bid(e: DataFrame, lefts: DataFrame, state: DataFrame | None) -> DataFrame:
    """One round: (v, price, owner) after the highest bids; a partner once taken is never free again."""
    if state is None:
        offers = e.withColumn("price", F.lit(0).cast("long"))
    else:
        free = lefts.join(state.select(F.col("owner").alias("u")), "u", "left_anti")
        offers = e.join(free, "u").join(state.select("v", "price"), "v", "left").na.fill(0, ["price"])
    offers = offers.withColumn("value", -F.col("c") - F.col("price"))
    best = offers.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("value"), "v"))).where("r <= 2")  # cut before the shuffle
    first = lambda c: F.max(F.when(F.col("r") == 1, F.col(c)))
    bids = best.groupBy("u").agg(first("v").alias("v"), first("price").alias("price"), first("value").alias("one"), F.max(F.when(F.col("r") == 2, F.col("value"))).alias("two"), F.max("alone").alias("alone"))
    bid = F.col("price") + F.col("one") - F.coalesce(F.col("two"), F.col("one") - F.col("alone")) + 1
    won = bids.groupBy("v").agg(F.max(F.struct(bid.alias("price"), F.col("u").alias("owner"))).alias("w")).select("v", "w.price", "w.owner")
    if state is None:
        return staged(won, "auction")
    return staged(state.join(won, "v", "left_anti").unionByName(won), "auction")


def exact_gap_negatives(positives: DataFrame, endpoints: DataFrame, tolerance: int = 0, seed: int = 42, block: str | None = None) -> DataFrame:
    """One negative for as many positives as possible, no unordered negative pair twice.

    ``positives``: left, right, subject_left, subject_right, age_left, age_right (and ``block``); ``endpoints``: item, subject, age (and ``block``).
    A negative keeps one end and replaces the other by another subject's item, within ``tolerance`` years of the
    age replaced, and has the positive's age gap.  Positives without one have null ends.
    """
    gap = F.abs(F.col("age_left") - F.col("age_right"))
    extra = [block] if block else []
    p = positives.where("age_left is not null and age_right is not null").select("left", "right", "subject_left", "subject_right", "age_left", "age_right", gap.alias("gap"), *extra)
    p = staged(p.withColumn("pos", F.struct("left", "right")), "positives")
    kept = []
    for keep, lose in (("left", "right"), ("right", "left")):
        asked = p.withColumn("age", F.explode(F.sequence(F.col(f"age_{lose}") - tolerance, F.col(f"age_{lose}") + tolerance)))
        c = asked.join(endpoints.select("item", "subject", F.col("age").cast(dict(asked.dtypes)["age"]).alias("age"), *extra), ["age", *extra])
        c = c.where((F.col("subject") != F.col(f"subject_{keep}")) & (F.abs(F.col(f"age_{keep}") - F.col("age")) == F.col("gap")) & (F.col("item") != F.col(keep)))
        kept.append(c.select("pos", F.struct(F.least(keep, "item").alias("lo"), F.greatest(keep, "item").alias("hi")).alias("edge")))
    m = maximum_matching(kept[0].unionByName(kept[1]), "pos", "edge", seed=seed)
    out = p.select("pos").distinct().join(m.pairs, "pos", "left")
    return out.select("pos.left", "pos.right", F.col("edge.lo").alias("negative_lo"), F.col("edge.hi").alias("negative_hi"))
