"""Matching, assignment and samples under budgets, reuse, overlap and repair rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import arms, bipartite
from millrace.plans.registry import query
from millrace.plans.tables import items, pairs

#: Candidates are sought among the items of a block, so that their number grows with the items, not with their square.
BLOCK = 240
block = lambda c: F.expr(f"{c} div {BLOCK}")


def _positives(spark, d):
    """Pairs of one label and one block with known attributes."""
    p = pairs(spark, d, extra=("label",)).where("y = 1 and age_a is not null and age_b is not null")
    return p.withColumn("block", block("item_a")).where(F.col("block") == block("item_b"))


def _endpoints(spark, d):
    return items(spark, d).where("age is not null").select("item", "age", "entity", "label", "quality", block("item").alias("block"))


def _near(targets, endpoints, years):
    """Endpoints of another label within some years of the target's second end."""
    asks = targets.withColumn("age", F.explode(F.sequence(F.col("age_b") - years, F.col("age_b") + years)))
    c = asks.join(endpoints.withColumnsRenamed({"label": "other", "quality": "other_quality"}), ["age", "block"])
    return c.where("other <> label_a and item <> item_a and item <> item_b")


@query("x06_exact_gap_negatives")
def x06(spark, d):
    """For each positive a negative of the same gap that keeps one end, as many as a matching allows, no pair twice."""
    p = _positives(spark, d)
    p = p.select(F.col("item_a").alias("left"), F.col("item_b").alias("right"), F.col("label_a").alias("subject_left"), F.col("label_b").alias("subject_right"), F.col("age_a").alias("age_left"), F.col("age_b").alias("age_right"), "block")
    e = _endpoints(spark, d).select("item", F.col("label").alias("subject"), "age", "block")
    return bipartite.exact_gap_negatives(p, e, tolerance=1, block="block")


@query("x07_maximum_matching")
def x07(spark, d):
    """Every positive wants an item of its own within a year of its second end; as many get one as can, and the certificate that it cannot be more."""
    t = _positives(spark, d).select("item_a", "item_b", "age_b", "label_a", "block")
    c = _near(t, _endpoints(spark, d), 1).select(F.struct("item_a", "item_b").alias("target"), "item")
    m = bipartite.maximum_matching(c, "target", "item")
    out = t.select(F.struct("item_a", "item_b").alias("target")).join(m.pairs, "target", "left").join(m.stuck_left.distinct().withColumn("stuck", F.lit(True)), "target", "left")
    return out.select("target.item_a", "target.item_b", F.col("item").alias("partner"), F.coalesce("stuck", F.lit(False)).alias("stuck"))


@query("x08_least_cost_assignment")
def x08(spark, d):
    """Neighbours of one label get impostors of their own, block by block, at the least sum of squared quality differences."""
    t = _positives(spark, d).where("item_b = item_a + 1").select("item_a", "item_b", "age_b", "label_a", "block")
    q = F.pow((F.col("other_quality") * 100).cast("int") - (F.col("item_b") % 50 + 50), 2).cast("long")
    c = _near(t, _endpoints(spark, d), 2).select("block", F.struct("item_a", "item_b").alias("target"), "item", q.alias("cost"))
    return bipartite.least_cost_assignment(c, "target", "item", "cost", ("block",)).pairs.select("block", "target.item_a", "target.item_b", F.col("item").alias("partner"), "cost")


def _pool(spark, d):
    p = _positives(spark, d).select(F.col("item_a").alias("a"), F.col("item_b").alias("b"), "age_a", "age_b", F.col("label_a").alias("person"))
    return arms.endpoint_pool(p)[0].withColumn("block", block("item"))


@query("x12_least_reuse")
def x12(spark, d):
    """An impostor for every positive out of the positives' own items, each item and person as seldom as can be."""
    t = _positives(spark, d).select(F.struct("item_a", "item_b").alias("target"), F.col("item_a").alias("anchor"), F.col("label_a").alias("anchor_person"), F.col("age_b").alias("age"), "block")
    t = t.withColumn("target", F.concat_ws("_", "target.item_a", "target.item_b"))
    return arms.least_reuse(t, _pool(spark, d), block="block")


@query("x13_restricted_pool", """
WITH p AS (SELECT * FROM pairs JOIN (SELECT item AS item_a, label FROM items) USING (item_a) WHERE y = 1 AND age_a IS NOT NULL AND age_b IS NOT NULL AND item_a // 240 = item_b // 240),
e AS (SELECT item_a AS item, age_a AS age, label AS person FROM p UNION ALL SELECT item_b, age_b, label FROM p)
SELECT item, any_value(age) AS age, any_value(person) AS person FROM e GROUP BY item""")
def x13(spark, d):
    """The only items that impostors may come from: the ends of positives."""
    return _pool(spark, d).select("item", "age", "person")


@query("x14_bounded_repair")
def x14(spark, d):
    """One pair of each second entity; where no other pair's end supports its second age, the pair is replaced."""
    e = items(spark, d).where("age is not null").select("item", "age", F.col("entity").alias("person"))
    a = e.where("item % 6 = 0").select("person", F.col("item").alias("a"))
    b = e.where("item % 6 = 1").select("person", F.col("item").alias("b"), F.col("age").alias("age_b"))
    pair = a.join(b, "person")
    slots = pair.where("person % 2 = 0").withColumnRenamed("person", "slot")
    ends = slots.select(F.col("age_b"), F.col("slot").alias("person"))
    other = ends.groupBy("age_b").agg(F.count(F.lit(1)).alias("n"))
    slots = slots.join(other, "age_b").select("slot", F.col("slot").alias("person"), "a", "b", "age_b", (F.col("n") < 2).alias("broken"))
    context = slots.where("not broken").select("age_b", "person")
    pool = pair.where("person % 2 = 1").select(F.col("person").alias("row"), "person", "a", "b", "age_b")
    return arms.bounded_repair(slots, pool, F.col("p.person") != F.col("c.person"), context, ["age_b"])


@query("x15_partial_permutation")
def x15(spark, d):
    """Second ends dealt anew among positives of one age, as few as possible left in place."""
    p = pairs(spark, d, extra=("label",)).where("age_b is not null")
    rows = p.where("y = 1").select(F.concat_ws("_", "item_a", "item_b").alias("row"), F.col("item_a").alias("a"), F.col("item_b").alias("b"), F.col("label_a").alias("person"), "age_b")
    forbidden = p.where("y = 0").select(F.least("item_a", "item_b").alias("lo"), F.greatest("item_a", "item_b").alias("hi"))
    return arms.partial_permutation(rows, forbidden, "age_b")


@query("k11_profile_sample")
def k11(spark, d):
    """Half of the persons, with exact budgets of pairs and of different items."""
    p = pairs(spark, d).where("entity_a = entity_b").select(F.concat_ws("_", "item_a", "item_b").alias("pair"), F.col("entity_a").alias("person"), F.col("item_a").alias("a"), F.col("item_b").alias("b"))
    half = p.select("person").distinct().count() // 2
    return arms.profile_sample(p, half, half * 5 // 2, half * 3)


@query("k08_minimum_overlap", """
WITH RECURSIVE o AS (SELECT item_a, item_b, abs(score - 0.3) AS off, row_number() OVER (ORDER BY abs(score - 0.3), item_a, item_b) AS r FROM pairs WHERE item_a % 4 < 3),
g AS (
  SELECT 0::BIGINT AS r, []::BIGINT[] AS used, NULL::BIGINT AS a, NULL::BIGINT AS b
  UNION ALL
  SELECT o.r, CASE WHEN list_contains(g.used, o.item_a) OR list_contains(g.used, o.item_b) THEN g.used ELSE list_concat(g.used, [o.item_a, o.item_b]) END,
         CASE WHEN list_contains(g.used, o.item_a) OR list_contains(g.used, o.item_b) THEN NULL ELSE o.item_a END, o.item_b
  FROM g JOIN o ON o.r = g.r + 1),
n AS (SELECT count(*) // 4 AS n FROM o),
f AS (SELECT * FROM (SELECT a AS item_a, b AS item_b, row_number() OVER (ORDER BY r) AS k FROM g WHERE a IS NOT NULL), n WHERE k <= n),
u AS (SELECT item_a AS x FROM f UNION ALL SELECT item_b FROM f),
m AS (
  SELECT o.item_a, o.item_b, (SELECT count(*) FROM u WHERE x IN (o.item_a, o.item_b)) AS overlap, off
  FROM o LEFT JOIN f ON o.item_a = f.item_a AND o.item_b = f.item_b WHERE f.item_a IS NULL),
l AS (SELECT *, row_number() OVER (ORDER BY overlap, off, item_a, item_b) AS k FROM m)
SELECT item_a, item_b, 0::BIGINT AS overlap FROM f
UNION ALL SELECT item_a, item_b, overlap FROM l, n WHERE k <= n - (SELECT count(*) FROM f)""")
def k08(spark, d):
    """A quarter of the pairs, nearest to a threshold first, no item twice as long as that goes, then with the least overlap."""
    p = pairs(spark, d).where("item_a % 4 < 3").select(F.struct("item_a", "item_b").alias("key"), F.array("item_a", "item_b").alias("members"), F.abs(F.col("score") - 0.3).alias("off"))
    return arms.minimum_overlap(p, p.count() // 4, "key", "members", "off").select("key.item_a", "key.item_b", "overlap")
