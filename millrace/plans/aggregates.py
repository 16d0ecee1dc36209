"""G: aggregates; W: windows and ranking; K: sampling and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import buckets
from millrace.functions.vectors import centroid
from millrace.operators.quantiles import quantiles
from millrace.operators.running import running_sums, score_bucket
from millrace.operators.sampling import group_folds, hash_priority, hash_sample
from millrace.operators.verification import ks_distance, midranks, top_k
from millrace.plans.projections import BAND_SQL, GAP_SQL
from millrace.plans.registry import query
from millrace.plans.tables import daily, items, pairs, read

count = lambda name="n": F.count(F.lit(1)).alias(name)
rnd = lambda c, n=6: F.round(c, n)


@query("g01_ordered_union", "SELECT user_id, list(event_type ORDER BY first) AS types FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY user_id")
def g01(spark, d):
    """Member lists united in the order of first occurrence; reduced to first occurrences before anything is collected."""
    first = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]).alias("types"))


@query("g02_status_rollup", "SELECT entity, CASE WHEN bool_or(item % 11 = 0) THEN 'manual_review' WHEN count(DISTINCT grp) > 1 OR bool_or(NOT usable) THEN 'mixed' ELSE 'auto' END AS status FROM items GROUP BY entity")
def g02(spark, d):
    s = F.when(F.bool_or(F.col("item") % 11 == 0), "manual_review").when((F.count_distinct("grp") > 1) | F.bool_or(~F.col("usable")), "mixed").otherwise("auto")
    return items(spark, d).groupBy("entity").agg(s.alias("status"))


@query("g03_majority_value", """
WITH c AS (SELECT entity, label, count(*) AS n, min(item) AS first FROM items GROUP BY 1, 2)
SELECT entity, label, round(n::DOUBLE / sum(n) OVER (PARTITION BY entity), 3) AS share FROM c QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, first) = 1""")
def g03(spark, d):
    """The most frequent label; of equally frequent ones the first seen."""
    c = items(spark, d).groupBy("entity", "label").agg(count(), F.min("item").alias("first"))
    return c.groupBy("entity").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("label"), F.round(F.max("n") / F.sum("n"), 3).alias("share"))


@query("g04_truncated_median", "SELECT entity, trunc(median(age))::INTEGER AS age FROM items WHERE age IS NOT NULL GROUP BY entity")
def g04(spark, d):
    return items(spark, d).where("age is not null").groupBy("entity").agg(F.percentile("age", 0.5).cast("int").alias("age"))


@query("g05_value_histogram", """
SELECT user_id, max(n) AS top_count, arg_max(event_type, (n, event_type)) AS dominant, sum(n)::BIGINT AS total FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def g05(spark, d):
    h = read(spark, d, "events").groupBy("user_id", "event_type").agg(count())
    return h.groupBy("user_id").agg(F.max("n").alias("top_count"), F.max_by("event_type", F.struct("n", "event_type")).alias("dominant"), F.sum("n").alias("total"))


@query("g06_funnel", """
SELECT (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM items WHERE usable) AS usable, (SELECT count(DISTINCT grp) FROM items WHERE usable) AS grps, (SELECT count(DISTINCT entity) FROM items WHERE usable) AS entities,
 (SELECT count(*) FROM pairs) AS pairs, (SELECT count(*) FROM pairs WHERE y = 1) AS positives""")
def g06(spark, d):
    u = F.col("usable")
    a = items(spark, d).agg(count("items"), F.count_if(u).alias("usable"), F.count_distinct(F.when(u, F.col("grp"))).alias("grps"), F.count_distinct(F.when(u, F.col("entity"))).alias("entities"))
    return a.crossJoin(F.broadcast(pairs(spark, d).agg(count("pairs"), F.count_if(F.col("y") == 1).alias("positives"))))  # one row each


@query("g07_reason_histogram", "SELECT coalesce(CASE WHEN quality < 0.6 THEN 'low' WHEN item % 17 = 3 THEN 'blurry' END, 'none') AS reason, count(*) AS n FROM items GROUP BY 1")
def g07(spark, d):
    r = F.when(F.col("quality") < 0.6, "low").when(F.col("item") % 17 == 3, "blurry")
    return items(spark, d).groupBy(F.coalesce(r, F.lit("none")).alias("reason")).agg(count())


FIVE = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("g08_percentiles", "SELECT split_a AS split, [round(x, 6) FOR x IN quantile_cont(abs(score), [0.05, 0.25, 0.5, 0.75, 0.95])] AS q FROM pairs GROUP BY 1")
def g08(spark, d):
    p = pairs(spark, d).select(F.col("split_a").alias("split"), F.abs("score").alias("s"))
    return quantiles(p, "s", FIVE, ["split"]).select("split", F.transform("q", lambda x: rnd(x)).alias("q"))


@query("g09_distribution", "SELECT count(*) AS n_total, count(age) AS observed, count(*) - count(age) AS missing, min(age) AS lo, max(age) AS hi, round(avg(age), 6) AS mean, round(stddev_pop(age), 6) AS sd, round(quantile_cont(age, 0.5), 6) AS med FROM items")
def g09(spark, d):
    t = items(spark, d)
    med = quantiles(t, "age", [0.5], width=1.0).select(rnd(F.col("q")[0]).alias("med"))
    return t.agg(count("n_total"), F.count("age").alias("observed"), (F.count(F.lit(1)) - F.count("age")).alias("missing"), F.min("age").alias("lo"), F.max("age").alias("hi"), rnd(F.avg("age")).alias("mean"), rnd(F.stddev_pop("age")).alias("sd")).crossJoin(F.broadcast(med))  # one row each


@query("g10_gap_counts", f"SELECT y, {GAP_SQL} AS bucket, count(*) AS n FROM pairs GROUP BY 1, 2")
def g10(spark, d):
    return pairs(spark, d).groupBy("y", buckets.gap_bucket(F.col("gap")).alias("bucket")).agg(count())


@query("g11_split_overlap", "SELECT split, count(DISTINCT entity) AS entities, count(DISTINCT grp) AS grps FROM items GROUP BY split")
def g11(spark, d):
    return items(spark, d).groupBy("split").agg(F.count_distinct("entity").alias("entities"), F.count_distinct("grp").alias("grps"))


@query("g12_false_negative_rate", "SELECT round(avg((entity_a = entity_b)::INTEGER), 6) AS rate, count(*) AS n FROM pairs WHERE y = 0")
def g12(spark, d):
    return pairs(spark, d).where("y = 0").agg(rnd(F.avg((F.col("entity_a") == F.col("entity_b")).cast("int"))).alias("rate"), count())


@query("g13_max_per_entity", "SELECT entity, max(age) AS max_age FROM items GROUP BY entity")
def g13(spark, d):
    return items(spark, d).groupBy("entity").agg(F.max("age").alias("max_age"))


@query("g14_feature_row", "SELECT grp, round(avg(quality), 6) AS mean_q, max(quality) AS max_q, min(quality) AS min_q, round(median(quality), 6) AS med_q, round(avg(gender), 6) AS share FROM items WHERE usable GROUP BY grp")
def g14(spark, d):
    return items(spark, d).where("usable").groupBy("grp").agg(rnd(F.avg("quality")).alias("mean_q"), F.max("quality").alias("max_q"), F.min("quality").alias("min_q"), rnd(F.percentile("quality", 0.5)).alias("med_q"), rnd(F.avg("gender")).alias("share"))


@query("g15_centroids", "SELECT label, round(avg(vec[1]), 6) AS c0, round(avg(vec[64]), 6) AS c63, count(*) AS n FROM items GROUP BY label")
def g15(spark, d):
    c = centroid(items(spark, d), "vec", 64, "label")
    return c.select("label", rnd(F.col("centroid")[0]).alias("c0"), rnd(F.col("centroid")[63]).alias("c63"), "n")


@query("g16_leave_one_out", "SELECT item, round(CASE WHEN count(*) OVER w = 1 THEN quality ELSE (sum(quality) OVER w - quality) / (count(*) OVER w - 1) END, 6) AS loo FROM items WINDOW w AS (PARTITION BY entity)")
def g16(spark, d):
    w = Window.partitionBy("entity")
    n = F.count(F.lit(1)).over(w)
    return items(spark, d).select("item", rnd(F.when(n == 1, F.col("quality")).otherwise((F.sum("quality").over(w) - F.col("quality")) / (n - 1))).alias("loo"))


@query("g17_weighted_smd", """
WITH m AS (SELECT gender, sum(quality * age) / sum(quality) AS wm, var_pop(age) AS v, avg(age) AS m FROM items WHERE age IS NOT NULL GROUP BY gender)
SELECT round(max(wm) FILTER (gender = 1), 6) AS wm1, round(max(wm) FILTER (gender = 0), 6) AS wm0, round((max(m) FILTER (gender = 1) - max(m) FILTER (gender = 0)) / sqrt(sum(v) / 2), 6) AS smd FROM m""")
def g17(spark, d):
    m = items(spark, d).where("age is not null").groupBy("gender").agg((F.sum(F.col("quality") * F.col("age")) / F.sum("quality")).alias("wm"), F.var_pop("age").alias("v"), F.avg("age").alias("m"))
    of = lambda c, g: F.max(F.when(F.col("gender") == g, F.col(c)))
    return m.agg(rnd(of("wm", 1)).alias("wm1"), rnd(of("wm", 0)).alias("wm0"), rnd((of("m", 1) - of("m", 0)) / F.sqrt(F.sum("v") / 2)).alias("smd"))


@query("g18_effective_size", "SELECT split, round(sum(quality) * sum(quality) / sum(quality * quality), 4) AS ess FROM items GROUP BY split")
def g18(spark, d):
    return items(spark, d).groupBy("split").agg(rnd(F.sum("quality") * F.sum("quality") / F.sum(F.col("quality") * F.col("quality")), 4).alias("ess"))


@query("g19_seed_summary", """
WITH r AS (SELECT item % 3 AS seed, label AS metric, avg(quality) AS v FROM items WHERE NOT (label = 9 AND item % 3 = 2) GROUP BY 1, 2)
SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM r GROUP BY metric HAVING count(*) = 3""")
def g19(spark, d):
    """Mean and deviation over seeds, only of metrics that every seed has."""
    r = items(spark, d).where("not (label = 9 and item % 3 = 2)").groupBy((F.col("item") % 3).alias("seed"), F.col("label").alias("metric")).agg(F.avg("quality").alias("v"))
    return r.groupBy("metric").agg(rnd(F.avg("v")).alias("mean"), rnd(F.stddev_samp("v")).alias("sd"), count()).where("n = 3").drop("n")


@query("g20_reuse_histogram", "SELECT uses, count(*) AS items FROM (SELECT item_b, count(*) AS uses FROM pairs WHERE y = 1 GROUP BY 1) GROUP BY uses")
def g20(spark, d):
    return pairs(spark, d).where("y = 1").groupBy("item_b").agg(count("uses")).groupBy("uses").agg(count("items"))


@query("g21_majority_resolved", """
WITH c AS (SELECT entity, age, count(*) AS n FROM items WHERE age IS NOT NULL GROUP BY 1, 2)
SELECT entity, arg_min(age, (-n, age)) AS age, count(*) - 1 AS conflicts FROM c GROUP BY entity""")
def g21(spark, d):
    c = items(spark, d).where("age is not null").groupBy("entity", "age").agg(count())
    return c.groupBy("entity").agg(F.min_by("age", F.struct(-F.col("n"), F.col("age"))).alias("age"), (F.count(F.lit(1)) - 1).alias("conflicts"))


@query("g22_conflict_masking", "SELECT entity, CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS label, CASE count(DISTINCT label) WHEN 0 THEN 'missing' WHEN 1 THEN 'explicit' ELSE 'conflict_masked' END AS status FROM items GROUP BY entity")
def g22(spark, d):
    n = F.count_distinct("label")
    return items(spark, d).groupBy("entity").agg(F.when(n == 1, F.min("label")).alias("label"), F.when(n == 0, "missing").when(n == 1, "explicit").otherwise("conflict_masked").alias("status"))


@query("g23_drop_all_duplicates", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1")
def g23(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), count()).where("n = 1").drop("n")


@query("g24_batch_collisions", "SELECT batch, sum(c * (c - 1) // 2)::BIGINT AS collisions, count(*) AS ids FROM (SELECT event_id // 500 AS batch, user_id, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY batch")
def g24(spark, d):
    c = read(spark, d, "events").groupBy(F.expr("event_id div 500").alias("batch"), "user_id").agg(count("c"))
    return c.groupBy("batch").agg(F.sum(F.expr("c * (c - 1) div 2")).alias("collisions"), count("ids"))


@query("g25_pair_capacity", "SELECT sum(n * (n - 1) // 2)::BIGINT AS capacity FROM (SELECT count(*) FILTER (item % 7 <> 3) AS n FROM items GROUP BY grp)")
def g25(spark, d):
    return items(spark, d).groupBy("grp").agg(F.count_if(F.col("item") % 7 != 3).alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("capacity"))


@query("g26_confusion", """
WITH c AS (SELECT count(*) FILTER (score >= 0.1 AND y = 1) AS tp, count(*) FILTER (score >= 0.1 AND y = 0) AS fp, count(*) FILTER (score < 0.1 AND y = 1) AS fn FROM pairs)
SELECT tp, fp, fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS p, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS r, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def g26(spark, d):
    hit, y = F.col("score") >= 0.1, F.col("y") == 1
    c = pairs(spark, d).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    div = lambda a, b: rnd(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", div(tp, tp + fp).alias("p"), div(tp, tp + fn).alias("r"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("g27_cohens_kappa", """
WITH c AS (SELECT avg((quality = toxic)::INTEGER) AS o, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS e FROM labels)
SELECT round(CASE WHEN e = 1 AND o = 1 THEN 1.0 ELSE (o - e) / (1 - e) END, 6) AS kappa FROM c""")
def g27(spark, d):
    a, b = F.avg("quality"), F.avg("toxic")
    c = read(spark, d, "labels").agg(F.avg((F.col("quality") == F.col("toxic")).cast("int")).alias("o"), (a * b + (1 - a) * (1 - b)).alias("e"))
    return c.select(rnd(F.when((F.col("e") == 1) & (F.col("o") == 1), F.lit(1.0)).otherwise((F.col("o") - F.col("e")) / (1 - F.col("e")))).alias("kappa"))


@query("g28_attribute_errors", "SELECT round(avg(abs(age - (item % 80 + 1))), 6) AS mae, round(avg((abs(age - (item % 80 + 1)) <= 1)::INTEGER), 6) AS within1, round(avg((age = item % 80 + 1)::INTEGER), 6) AS exact, round(count(age)::DOUBLE / count(*), 6) AS coverage FROM items")
def g28(spark, d):
    e = F.abs(F.col("age") - (F.col("item") % 80 + 1))
    return items(spark, d).agg(rnd(F.avg(e)).alias("mae"), rnd(F.avg((e <= 1).cast("int"))).alias("within1"), rnd(F.avg((e == 0).cast("int"))).alias("exact"), rnd(F.count("age") / F.count(F.lit(1))).alias("coverage"))


@query("g29_set_agreement", """
WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (event_id % 2 = 0)) AS a, list_sort(list(DISTINCT event_type) FILTER (event_id % 2 = 1)) AS b FROM events GROUP BY user_id)
SELECT CASE WHEN coalesce(len(a), 0) = 0 AND coalesce(len(b), 0) = 0 THEN 'agree_empty' WHEN coalesce(len(a), 0) = 0 THEN 'filled' WHEN coalesce(len(b), 0) = 0 THEN 'missed' WHEN a = b THEN 'agree' ELSE 'mismatch' END AS outcome, count(*) AS n FROM s GROUP BY 1""")
def g29(spark, d):
    side = lambda k: F.sort_array(F.collect_set(F.when(F.col("event_id") % 2 == k, F.col("event_type"))))
    s = read(spark, d, "events").groupBy("user_id").agg(side(0).alias("a"), side(1).alias("b"))  # as many values as there are event types
    o = F.when((F.size("a") == 0) & (F.size("b") == 0), "agree_empty").when(F.size("a") == 0, "filled").when(F.size("b") == 0, "missed").when(F.col("a") == F.col("b"), "agree").otherwise("mismatch")
    return s.groupBy(o.alias("outcome")).agg(count())


@query("g30_bucket_percentile_rank", """
SELECT user_id, day, round((rank() OVER w + (count(*) OVER (PARTITION BY day, views + likes) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY day), 6) AS pct FROM daily WINDOW w AS (PARTITION BY day ORDER BY views + likes)""")
def g30(spark, d):
    """Average-tie percentile ranks within a day, from counts of equal values: a day's rows are never in one task."""
    t = daily(spark, d).select("user_id", "day", (F.col("views") + F.col("likes")).alias("v"))
    return midranks(t, "v", ["day"], width=64.0).join(t.groupBy("day").agg(count("N")), "day").select("user_id", "day", rnd(F.col("rank") / F.col("N")).alias("pct"))


@query("g31_decile_means", """
WITH r AS (SELECT quality, ntile(10) OVER (ORDER BY round(vec[1], 9), item) AS decile FROM items) SELECT decile, round(avg(quality), 6) AS mean, count(*) AS n FROM r GROUP BY decile""")
def g31(spark, d):
    """Tenths of a total order: positions come from two-level running counts, no task sorts all rows."""
    t = items(spark, d).select("item", "quality", F.round(F.col("vec")[0], 9).alias("s"))
    one = t.withColumn("o", F.struct("s", "item")).withColumn("c", F.lit(1).cast("long"))
    r = running_sums(one, [], "o", ["c"], score_bucket("s"))
    n = t.agg(count("N"))
    base, extra = F.expr("N div 10"), F.col("N") % 10
    pos = F.col("below_c")
    dec = F.when(pos < extra * (base + 1), F.floor(pos / (base + 1))).otherwise(extra + F.floor((pos - extra * (base + 1)) / F.greatest(base, F.lit(1)))) + 1
    return r.crossJoin(F.broadcast(n)).select("quality", dec.alias("decile")).groupBy("decile").agg(rnd(F.avg("quality")).alias("mean"), count())  # one row


@query("g32_within_between", """
WITH m AS (SELECT quality - avg(quality) OVER w AS q, age - avg(age) OVER w AS a, avg(quality) OVER w AS mq, avg(age) OVER w AS ma FROM items WHERE age IS NOT NULL WINDOW w AS (PARTITION BY label))
SELECT round(corr(q, a), 6) AS within_corr, round(corr(mq, ma), 6) AS between_corr FROM m""")
def g32(spark, d):
    """Group means come from a partial aggregate and a join, so a large group is not one task's window."""
    t = items(spark, d).where("age is not null").select("label", "quality", "age")
    m = t.groupBy("label").agg(F.avg("quality").alias("mq"), F.avg("age").alias("ma"))
    j = t.join(m, "label")
    return j.agg(rnd(F.corr(F.col("quality") - F.col("mq"), F.col("age") - F.col("ma"))).alias("within_corr"), rnd(F.corr("mq", "ma")).alias("between_corr"))


@query("g33_strata_grouping_sets", f"SELECT gender, {BAND_SQL} AS band, count(*) AS n, round(avg(quality), 6) AS quality FROM items GROUP BY GROUPING SETS ((), (gender), (band))")
def g33(spark, d):
    """Overall, by gender and by band in one pass."""
    t = items(spark, d).withColumn("band", buckets.age_band(F.col("age"), "unknown"))
    sets = t.groupingSets([[], [F.col("gender")], [F.col("band")]], F.col("gender"), F.col("band"))
    return sets.agg(count(), rnd(F.avg("quality")).alias("quality"))


@query("g35_group_policy", """
WITH g AS (SELECT grp, bool_and(item % 5 <> 0) AS single, bool_or(item % 5 = 0 AND item % 2 = 0) AS noisy FROM items GROUP BY grp)
SELECT count(*) FILTER (single) AS single, count(*) FILTER (noisy) AS noisy, count(*) FILTER (NOT single AND NOT noisy) AS unresolved, round(count(*) FILTER (noisy)::DOUBLE / count(*), 6) AS of_all, round(count(*) FILTER (noisy)::DOUBLE / nullif(count(*) FILTER (single OR noisy), 0), 6) AS of_resolved FROM g""")
def g35(spark, d):
    i = F.col("item")
    g = items(spark, d).groupBy("grp").agg(F.bool_and(i % 5 != 0).alias("single"), F.bool_or((i % 5 == 0) & (i % 2 == 0)).alias("noisy"))
    s, n = F.col("single"), F.col("noisy")
    return g.agg(F.count_if(s).alias("single"), F.count_if(n).alias("noisy"), F.count_if(~s & ~n).alias("unresolved"), rnd(F.count_if(n) / F.count(F.lit(1))).alias("of_all"), rnd(F.count_if(n) / F.nullif(F.count_if(s | n), F.lit(0))).alias("of_resolved"))


@query("g36_unique_budget", "SELECT y, count(DISTINCT item) AS items FROM (SELECT y, unnest([item_a, item_b]) AS item FROM pairs) GROUP BY y")
def g36(spark, d):
    return pairs(spark, d).select("y", F.explode(F.array("item_a", "item_b")).alias("item")).groupBy("y").agg(F.count_distinct("item").alias("items"))


@query("g37_curve_summary", """
WITH c AS (SELECT label AS metric, item // 50 AS epoch, avg(quality) + (item // 50) * 0.01 AS v FROM items GROUP BY 1, 2)
SELECT metric, round(arg_min(v, epoch), 6) AS first, round(arg_max(v, epoch), 6) AS last, round(arg_max(v, epoch) - arg_min(v, epoch), 6) AS change, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM c GROUP BY metric""")
def g37(spark, d):
    e = F.expr("item div 50")
    c = items(spark, d).groupBy(F.col("label").alias("metric"), e.alias("epoch")).agg(F.avg("quality").alias("q")).withColumn("v", F.col("q") + F.col("epoch") * 0.01)
    a, b = F.min_by("v", "epoch"), F.max_by("v", "epoch")
    return c.groupBy("metric").agg(rnd(a).alias("first"), rnd(b).alias("last"), rnd(b - a).alias("change"), rnd(F.min("v")).alias("lo"), rnd(F.max("v")).alias("hi"))


@query("g39_endpoint_exposure", """
WITH e AS (SELECT item, sum(w) AS w FROM (SELECT unnest([item_a, item_b]) AS item, CASE WHEN y = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM pairs) GROUP BY item)
SELECT round(sum(w) * sum(w) / sum(w * w), 4) AS ess, round(max(w) / sum(w), 6) AS max_share, count(*) AS items FROM e""")
def g39(spark, d):
    e = pairs(spark, d).select(F.explode(F.array("item_a", "item_b")).alias("item"), F.when(F.col("y") == 1, 2.0).otherwise(1.0).alias("w")).groupBy("item").agg(F.sum("w").alias("w"))
    return e.agg(rnd(F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w")), 4).alias("ess"), rnd(F.max("w") / F.sum("w")).alias("max_share"), count("items"))


@query("g40_backfill_coverage", """
WITH b AS (SELECT doc_id % 500 AS key, arg_max(quality, doc_id) AS q FROM labels GROUP BY 1)
SELECT count(*) AS docs, count(b.key) AS matched, round(count(b.key)::DOUBLE / count(*), 6) AS share, count(*) FILTER (b.q = 1) AS good FROM documents d LEFT JOIN b ON d.doc_id = b.key""")
def g40(spark, d):
    b = read(spark, d, "labels").groupBy((F.col("doc_id") % 500).alias("key")).agg(F.max_by("quality", "doc_id").alias("q"))
    j = read(spark, d, "documents").select("doc_id").join(b, F.col("doc_id") == F.col("key"), "left")
    return j.agg(count("docs"), F.count("key").alias("matched"), rnd(F.count("key") / F.count(F.lit(1))).alias("share"), F.count_if(F.col("q") == 1).alias("good"))


@query("g41_protocol_signature", "SELECT count(DISTINCT sig) = 1 AS same_protocol, count(*) AS seeds FROM (SELECT item % 3 AS seed, count(DISTINCT label) AS sig FROM items GROUP BY 1)")
def g41(spark, d):
    s = items(spark, d).groupBy((F.col("item") % 3).alias("seed")).agg(F.count_distinct("label").alias("sig"))
    return s.agg((F.count_distinct("sig") == 1).alias("same_protocol"), count("seeds"))


@query("w01_average_ranks", "SELECT item, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0::DOUBLE AS rank FROM items")
def w01(spark, d):
    return midranks(items(spark, d).select("item", "quality"), "quality").select("item", "rank")


@query("w02_cumulative_blocks", """
WITH b AS (SELECT round(score, 2) AS s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM pairs GROUP BY 1)
SELECT s, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS fp FROM b WINDOW w AS (ORDER BY s DESC)""")
def w02(spark, d):
    """Cumulative true and false positives at the end of each block of equal scores."""
    b = pairs(spark, d).groupBy(F.round("score", 2).alias("s")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    r = running_sums(b, [], "s", ["p", "n"], score_bucket("s"), descending=True)
    return r.select("s", (F.col("below_p") + F.col("p")).alias("tp"), (F.col("below_n") + F.col("n")).alias("fp"))


@query("w03_order_in_record", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn)::INTEGER AS position FROM conversations")
def w03(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("role", "turn")).alias("position"))


@query("w04_first_relevant_rank", """
WITH s AS (SELECT q.item AS query, g.item AS item, q.label = g.label AS rel, round(list_dot_product(q.vec, g.vec), 9) AS sim FROM items q, items g WHERE q.item % 50 = 0 AND q.item <> g.item),
b AS (SELECT query, max(sim) AS best FROM s WHERE rel GROUP BY query)
SELECT query, count(*) FILTER (sim > best) + 1 AS rank FROM s JOIN b USING (query) GROUP BY query""")
def w04(spark, d):
    from millrace.operators.similarity import first_ranks

    t = items(spark, d)
    return first_ranks(t.where("item % 50 = 0"), t, "label")


@query("w05_top_k_per_anchor", "SELECT item_a, item_b, score, row_number() OVER (PARTITION BY item_a ORDER BY score DESC, item_b)::INTEGER AS rank FROM pairs WHERE y = 0 QUALIFY rank IN (1, 3)")
def w05(spark, d):
    p = pairs(spark, d).where("y = 0").select("item_a", "item_b", "score")
    return top_k(p, 3, [F.desc("score"), F.col("item_b")], "item_a").where("rank in (1, 3)")


@query("w06_oldest_per_entity", "SELECT entity, arg_min(item, (-age, item)) AS item, max(age) AS age FROM items WHERE age IS NOT NULL GROUP BY entity")
def w06(spark, d):
    return items(spark, d).where("age is not null").groupBy("entity").agg(F.min_by("item", F.struct(-F.col("age"), F.col("item"))).alias("item"), F.max("age").alias("age"))


@query("w07_percentile_rank", "SELECT item, round((rank() OVER (PARTITION BY label ORDER BY quality) + (count(*) OVER (PARTITION BY label, quality) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY label), 6) AS pct FROM items")
def w07(spark, d):
    t = items(spark, d).select("item", "label", "quality")
    r = midranks(t, "quality", ["label"])
    return r.join(t.groupBy("label").agg(count("N")), "label").select("item", rnd(F.col("rank") / F.col("N")).alias("pct"))


@query("w08_ordinal_percentile", "SELECT item, round((row_number() OVER (ORDER BY quality, item) - 1)::DOUBLE / (count(*) OVER () - 1), 6) AS pct FROM items")
def w08(spark, d):
    t = items(spark, d).select("item", "quality").withColumn("o", F.struct("quality", "item")).withColumn("c", F.lit(1).cast("long"))
    r = running_sums(t, [], "o", ["c"], score_bucket("quality"))
    n = t.agg(count("N"))
    return r.crossJoin(F.broadcast(n)).select("item", rnd(F.col("below_c") / (F.col("N") - 1)).alias("pct"))  # one row


@query("w10_adjacent_pairs", "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations QUALIFY next IS NOT NULL")
def w10(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, d, "conversations").select("conv_id", "turn", F.lead("turn").over(w).alias("next")).where("next is not null")


@query("w11_weighted_median", """
WITH v AS (SELECT age, sum(quality) AS w FROM items WHERE age IS NOT NULL GROUP BY age), c AS (SELECT age, sum(w) OVER (ORDER BY age) AS cum, sum(w) OVER () AS total FROM v)
SELECT min(age) AS median FROM c WHERE cum >= total / 2 - 1e-9""")
def w11(spark, d):
    v = items(spark, d).where("age is not null").groupBy("age").agg(F.sum("quality").alias("w"))  # one row for each value
    r = running_sums(v, [], "age", ["w"], F.floor(F.col("age") / 8))
    total = v.agg(F.sum("w").alias("total"))
    return r.crossJoin(F.broadcast(total)).where("below_w + w >= total / 2 - 1e-9").agg(F.min("age").alias("median"))  # one row


@query("w12_ks_distance", """
WITH b AS (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM pairs GROUP BY 1), c AS (SELECT sum(p) OVER w / sum(p) OVER () AS fp, sum(n) OVER w / sum(n) OVER () AS fn FROM b WINDOW w AS (ORDER BY score))
SELECT round(max(abs(fp - fn)), 6) AS ks FROM c""")
def w12(spark, d):
    return ks_distance(pairs(spark, d), "score", "y").select(rnd(F.col("ks")).alias("ks"))


@query("w14_group_folds", """
SELECT entity, (row_number() OVER (ORDER BY md5('7|' || entity::VARCHAR), entity) - 1) % 5 AS fold FROM (SELECT DISTINCT entity FROM items)""")
def w14(spark, d):
    return group_folds(items(spark, d), "entity", 5, 7)


@query("k01_hardest", "SELECT item_a, item_b, score FROM pairs WHERE y = 0 ORDER BY score DESC, item_a, item_b LIMIT 100")
def k01(spark, d):
    """The hundred most similar negatives: a top-k report."""
    return pairs(spark, d).where("y = 0").select("item_a", "item_b", "score").orderBy(F.desc("score"), "item_a", "item_b").limit(100)


@query("k02_hash_split", """
WITH g AS (SELECT DISTINCT grp FROM items), r AS (SELECT grp, row_number() OVER (ORDER BY md5('42|' || grp::VARCHAR), grp) AS r, count(*) OVER () AS n FROM g)
SELECT grp, CASE WHEN r <= round(0.7::DOUBLE * n) THEN 'train' WHEN r <= round(0.7::DOUBLE * n) + round(0.15::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM r""")
def k02(spark, d):
    """Exact shares in hash order; positions from two-level counts."""
    g = hash_priority(items(spark, d).select("grp").distinct(), "grp", 42)
    n = g.agg(count("N"))
    a, b = F.round(0.7 * F.col("N")), F.round(0.15 * F.col("N"))
    return g.crossJoin(F.broadcast(n)).select("grp", F.when(F.col("position") <= a, "train").when(F.col("position") <= a + b, "val").otherwise("test").alias("split"))  # one row


@query("k03_hold_out_source", "SELECT source, CASE WHEN source = 'src3' THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY ALL")
def k03(spark, d):
    return read(spark, d, "documents").groupBy("source", F.when(F.col("source") == "src3", "test").otherwise("train").alias("split")).agg(count())


@query("k04_training_fraction", """
SELECT item, split FROM items WHERE split <> 'train' OR ('0x' || substr(md5('9|' || entity::VARCHAR), 1, 4))::INTEGER < 16384""")
def k04(spark, d):
    """A quarter of the training entities, chosen by hash; other splits whole."""
    from millrace.plans.tables import hash_fraction

    h = hash_fraction(F.concat(F.lit("9|"), F.col("entity").cast("string")))
    return items(spark, d).where((F.col("split") != "train") | (h < 16384)).select("item", "split")


@query("k05_stratum_sample", """
SELECT lang, doc_id, round(least(20, n)::DOUBLE / n, 6) AS probability FROM (SELECT lang, doc_id, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('3|' || doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 20""")
def k05(spark, d):
    return hash_sample(read(spark, d, "documents").select("lang", "doc_id"), "doc_id", ["lang"], 20, 3).select("lang", "doc_id", rnd(F.col("probability")).alias("probability"))


@query("k06_half_half_sample", """
SELECT quality, doc_id FROM (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('4|' || doc_id::VARCHAR), doc_id) AS r FROM labels) WHERE r <= 25""")
def k06(spark, d):
    return hash_sample(read(spark, d, "labels").select("quality", "doc_id"), "doc_id", ["quality"], 25, 4).select("quality", "doc_id")


@query("k09_random_negatives", """
SELECT item_a, item_b FROM (SELECT item_a, item_b, row_number() OVER (ORDER BY md5('5|' || item_a::VARCHAR || '|' || item_b::VARCHAR), item_a, item_b) AS r FROM pairs WHERE y = 0 AND split_a = split_b) WHERE r <= 200""")
def k09(spark, d):
    """A seeded sample of 200 negatives."""
    key = F.md5(F.concat(F.lit("5|"), F.col("item_a").cast("string"), F.lit("|"), F.col("item_b").cast("string")))
    return pairs(spark, d).where("y = 0 and split_a = split_b").select("item_a", "item_b", key.alias("k")).orderBy("k", "item_a", "item_b").limit(200).drop("k")


@query("k12_listing_dedup", """
SELECT user_id, arg_min(event_id, (event_type, event_id)) AS event_id FROM events GROUP BY user_id""")
def k12(spark, d):
    """The first occurrence over several sort orders wins."""
    return read(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("event_type", "event_id")).alias("event_id"))


@query("k14_top_bottom_means", """
WITH r AS (SELECT label, quality, row_number() OVER (PARTITION BY label ORDER BY quality DESC, item) AS hi, row_number() OVER (PARTITION BY label ORDER BY quality, item) AS lo FROM items)
SELECT label, round(avg(quality) FILTER (hi <= 5), 6) AS top, round(avg(quality) FILTER (lo <= 5), 6) AS bottom FROM r GROUP BY label""")
def k14(spark, d):
    t = items(spark, d).select("label", "quality", "item")
    top = top_k(t, 5, [F.desc("quality"), F.col("item")], "label").groupBy("label").agg(rnd(F.avg("quality")).alias("top"))
    return top.join(top_k(t, 5, [F.col("quality"), F.col("item")], "label").groupBy("label").agg(rnd(F.avg("quality")).alias("bottom")), "label")


@query("k15_banded_strata", """
WITH b AS (SELECT item_a, item_b, split_a || '/' || split_b AS sp, CASE WHEN score >= 0.3 THEN 'top' WHEN score >= 0.1 THEN 'mid' ELSE 'low' END AS band FROM pairs),
r AS (SELECT *, count(*) OVER (PARTITION BY sp, band) AS n, row_number() OVER (PARTITION BY sp, band ORDER BY md5('6|' || item_a::VARCHAR || '|' || item_b::VARCHAR), item_a, item_b) AS r FROM b)
SELECT item_a, item_b, sp, band, round(CASE WHEN band = 'top' THEN 1.0 ELSE least(10, n)::DOUBLE / n END, 6) AS probability FROM r WHERE band = 'top' OR r <= 10""")
def k15(spark, d):
    """The top band in full, ten of every other stratum, with inclusion probabilities."""
    band = F.when(F.col("score") >= 0.3, "top").when(F.col("score") >= 0.1, "mid").otherwise("low")
    b = pairs(spark, d).select("item_a", "item_b", F.concat("split_a", F.lit("/"), "split_b").alias("sp"), band.alias("band"))
    key = F.md5(F.concat(F.lit("6|"), F.col("item_a").cast("string"), F.lit("|"), F.col("item_b").cast("string")))
    n = b.groupBy("sp", "band").agg(count("N"))
    rest = top_k(b.where("band <> 'top'").withColumn("k", key), 10, [F.col("k"), F.col("item_a"), F.col("item_b")], "sp", "band").join(n, ["sp", "band"])
    rest = rest.select("item_a", "item_b", "sp", "band", rnd(F.least(F.lit(10), F.col("N")) / F.col("N")).alias("probability"))
    return rest.unionByName(b.where("band = 'top'").withColumn("probability", F.lit(1.0)))


@query("k16_decile_sample", """
WITH r AS (SELECT item, (rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pct FROM items),
b AS (SELECT item, least(floor(pct * 10), 9)::BIGINT AS decile FROM r)
SELECT item, decile FROM (SELECT *, row_number() OVER (PARTITION BY decile ORDER BY md5('8|' || item::VARCHAR), item) AS k FROM b) WHERE k <= 3""")
def k16(spark, d):
    t = items(spark, d).select("item", "quality")
    r = midranks(t, "quality").crossJoin(F.broadcast(t.agg(count("N"))))  # one row
    b = r.select("item", F.least(F.floor(F.col("rank") / F.col("N") * 10), F.lit(9)).alias("decile"))
    return hash_sample(b, "item", ["decile"], 3, 8).select("item", "decile")
