"""B: bootstrap intervals by unit, and the statistics that they summarise."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.replicates import CDF, DRAWS, auc_by_replicate, interval, multiplicity, paired_permutation, replicate, sums_by_replicate
from millrace.plans.metrics import RANK_SQL, _first_ranks, auc_sql
from millrace.plans.registry import query
from millrace.plans.tables import items, pairs

REPS = 1000
POINTS = "[" + ", ".join(f"{c!r}::DOUBLE" for c in CDF) + "]"
SUMMARY = "count(v) AS valid, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi"
PAIR_SQL = "item_a::VARCHAR || '_' || item_b::VARCHAR"
PAIR = "concat_ws('_', item_a, item_b)"


def m_sql(unit: str, seed: str) -> str:
    return f"len(list_filter({POINTS}, lambda c: c <= ('0x' || substr(md5({seed} || '|' || ((rep - 1) // {DRAWS})::VARCHAR || '|' || ({unit})::VARCHAR), ((rep - 1) % {DRAWS} * 5 + 1)::INTEGER, 5))::INTEGER / 1048576.0::DOUBLE))"


def drawn_sql(weight: str, source: str = "pairs") -> str:
    return f"(SELECT *, {weight} AS w FROM {source}, range(1, {REPS + 1}) t(rep))"


BOTH_SQL = m_sql("entity_a", "'6'") + " * CASE WHEN entity_a = entity_b THEN 1 ELSE " + m_sql("entity_b", "'6'") + " END"


def named(unit, seed):
    """What ``auc_by_replicate`` draws by: seed and unit."""
    return F.concat(F.lit(f"{seed}|"), unit.cast("string"))


def ends(seed: int):
    """Both entities of a pair; their product counts once, if they are one."""
    return [named(F.col("entity_a"), seed), named(F.col("entity_b"), seed)]


@query("b03_dyad_bootstrap", f"SELECT {SUMMARY} FROM (SELECT auc AS v FROM {auc_sql('score', by='rep', weight='w', source=drawn_sql(BOTH_SQL))})")
def b03(spark, d):
    """Owner and partner are drawn; a row weighs the product."""
    return interval(auc_by_replicate(pairs(spark, d), "score", REPS, ends(6)))


CLASS_SQL = m_sql(PAIR_SQL, "'5' || y::VARCHAR")


@query("b05_class_bootstrap", f"SELECT {SUMMARY} FROM (SELECT auc AS v FROM {auc_sql('score', by='rep', weight='w', source=drawn_sql(CLASS_SQL))})")
def b05(spark, d):
    """Positives and negatives are drawn independently."""
    unit = F.when(F.col("y") == 1, named(F.expr(PAIR), "51")).otherwise(named(F.expr(PAIR), "50"))
    return interval(auc_by_replicate(pairs(spark, d), "score", REPS, [unit]))


ANCHOR_SQL = drawn_sql(m_sql("item_a", "'7'"))


@query("b06_anchor_paired_gain", f"SELECT {SUMMARY}, round(avg((v > 0)::INTEGER), 6) AS share_above FROM (SELECT b.auc - a.auc AS v FROM {auc_sql('score', by='rep', weight='w', source=ANCHOR_SQL)} a JOIN {auc_sql('tuned', by='rep', weight='w', source=ANCHOR_SQL)} b USING (k))")
def b06(spark, d):
    """Gain of the second score on the same draws of anchors, and the share of replicates in which it is positive."""
    a, b = (auc_by_replicate(pairs(spark, d), s, REPS, [named(F.col("item_a"), 7)]) for s in ("score", "tuned"))
    both = a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), "rep").select("rep", (F.col("b") - F.col("a")).alias("v"))
    above = both.agg(F.round(F.avg((F.col("v") > 0).cast("int")), 6).alias("share_above"))
    return interval(both).crossJoin(F.broadcast(above))  # one row each


@query("b07_fold_bootstrap", f"""
WITH f AS (SELECT item_a % 10 AS fold, avg(((score >= 0.2) = (y = 1))::INTEGER) AS a FROM pairs GROUP BY 1)
SELECT {SUMMARY} FROM (SELECT rep, sum(w * a) / nullif(sum(w), 0) AS v FROM {drawn_sql(m_sql('fold', "'8'"), 'f')} GROUP BY rep HAVING sum(w) > 0)""")
def b07(spark, d):
    """Folds are drawn; each has its accuracy at a fixed threshold."""
    hit = ((F.col("score") >= 0.2) == (F.col("y") == 1)).cast("int")
    f = pairs(spark, d).groupBy((F.col("item_a") % 10).alias("fold")).agg(F.avg(hit).alias("a"))
    r = replicate(f, REPS, multiplicity(F.col("fold"), 8))
    return interval(r.groupBy("rep").agg((F.sum(F.col("w") * F.col("a")) / F.sum("w")).alias("v")))


MODELS_SQL = "(SELECT entity_a, entity_b, y, 'score' AS model, score AS s FROM pairs UNION ALL SELECT entity_a, entity_b, y, 'tuned', tuned FROM pairs)"


@query("b08_joint_models", f"""
WITH r AS (SELECT * FROM {drawn_sql(BOTH_SQL, MODELS_SQL)})
SELECT 'score' AS model, {SUMMARY} FROM (SELECT auc AS v FROM {auc_sql('s', by='rep', weight='w', where="model = 'score'", source='r')})
UNION ALL SELECT 'tuned', {SUMMARY} FROM (SELECT auc AS v FROM {auc_sql('s', by='rep', weight='w', where="model = 'tuned'", source='r')})""")
def b08(spark, d):
    """Several models on the same draws of subjects, in one pass."""
    long = pairs(spark, d).select("entity_a", "entity_b", "y", "score", "tuned").unpivot(["entity_a", "entity_b", "y"], ["score", "tuned"], "model", "s")
    return interval(auc_by_replicate(long, "s", REPS, ends(6), ("model",)), "model")


@query("b09_query_bootstrap", f"""
WITH {RANK_SQL}, q AS (SELECT rank, query // 6 AS entity FROM f)
SELECT {SUMMARY} FROM (SELECT rep, sum(w * (rank <= 5)::INTEGER)::DOUBLE / sum(w) AS v FROM {drawn_sql(m_sql('entity', "'9'"), 'q')} GROUP BY rep HAVING sum(w) > 0)""")
def b09(spark, d):
    """Recall among the first five over drawn query subjects; the gallery is fixed."""
    q = _first_ranks(spark, d).withColumn("entity", F.expr("query div 6"))
    r = sums_by_replicate(q, [(F.col("rank") <= 5).cast("int"), F.lit(1)], REPS, [named(F.col("entity"), 9)])
    return interval(r.select((F.col("s0") / F.nullif("s1", F.lit(0.0))).alias("v")))


@query("b10_error_rate_bootstrap", f"""
WITH r AS (SELECT rep, sum(w) FILTER (y = 0 AND score >= 0.2)::DOUBLE / nullif(sum(w) FILTER (y = 0), 0) AS fmr, sum(w) FILTER (y = 1 AND score < 0.2)::DOUBLE / nullif(sum(w) FILTER (y = 1), 0) AS fnmr FROM {drawn_sql(BOTH_SQL)} GROUP BY rep)
SELECT 'fmr' AS rate, {SUMMARY} FROM (SELECT fmr AS v FROM r) UNION ALL SELECT 'fnmr', {SUMMARY} FROM (SELECT fnmr AS v FROM r)""")
def b10(spark, d):
    """False match and non-match rates at a fixed threshold, both endpoints drawn."""
    one = lambda cond: F.when(F.expr(cond), 1)
    r = sums_by_replicate(pairs(spark, d), [one("y = 0 and score >= 0.2"), one("y = 0"), one("y = 1 and score < 0.2"), one("y = 1")], REPS, ends(6))
    rates = r.select("rep", (F.col("s0") / F.nullif("s1", F.lit(0.0))).alias("fmr"), (F.col("s2") / F.nullif("s3", F.lit(0.0))).alias("fnmr"))
    return interval(rates.unpivot(["rep"], ["fmr", "fnmr"], "rate", "v"), "rate")


@query("b11_cluster_mean", f"SELECT {SUMMARY} FROM (SELECT rep, sum(w * quality) / sum(w) AS v FROM {drawn_sql(m_sql('entity', chr(39) + '11' + chr(39)), 'items')} GROUP BY rep HAVING sum(w) > 0)")
def b11(spark, d):
    """Mean of a column with whole clusters drawn."""
    units = items(spark, d).groupBy("entity").agg(F.sum("quality").alias("q"), F.count(F.lit(1)).alias("rows"))
    r = sums_by_replicate(units, [F.col("q"), F.col("rows")], REPS, [named(F.col("entity"), 11)])
    return interval(r.select((F.col("s0") / F.nullif("s1", F.lit(0.0))).alias("v")))


@query("b12_equal_person_error", f"""
WITH p AS (SELECT entity, avg(abs(age - (item % 80 + 1)) - abs(age - 40)) AS e FROM items WHERE age IS NOT NULL GROUP BY entity)
SELECT {SUMMARY} FROM (SELECT rep, sum(w * e) / sum(w) AS v FROM {drawn_sql(m_sql('entity', "'12'"), 'p')} GROUP BY rep HAVING sum(w) > 0)""")
def b12(spark, d):
    """Difference of two predictors' errors; every person counts alike."""
    e = F.abs(F.col("age") - (F.col("item") % 80 + 1)) - F.abs(F.col("age") - 40)
    # sixtieths: the means of up to six whole numbers are whole, so their sums have no rounding
    p = items(spark, d).where("age is not null").groupBy("entity").agg((F.sum(e) * 60 / F.count(F.lit(1))).alias("e"))
    r = sums_by_replicate(p, [F.col("e"), F.lit(1)], REPS, [named(F.col("entity"), 12)])
    return interval(r.select((F.col("s0") / F.nullif(F.col("s1") * 60, F.lit(0.0))).alias("v")))


@query("b14_anchor_entity_bootstrap", f"SELECT {SUMMARY} FROM (SELECT auc AS v FROM {auc_sql('score', by='rep', weight='w', source=drawn_sql(m_sql('entity_a', chr(39) + '14' + chr(39))))})")
def b14(spark, d):
    """Entities of the anchors are drawn, whole blocks of pairs with them."""
    return interval(auc_by_replicate(pairs(spark, d), "score", REPS, [named(F.col("entity_a"), 14)]))


GAIN_SQL = drawn_sql(m_sql(PAIR_SQL, "'15'"))


@query("b15_paired_gain_by_split", " UNION ALL ".join(f"""
SELECT '{s}' AS split, {SUMMARY} FROM (SELECT CASE WHEN (SELECT count(*) >= 40 AND count(*) FILTER (y = 1) >= 2 AND count(*) FILTER (y = 0) >= 2 FROM pairs WHERE split_a = '{s}') THEN b.auc - a.auc END AS v
FROM {auc_sql('score', by='rep', weight='w', where=f"split_a = '{s}'", source=GAIN_SQL)} a JOIN {auc_sql('tuned', by='rep', weight='w', where=f"split_a = '{s}'", source=GAIN_SQL)} b USING (k))""" for s in ("train", "val", "test")))
def b15(spark, d):
    """Gain of the second score by split; no value below 40 rows or two of a class."""
    p = pairs(spark, d).withColumnRenamed("split_a", "split")
    n = p.groupBy("split").agg(((F.count(F.lit(1)) >= 40) & (F.count_if(F.col("y") == 1) >= 2) & (F.count_if(F.col("y") == 0) >= 2)).alias("enough"))
    a, b = (auc_by_replicate(p, s, REPS, [named(F.expr(PAIR), 15)], ("split",)).withColumnRenamed("v", s) for s in ("score", "tuned"))
    v = a.join(b, ["rep", "split"]).join(n, "split").select("split", F.when(F.col("enough"), F.col("tuned") - F.col("score")).alias("v"))
    return interval(v, "split")


@query("b01_pair_bootstrap", f"SELECT {SUMMARY} FROM (SELECT auc AS v FROM {auc_sql('score', by='rep', weight='w', source=drawn_sql(m_sql(PAIR_SQL, chr(39) + '1' + chr(39))))})")
def b01(spark, d):
    """Percentile interval of the AUC over resampled pairs."""
    return interval(auc_by_replicate(pairs(spark, d), "score", REPS, [named(F.expr(PAIR), 1)]))


@query("b02_subject_bootstrap", f"SELECT {SUMMARY} FROM (SELECT auc AS v FROM {auc_sql('tuned', by='rep', weight='w', source=drawn_sql(BOTH_SQL))})")
def b02(spark, d):
    """Entities are resampled; a pair weighs the product of its two entities' multiplicities."""
    return interval(auc_by_replicate(pairs(spark, d), "tuned", REPS, ends(6)))


@query("v19_permutation_test")
def v19(spark, d):
    """Paired permutation p value of 10,000 permutations: a coin swaps the two scores of each row."""
    return paired_permutation(pairs(spark, d), "score", "tuned", F.expr(PAIR), 10_000, 11)
