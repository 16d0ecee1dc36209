"""V: verification, ranking and calibration metrics; B: resampling; L: tabular models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import buckets
from millrace.operators import models
from millrace.operators import verification as v
from millrace.operators.quantiles import positions
from millrace.operators.sampling import group_folds
from millrace.plans.projections import GAP_SQL
from millrace.plans.registry import query
from millrace.plans.tables import daily, items, pairs, read

count = lambda name="n": F.count(F.lit(1)).alias(name)
rnd = lambda c, n=6: F.round(c, n)


def auc_sql(score: str, by: str = "", where: str = "true", weight: str = "1", label: str = "y", source: str = "pairs") -> str:
    """AUC over ``source`` in DuckDB, by blocks of equal scores."""
    sel, part = (f"{by} AS k, ", "PARTITION BY k ") if by else ("", "")
    return f"""(SELECT {'k, ' if by else ''}sum(p * (below + n / 2.0::DOUBLE)) / nullif(sum(p) * sum(n), 0) AS auc FROM (
      SELECT *, coalesce(sum(n) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
        SELECT {sel}{score} AS s, coalesce(sum({weight}) FILTER ({label} = 1), 0)::DOUBLE AS p, coalesce(sum({weight}) FILTER ({label} = 0), 0)::DOUBLE AS n FROM {source} WHERE {where} GROUP BY ALL)) {'GROUP BY k' if by else ''})"""


@query("v01_roc_auc", f"SELECT round(auc, 6) AS auc FROM {auc_sql('score')}")
def v01(spark, d):
    return v.auc(pairs(spark, d), "score", "y").select(rnd(F.col("auc")).alias("auc"))


@query("v02_weighted_auc", f"SELECT round(auc, 6) AS auc FROM {auc_sql('score', weight='1 + item_a % 3')}")
def v02(spark, d):
    return v.auc(pairs(spark, d), "score", "y", weight=1 + F.col("item_a") % 3).select(rnd(F.col("auc")).alias("auc"))


RATES_SQL = """b AS (SELECT score AS s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM pairs GROUP BY 1),
r AS (SELECT s, (sum(n) OVER w)::DOUBLE / sum(n) OVER () AS far, (sum(p) OVER w)::DOUBLE / sum(p) OVER () AS tar FROM b WINDOW w AS (ORDER BY s DESC))"""


@query("v03_eer", f"WITH {RATES_SQL} SELECT round(min(greatest(far, 1 - tar)), 6) AS eer FROM r")
def v03(spark, d):
    return v.eer(pairs(spark, d), "score", "y").select(rnd(F.col("eer")).alias("eer"))


@query("v04_eer_interpolated", f"""
WITH {RATES_SQL}, x AS (SELECT far, 1 - tar AS frr, lag(far) OVER (ORDER BY s DESC) AS far0, lag(1 - tar) OVER (ORDER BY s DESC) AS frr0 FROM r),
c AS (SELECT coalesce(far0, 0) AS far0, coalesce(frr0, 1) AS frr0, far, frr FROM x WHERE far >= frr AND coalesce(far0, 0) < coalesce(frr0, 1))
SELECT round(min(far0 + (far - far0) * (frr0 - far0) / ((frr0 - far0) + (far - frr))), 6) AS eer FROM c""")
def v04(spark, d):
    """Where the two error curves cross, linear between neighbouring thresholds; the crossing row is found by rates, so one window over few rows is enough."""
    r = v.rates(pairs(spark, d), "score", "y").select("far", (1 - F.col("tar")).alias("frr"))
    before = r.where("far < frr").agg(F.max(F.struct("far", F.col("frr"))).alias("x"), F.min("frr").alias("frr0"))
    before = before.select(F.coalesce("x.far", F.lit(0.0)).alias("far0"), F.coalesce("frr0", F.lit(1.0)).alias("frr0"))
    after = r.where("far >= frr").agg(F.min("far").alias("far"), F.max("frr").alias("frr"))
    f0, r0, f1, r1 = (F.col(c) for c in ("far0", "frr0", "far", "frr"))
    return before.crossJoin(F.broadcast(after)).select(rnd(f0 + (f1 - f0) * (r0 - f0) / ((r0 - f0) + (f1 - r1))).alias("eer"))  # one row each


@query("v05_tar_legacy", """
WITH c AS (SELECT floor(0.01 * count(*))::BIGINT AS k, max(score) AS top FROM pairs WHERE y = 0),
t AS (SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS r FROM pairs WHERE y = 0), c WHERE r = k)
SELECT round(avg((score >= (SELECT score FROM t))::INTEGER), 6) AS tar FROM pairs WHERE y = 1""")
def v05(spark, d):
    """The threshold is the k-th largest negative, k the floor of the target times their number: ties may exceed the target."""
    p = pairs(spark, d).select("score", "y")
    n = p.where("y = 0").agg(F.floor(0.01 * F.count(F.lit(1))).alias("k"))
    b = v.blocks(p, "score", "y", descending=True).crossJoin(F.broadcast(n))  # one row
    t = b.where("below_n < k and below_n + n >= k").select(F.col("score").alias("t"))
    return p.where("y = 1").crossJoin(F.broadcast(t)).agg(rnd(F.avg((F.col("score") >= F.col("t")).cast("int"))).alias("tar"))  # one row


@query("v06_tar_tie_safe", f"WITH {RATES_SQL} SELECT f AS target, round(coalesce(max(tar) FILTER (far <= f), 0), 6) AS tar FROM r, (VALUES (0.001::DOUBLE), (0.01), (0.1)) t(f) GROUP BY f")
def v06(spark, d):
    r = v.rates(pairs(spark, d), "score", "y").withColumn("target", F.explode(F.array(*map(F.lit, (0.001, 0.01, 0.1)))))
    return r.groupBy("target").agg(rnd(F.coalesce(F.max(F.when(F.col("far") <= F.col("target"), F.col("tar"))), F.lit(0.0))).alias("tar"))


@query("v07_dev_calibrated", """
WITH t AS (SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score DESC, item_a, item_b) AS r, count(*) OVER () AS n FROM pairs WHERE y = 0 AND split_a = 'val') WHERE r = floor(0.05 * n)::BIGINT + 1)
SELECT round(avg((score > (SELECT score FROM t))::INTEGER) FILTER (y = 1), 6) AS tar, round(avg((score > (SELECT score FROM t))::INTEGER) FILTER (y = 0), 6) AS far FROM pairs WHERE split_a = 'test'""")
def v07(spark, d):
    p = pairs(spark, d)
    dev = p.where("split_a = 'val'")
    n = dev.where("y = 0").agg((F.floor(0.05 * F.count(F.lit(1))) + 1).alias("k"))
    t = v.blocks(dev, "score", "y", descending=True).crossJoin(F.broadcast(n)).where("below_n < k and below_n + n >= k").select(F.col("score").alias("t"))  # one row
    hit = (F.col("score") > F.col("t")).cast("int")
    x = p.where("split_a = 'test'").crossJoin(F.broadcast(t))  # one row
    return x.agg(rnd(F.avg(F.when(F.col("y") == 1, hit))).alias("tar"), rnd(F.avg(F.when(F.col("y") == 0, hit))).alias("far"))


@query("v08_subgroup_error_rates", f"SELECT {GAP_SQL} AS bucket, round(avg((score >= 0.2)::INTEGER) FILTER (y = 0), 6) AS fmr, round(avg((score < 0.2)::INTEGER) FILTER (y = 1), 6) AS fnmr FROM pairs GROUP BY GROUPING SETS ((), (bucket))")
def v08(spark, d):
    """One global threshold applied to every subgroup, and overall."""
    p = pairs(spark, d).select(buckets.gap_bucket(F.col("gap")).alias("bucket"), "y", (F.col("score") >= 0.2).cast("int").alias("hit"))
    return p.rollup("bucket").agg(rnd(F.avg(F.when(F.col("y") == 0, F.col("hit")))).alias("fmr"), rnd(F.avg(F.when(F.col("y") == 1, 1 - F.col("hit")))).alias("fnmr"))


@query("v09_kfold_threshold", """
WITH f AS (SELECT item_a % 10 AS fold, score, y FROM pairs), g AS (SELECT -0.5::DOUBLE + 0.01 * i AS t FROM range(0, 101) r(i)),
a AS (SELECT k.fold, g.t, avg(((f.score >= g.t) = (f.y = 1))::INTEGER) FILTER (f.fold <> k.fold) AS train, avg(((f.score >= g.t) = (f.y = 1))::INTEGER) FILTER (f.fold = k.fold) AS test FROM f, g, (SELECT DISTINCT fold FROM f) k GROUP BY 1, 2),
b AS (SELECT fold, arg_max(test, (round(train, 9), -t)) AS test FROM a GROUP BY fold)
SELECT round(avg(test), 6) AS accuracy, round(stddev_samp(test), 6) AS sd FROM b""")
def v09(spark, d):
    """Each fold's threshold is the best of a fixed grid on the other folds; hits are counted by grid cell once, then summed over the grid."""
    i = F.greatest(F.lit(-1), F.least(F.lit(100), F.floor(F.round((F.col("score") + 0.5) / 0.01, 6))))
    h = pairs(spark, d).groupBy((F.col("item_a") % 10).alias("fold"), i.alias("cell")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    grid = h.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(100))))
    ok = F.sum(F.when(F.col("cell") >= F.col("g"), F.col("p")).otherwise(F.col("n")))
    per = grid.groupBy("fold", "g").agg(ok.alias("ok"), F.sum(F.col("p") + F.col("n")).alias("all"))
    w = Window.partitionBy("g")
    per = per.withColumn("train", (F.sum("ok").over(w) - F.col("ok")) / (F.sum("all").over(w) - F.col("all")))
    best = per.groupBy("fold").agg(F.max_by(F.col("ok") / F.col("all"), F.struct(F.round("train", 9), -F.col("g"))).alias("test"))
    return best.agg(rnd(F.avg("test")).alias("accuracy"), rnd(F.stddev_samp("test")).alias("sd"))


@query("v11_per_bucket_auc", f"SELECT k AS bucket, round(auc, 6) AS auc FROM {auc_sql('score', by=GAP_SQL)}")
def v11(spark, d):
    p = pairs(spark, d).withColumn("bucket", buckets.gap_bucket(F.col("gap")))
    return v.auc(p, "score", "y", ["bucket"]).select("bucket", rnd(F.col("auc")).alias("auc"))


@query("v12_supported_strata", f"""
WITH s AS (SELECT age_a // 10 AS k, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM pairs WHERE age_a IS NOT NULL GROUP BY 1)
SELECT s.k AS stratum, s.p, s.n, CASE WHEN s.p >= 20 AND s.n >= 20 THEN round(a.auc, 6) END AS auc FROM s JOIN {auc_sql('score', by='age_a // 10', where='age_a IS NOT NULL')} a ON s.k = a.k""")
def v12(spark, d):
    p = pairs(spark, d).where("age_a is not null").withColumn("stratum", F.expr("age_a div 10"))
    s = p.groupBy("stratum").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    return s.join(v.auc(p, "score", "y", ["stratum"]), "stratum").select("stratum", "p", "n", F.when((F.col("p") >= 20) & (F.col("n") >= 20), rnd(F.col("auc"))).alias("auc"))


RANK_SQL = """s AS (SELECT q.item AS query, g.item AS item, q.label = g.label AS rel, round(list_dot_product(q.vec, g.vec), 9) AS sim FROM items q, items g WHERE q.item % 50 = 0 AND q.item <> g.item),
m AS (SELECT query, max(sim) AS best FROM s WHERE rel GROUP BY query), f AS (SELECT query, count(*) FILTER (sim > best) + 1 AS rank FROM s JOIN m USING (query) GROUP BY query)"""


def _first_ranks(spark, d):
    from millrace.operators.similarity import first_ranks

    t = items(spark, d)
    return first_ranks(t.where("item % 50 = 0"), t, "label")


@query("v13_retrieval", f"WITH {RANK_SQL} SELECT round(avg((rank = 1)::INTEGER), 6) AS rank1, round(avg((rank <= 5)::INTEGER), 6) AS recall5, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(median(rank), 6) AS med FROM f")
def v13(spark, d):
    r = F.col("rank")
    return _first_ranks(spark, d).agg(rnd(F.avg((r == 1).cast("int"))).alias("rank1"), rnd(F.avg((r <= 5).cast("int"))).alias("recall5"), rnd(F.avg(1 / r)).alias("mrr"), rnd(F.percentile("rank", 0.5)).alias("med"))


@query("w13_cmc_curve", f"WITH {RANK_SQL} SELECT k::INTEGER AS k, round(avg((rank <= k)::INTEGER), 6) AS hit FROM f, range(1, 51) r(k) GROUP BY k")
def w13(spark, d):
    return _first_ranks(spark, d).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50)))).groupBy("k").agg(rnd(F.avg((F.col("rank") <= F.col("k")).cast("int"))).alias("hit"))


@query("v14_oldest_gallery", """
WITH o AS (SELECT entity, arg_min(item, (-age, item)) AS item FROM items WHERE age IS NOT NULL GROUP BY entity), g AS (SELECT i.* FROM items i JOIN o USING (item)),
s AS (SELECT q.item AS query, q.entity = g.entity AS rel, round(list_dot_product(q.vec, g.vec), 9) AS sim FROM items q, g WHERE q.item % 50 = 0 AND q.item <> g.item),
m AS (SELECT query, max(sim) AS best FROM s WHERE rel GROUP BY query)
SELECT query, count(*) FILTER (sim > best) + 1 AS rank FROM s JOIN m USING (query) GROUP BY query""")
def v14(spark, d):
    """Ranks of the right entity when the gallery holds each entity's oldest item."""
    from millrace.operators.similarity import first_ranks

    t = items(spark, d)
    oldest = t.where("age is not null").groupBy("entity").agg(F.min_by(F.struct("item", "vec"), F.struct(-F.col("age"), F.col("item"))).alias("x")).select("entity", "x.item", "x.vec")
    return first_ranks(t.where("item % 50 = 0"), oldest, "entity")


@query("v15_calibration", """
WITH p AS (SELECT (1 + score) / 2 AS p, y FROM pairs), b AS (SELECT floor(least(p * 10, 9)) AS b, count(*) AS n, avg(p) AS c, avg(y) AS a, sum((p - y) * (p - y)) AS sq FROM p GROUP BY 1)
SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier FROM b""")
def v15(spark, d):
    p = pairs(spark, d).select(((1 + F.col("score")) / 2).alias("prob"), "y")
    return v.ece_brier(p, "prob", "y").select(rnd(F.col("ece")).alias("ece"), rnd(F.col("brier")).alias("brier"))


@query("v16_platt_calibrator")
def v16(spark, d):
    """Logistic calibrators on the training split, by score alone and with the gap."""
    return models.platt(pairs(spark, d).where("gap is not null"))


@query("v17_stratum_logistic")
def v17(spark, d):
    """Slope and intercept of each stratum by damped Newton steps on sufficient statistics of binned scores."""
    p = pairs(spark, d).where("age_a is not null").select(F.expr("age_a div 10").alias("stratum"), "score", "y")
    return models.stratum_logistic(p, "stratum", "score", "y")


@query("v18_delong", f"""
WITH t AS (SELECT item_a, item_b, y, score, tuned FROM pairs),
c1 AS (SELECT score AS s, (coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0::DOUBLE) / sum(n) OVER () AS beats, (sum(p) OVER () - coalesce(sum(p) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - p / 2.0::DOUBLE) / sum(p) OVER () AS beaten FROM (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM t GROUP BY 1)),
c2 AS (SELECT tuned AS s, (coalesce(sum(n) OVER (ORDER BY tuned ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0::DOUBLE) / sum(n) OVER () AS beats, (sum(p) OVER () - coalesce(sum(p) OVER (ORDER BY tuned ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - p / 2.0::DOUBLE) / sum(p) OVER () AS beaten FROM (SELECT tuned, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM t GROUP BY 1)),
v AS (SELECT y, CASE WHEN y = 1 THEN c1.beats ELSE c1.beaten END AS v1, CASE WHEN y = 1 THEN c2.beats ELSE c2.beaten END AS v2 FROM t JOIN c1 ON t.score = c1.s JOIN c2 ON t.tuned = c2.s),
a AS (SELECT avg(v1) FILTER (y = 1) AS auc1, avg(v2) FILTER (y = 1) AS auc2, var_samp(v1 - v2) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(v1 - v2) FILTER (y = 0) / count(*) FILTER (y = 0) AS var FROM v)
SELECT round(auc1, 6) AS auc1, round(auc2, 6) AS auc2, round((auc1 - auc2) / sqrt(var), 4) AS z FROM a""")
def v18(spark, d):
    p = pairs(spark, d).select(F.struct("item_a", "item_b").alias("key"), "y", "score", "tuned")
    return v.delong(p, "score", "tuned", "y", "key").select(rnd(F.col("auc1")).alias("auc1"), rnd(F.col("auc2")).alias("auc2"), rnd(F.col("z"), 4).alias("z"))


@query("v20_cue_auc", f"SELECT 'age_a' AS cue, round(greatest(auc, 1 - auc), 6) AS auc FROM {auc_sql('age_a::DOUBLE', where='age_a IS NOT NULL')} UNION ALL SELECT 'gap', round(greatest(auc, 1 - auc), 6) FROM {auc_sql('gap::DOUBLE', where='gap IS NOT NULL')}")
def v20(spark, d):
    """How well an attribute alone tells the classes apart."""
    p = pairs(spark, d)
    out = None
    for cue in ("age_a", "gap"):
        a = v.auc(p.where(F.col(cue).isNotNull()).select(F.col(cue).cast("double").alias("s"), "y"), "s", "y")
        row = a.select(F.lit(cue).alias("cue"), rnd(F.greatest(F.col("auc"), 1 - F.col("auc"))).alias("auc"))
        out = row if out is None else out.unionByName(row)
    return out


@query("v21_total_variation", """
WITH h AS (SELECT gap, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM pairs GROUP BY gap), t AS (SELECT sum(abs(p / (SELECT sum(p) FROM h) - q / (SELECT sum(q) FROM h))) / 2 AS tv FROM h)
SELECT round(tv, 6) AS tv, round((1 + tv) / 2, 6) AS oracle_accuracy FROM t""")
def v21(spark, d):
    return v.total_variation(pairs(spark, d), "gap", "y").select(rnd(F.col("tv")).alias("tv"), rnd(F.col("oracle_accuracy")).alias("oracle_accuracy"))


@query("v22_mean_gap", "SELECT round(avg(gap) FILTER (y = 1), 6) AS pos, round(avg(gap) FILTER (y = 0), 6) AS neg, round(avg(gap) FILTER (y = 1) - avg(gap) FILTER (y = 0), 6) AS diff FROM pairs")
def v22(spark, d):
    a = lambda k: F.avg(F.when(F.col("y") == k, F.col("gap")))
    return pairs(spark, d).agg(rnd(a(1)).alias("pos"), rnd(a(0)).alias("neg"), rnd(a(1) - a(0)).alias("diff"))


@query("v24_missing_pattern_tv", """
WITH h AS (SELECT (age_a IS NULL)::INTEGER::VARCHAR || (age_b IS NULL)::INTEGER::VARCHAR AS pat, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM pairs GROUP BY 1)
SELECT round(sum(abs(p / (SELECT sum(p) FROM h) - q / (SELECT sum(q) FROM h))) / 2, 6) AS tv FROM h""")
def v24(spark, d):
    pat = F.concat(F.col("age_a").isNull().cast("int").cast("string"), F.col("age_b").isNull().cast("int").cast("string"))
    return v.total_variation(pairs(spark, d).withColumn("pat", pat), "pat", "y").select(rnd(F.col("tv")).alias("tv"))


@query("v25_separability", "SELECT round(avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0), 6) AS gap, round((avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0)) / sqrt((var_pop(score) FILTER (y = 1) + var_pop(score) FILTER (y = 0)) / 2), 6) AS d FROM pairs")
def v25(spark, d):
    of = lambda f, k: f(F.when(F.col("y") == k, F.col("score")))
    g = of(F.avg, 1) - of(F.avg, 0)
    return pairs(spark, d).agg(rnd(g).alias("gap"), rnd(g / F.sqrt((of(F.var_pop, 1) + of(F.var_pop, 0)) / 2)).alias("d"))


@query("v27_ndcg_lift", """
WITH t AS (SELECT user_id, sum(views) AS score, sum(likes + comments) AS rel FROM daily GROUP BY user_id), m AS (SELECT *, (rel - min(rel) OVER ()) / nullif((max(rel) OVER () - min(rel) OVER ())::DOUBLE, 0) AS g FROM t),
r AS (SELECT g, rel, row_number() OVER (ORDER BY score DESC, user_id) AS a, row_number() OVER (ORDER BY g DESC, user_id) AS b FROM m)
SELECT round(sum(g / log2(a + 1)) FILTER (a <= 20) / sum(g / log2(b + 1)) FILTER (b <= 20), 6) AS ndcg, round(avg(rel) FILTER (a <= 20) / avg(rel), 6) AS lift FROM r""")
def v27(spark, d):
    """Both orders only need their first twenty rows."""
    t = daily(spark, d).groupBy("user_id").agg(F.sum("views").alias("score"), F.sum(F.col("likes") + F.col("comments")).alias("rel"))
    m = t.crossJoin(F.broadcast(t.agg(F.min("rel").alias("lo"), F.max("rel").alias("hi"), F.avg("rel").alias("mean"))))  # one row
    m = m.withColumn("g", (F.col("rel") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")).cast("double"), F.lit(0.0)))

    def head(*order):
        return m.orderBy(*order).limit(20).withColumn("r", F.row_number().over(Window.orderBy(*order)))  # twenty rows

    got = head(F.desc("score"), F.col("user_id")).agg(F.sum(F.col("g") / F.log2(F.col("r") + 1)).alias("dcg"), (F.avg("rel") / F.first("mean")).alias("lift"))
    ideal = head(F.desc("g"), F.col("user_id")).agg(F.sum(F.col("g") / F.log2(F.col("r") + 1)).alias("ideal"))
    return got.crossJoin(F.broadcast(ideal)).select(rnd(F.col("dcg") / F.col("ideal")).alias("ndcg"), rnd(F.col("lift")).alias("lift"))  # one row each


@query("v28_regression_metrics", """
WITH t AS (SELECT score AS x, tuned AS y FROM pairs), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM t)
SELECT round(1 - sum((y - x) * (y - x)) / (count(*) * var_pop(y)), 6) AS r2, round(sqrt(avg((y - x) * (y - x))), 6) AS rmse, round(avg(abs(y - x)), 6) AS mae, round(corr(rx, ry), 6) AS spearman FROM r""")
def v28(spark, d):
    t = pairs(spark, d).select(F.col("score").alias("x"), F.col("tuned").alias("y"))
    r = v.midranks(v.midranks(t, "x", name="rx"), "y", name="ry")
    e = F.col("y") - F.col("x")
    return r.agg(rnd(1 - F.sum(e * e) / (F.count(F.lit(1)) * F.var_pop("y"))).alias("r2"), rnd(F.sqrt(F.avg(e * e))).alias("rmse"), rnd(F.avg(F.abs(e))).alias("mae"), rnd(F.corr("rx", "ry")).alias("spearman"))


@query("v29_partial_correlation", """
WITH c AS (SELECT corr(score, gap) AS xz, corr(y, gap) AS yz, corr(score, y) AS xy FROM pairs WHERE gap IS NOT NULL)
SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c""")
def v29(spark, d):
    c = pairs(spark, d).where("gap is not null").agg(F.corr("score", "gap").alias("xz"), F.corr("y", "gap").alias("yz"), F.corr("score", "y").alias("xy"))
    xz, yz = F.col("xz"), F.col("yz")
    return c.select(rnd((F.col("xy") - xz * yz) / F.sqrt((1 - xz * xz) * (1 - yz * yz))).alias("partial"))


@query("v30_pairwise_agreement", "SELECT round(avg((sign(a.quality - b.quality) = sign(a.age - b.age))::INTEGER), 6) AS agreement, count(*) AS n FROM pairs p JOIN items a ON p.item_a = a.item JOIN items b ON p.item_b = b.item WHERE a.age IS NOT NULL AND b.age IS NOT NULL")
def v30(spark, d):
    p = pairs(spark, d, extra=("quality",)).where("age_a is not null and age_b is not null")
    same = F.signum(F.col("quality_a") - F.col("quality_b")) == F.signum((F.col("age_a") - F.col("age_b")).cast("double"))
    return p.agg(rnd(F.avg(same.cast("int"))).alias("agreement"), count())


@query("v31_one_sided_audit", """
SELECT source, CASE WHEN count(DISTINCT toxic) = 1 AND min(toxic) = 1 THEN 'ppv' WHEN count(DISTINCT toxic) = 1 THEN 'npv' ELSE 'accuracy' END AS metric, round(avg((quality = toxic)::INTEGER), 6) AS value FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def v31(spark, d):
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    n = F.count_distinct("toxic")
    m = F.when((n == 1) & (F.min("toxic") == 1), "ppv").when(n == 1, "npv").otherwise("accuracy")
    return j.groupBy("source").agg(m.alias("metric"), rnd(F.avg((F.col("quality") == F.col("toxic")).cast("int"))).alias("value"))


@query("v32_event_flags", "SELECT source, count(*) FILTER (toxic = 1) AS events, CASE WHEN count(*) FILTER (toxic = 1) = 0 THEN 'zero' WHEN count(*) FILTER (toxic = 1) < 5 THEN 'few' ELSE 'ok' END AS flag FROM labels JOIN documents USING (doc_id) GROUP BY source")
def v32(spark, d):
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    e = F.count_if(F.col("toxic") == 1)
    return j.groupBy("source").agg(e.alias("events"), F.when(e == 0, "zero").when(e < 5, "few").otherwise("ok").alias("flag"))


@query("v33_auc_by_regime", f"SELECT k AS regime, round(auc, 6) AS auc FROM {auc_sql('score', by='regime', source='(SELECT *, unnest(CASE WHEN gap >= 25 THEN [' + chr(39) + 'all' + chr(39) + ', ' + chr(39) + 'large' + chr(39) + '] ELSE [' + chr(39) + 'all' + chr(39) + '] END) AS regime FROM pairs)')}")
def v33(spark, d):
    regimes = F.explode(F.when(F.col("gap") >= 25, F.array(F.lit("all"), F.lit("large"))).otherwise(F.array(F.lit("all"))))
    return v.auc(pairs(spark, d).withColumn("regime", regimes), "score", "y", ["regime"]).select("regime", rnd(F.col("auc")).alias("auc"))


@query("v35_endpoint_tv", """
WITH e AS (SELECT y, unnest([item_a, item_b]) AS item FROM pairs), h AS (SELECT item, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM e GROUP BY item)
SELECT round(sum(abs(p / (SELECT sum(p) FROM h) - q / (SELECT sum(q) FROM h))) / 2, 6) AS tv FROM h""")
def v35(spark, d):
    e = pairs(spark, d).select("y", F.explode(F.array("item_a", "item_b")).alias("item"))
    return v.total_variation(e, "item", "y").select(rnd(F.col("tv")).alias("tv"))


@query("v37_benchmark_suite", f"SELECT k AS split, round(auc, 6) AS auc FROM {auc_sql('score', by='split_a')}")
def v37(spark, d):
    return v.auc(pairs(spark, d).withColumnRenamed("split_a", "split"), "score", "y", ["split"]).select("split", rnd(F.col("auc")).alias("auc"))


@query("b04_leave_one_subject_out", f"""
SELECT k AS label, round(auc, 6) AS auc FROM {auc_sql('score', by='k2', source='(SELECT p.*, g.k2 FROM pairs p JOIN items i ON p.item_a = i.item JOIN items j ON p.item_b = j.item, (SELECT DISTINCT label AS k2 FROM items) g WHERE i.label <> g.k2 AND j.label <> g.k2)')}""")
def b04(spark, d):
    """AUC without one subject at a time; here the ten labels are the subjects."""
    p = pairs(spark, d, extra=("label",)).select("score", "y", "label_a", "label_b")
    everyone = items(spark, d).select(F.col("label").alias("subject")).distinct()
    return v.leave_one_out_auc(p, "score", "y", ["label_a", "label_b"], everyone).select(F.col("subject").alias("label"), rnd(F.col("auc")).alias("auc"))


@query("b13_bucket_shuffle", """
WITH r AS (SELECT user_id, day, views, row_number() OVER (PARTITION BY day ORDER BY user_id) AS a, row_number() OVER (PARTITION BY day ORDER BY md5('13|' || user_id::VARCHAR), user_id) AS b FROM daily)
SELECT x.user_id, x.day, y.views FROM r x JOIN r y ON x.day = y.day AND x.a = y.b""")
def b13(spark, d):
    """Values shuffled within their bucket by hash order, a negative control; places are counted in two levels, by ranges of ids and of hashes."""
    t = daily(spark, d).select("user_id", "day", "views")
    key = F.md5(F.concat(F.lit("13|"), F.col("user_id").cast("string")))
    a = positions(t.select("user_id", "day"), ["day"], [F.col("user_id")], F.floor(F.col("user_id") / 1024))
    b = positions(t.withColumn("key", key), ["day"], [F.col("key"), F.col("user_id")], F.substring("key", 1, 4))
    return a.join(b.select("day", "position", "views"), ["day", "position"]).select("user_id", "day", "views")


@query("l03_fold_leakage", "SELECT 'by group' AS folds, 0::BIGINT AS leaking UNION ALL SELECT 'by row', count(*) FROM (SELECT entity FROM items GROUP BY entity HAVING count(DISTINCT item % 5) > 1)")
def l03(spark, d):
    """Groups that stand in several folds: none where folds are dealt by group, many where they are dealt by row."""
    t = items(spark, d).select("item", "entity")
    f = t.join(group_folds(t, "entity", 5, 7), "entity").select(F.lit("by group").alias("folds"), "entity", F.col("fold").cast("long").alias("fold"))
    f = f.unionByName(t.select(F.lit("by row").alias("folds"), "entity", (F.col("item") % 5).alias("fold")))
    return f.groupBy("folds", "entity").agg(F.count_distinct("fold").alias("n")).groupBy("folds").agg(F.count_if(F.col("n") > 1).alias("leaking"))


@query("l01_pca_composite")
def l01(spark, d):
    """First principal component of three standardised rates, its sign fixed by the first loading."""
    return models.pca_composite(daily(spark, d).where("views > 0"))


@query("l06_kmeans_profile")
def l06(spark, d):
    """Clusters of the vectors, their number by silhouette, with mean quality, its interval and a profile."""
    return models.kmeans_profile(items(spark, d), "item", "vec", "quality", ["age", "gender"])


@query("l07_ridge_probe")
def l07(spark, d):
    """Entity-disjoint ridge regression of the attribute on the vector, beside the training mean."""
    t = items(spark, d).where("age is not null")
    return models.ridge_probe(t.join(group_folds(t, "entity", 5, 7), "entity"), "vec", "age", "fold")


@query("l09_overlap_weights")
def l09(spark, d):
    """Cross-fitted propensities and overlap weights, normalised within arms."""
    t = items(spark, d)
    return models.overlap_weights(t.join(group_folds(t, "entity", 3, 7), "entity").select("item", "gender", "quality", "fold", F.col("vec")[0].alias("x0")), "gender", ["quality", "x0"])


@query("l10_bayesian_head")
def l10(spark, d):
    """Posterior mean of a linear head: precision and moment sums are plain aggregates."""
    return models.bayesian_head(items(spark, d).select("label", F.slice("vec", 1, 4).alias("x"), "quality"), "label", "x", "quality", 4)


@query("x16_bradley_terry")
def x16(spark, d):
    """Strengths of labels from pairwise wins by the minorise-maximise fixed point."""
    p = pairs(spark, d, extra=("label", "quality")).where("label_a <> label_b and quality_a <> quality_b")
    win = F.when(F.col("quality_a") > F.col("quality_b"), F.struct(F.col("label_a").alias("w"), F.col("label_b").alias("l"))).otherwise(F.struct(F.col("label_b").alias("w"), F.col("label_a").alias("l")))
    return models.bradley_terry(p.select(win.alias("g")).select("g.*"))
