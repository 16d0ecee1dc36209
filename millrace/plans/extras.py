"""The remaining operators: representation comparison, grids, probes, matching, policies and text rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import crossfit, models, probes
from millrace.operators.matching import greedy_matching, nearest_matching
from millrace.operators.running import running_sums
from millrace.operators.sampling import group_folds, hash_key
from millrace.plans.registry import query
from millrace.plans.tables import items, pairs, read
from millrace.sources import files

count = lambda name="n": F.count(F.lit(1)).alias(name)
rnd = lambda c, n=6: F.round(c, n)


@query("a07_file_names", "SELECT name, true AS is_parquet FROM (VALUES ('nation'), ('part'), ('region')) t(name)")
def a07(spark, d):
    """Facts that are stated in file names only."""
    f = spark.read.format("binaryFile").load([f"{d}/{t}.parquet" for t in ("region", "nation", "part")]).select("path")
    name = F.regexp_extract("path", r"/([a-z]+)\.[a-z]+$", 1)
    return f.select(name.alias("name"), (F.regexp_extract("path", r"\.([a-z]+)$", 1) == "parquet").alias("is_parquet"))


@query("p12_column_blocks", "SELECT item, quality, gender FROM items")
def p12(spark, d):
    """Named blocks of columns; of each, those that exist."""
    t = items(spark, d)
    blocks = {"id": ["item"], "quality": ["quality", "blur"], "attributes": ["gender", "height"]}
    return t.select(*[c for cols in blocks.values() for c in cols if c in t.columns])


@query("s06_bracketed_numbers", """
WITH c AS (SELECT item, CASE item % 3 WHEN 0 THEN [age, (age + 4)] WHEN 2 THEN [age] ELSE [] END AS ages FROM items WHERE age BETWEEN 10 AND 60)
SELECT item, list_distinct(ages)::INTEGER[] AS ages FROM (SELECT item, ages FROM c WHERE len(ages) < 2) UNION ALL SELECT item, ages::INTEGER[] FROM c WHERE len(ages) = 2""")
def s06(spark, d):
    """Last resort among the number rules: years and durations go, then numbers count if a connector or a bracket is there."""
    age = F.col("age").cast("string")
    other = (F.col("age") + 4).cast("string")
    forms = F.element_at(F.array(F.concat(F.lit("at "), age, F.lit(" and "), other, F.lit(" in 1999")), F.concat(F.lit("only "), age), F.concat(F.lit("me ("), age, F.lit(") 2004, 5 years ago"))), (F.col("item") % 3 + 1).cast("int"))
    return items(spark, d).where("age between 10 and 60").select("item", T.bracketed_numbers(forms).alias("ages"))


@query("s10_balanced_object", "SELECT item, CASE item % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'collage' ELSE 'unknown' END AS category, least(1.0::DOUBLE, round(quality + 0.3, 6)) AS confidence FROM items")
def s10(spark, d):
    """The first balanced JSON object of a reply; unknown categories are masked, confidence is clamped."""
    cat = F.element_at(F.array(F.lit("single"), F.lit("collage"), F.lit("cake")), (F.col("item") % 3 + 1).cast("int"))
    conf = rnd(F.col("quality") + 0.3).cast("string")
    reply = F.concat(F.lit("Well { then: {\"category\": \""), cat, F.lit("\", \"confidence\": "), conf, F.lit(", \"reason\": \"a } b\", \"x\": {\"y\": 1}} and } more }"))
    j = F.from_json(T.balanced_object(reply), "category string, confidence double")
    ok = j["category"].isin("single", "multi_person", "collage", "meme")
    return items(spark, d).select("item", F.when(ok, j["category"]).otherwise("unknown").alias("category"), rnd(F.greatest(F.lit(0.0), F.least(F.lit(1.0), j["confidence"]))).alias("confidence"))


@query("s14_mean_pool", "SELECT entity, round(avg(vec[1]), 6) AS first, round(avg(vec[2]), 6) AS second FROM items GROUP BY entity")
def s14(spark, d):
    """A record's vector is the mean of its chunks' vectors."""
    from millrace.functions.vectors import centroid

    c = centroid(items(spark, d).select("entity", F.slice("vec", 1, 2).alias("vec")), "vec", 2, "entity")
    return c.select("entity", rnd(F.col("centroid")[0]).alias("first"), rnd(F.col("centroid")[1]).alias("second"))


@query("k07_disjoint_pairs")
def k07(spark, d):
    """Positive pairs in hash order, no item in two of them."""
    p = pairs(spark, d).where("y = 1").select("item_a", "item_b", F.md5(F.concat_ws("|", F.lit("17"), F.col("item_a").cast("string"), F.col("item_b").cast("string"))).alias("h"))
    return greedy_matching(p, "item_a", "item_b", ["h"])


@query("k10_bucket_quota", """
WITH b AS (SELECT item_a, item_b, age_a // 10 AS bucket, md5('19|' || item_a::VARCHAR || '_' || item_b::VARCHAR) AS h FROM pairs WHERE y = 0 AND age_a IS NOT NULL AND age_a // 10 = age_b // 10),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, item_a, item_b) AS r, count(*) OVER (PARTITION BY bucket) AS n FROM b)
SELECT bucket, item_a, item_b FROM r WHERE r <= ceil(n * 0.25::DOUBLE)""")
def k10(spark, d):
    """A quarter of each bucket's negatives in hash order; places in the order come from two-level counts."""
    p = pairs(spark, d).where("y = 0 and age_a is not null and age_a div 10 = age_b div 10").select(F.expr("age_a div 10").alias("bucket"), "item_a", "item_b", F.concat_ws("_", F.col("item_a").cast("string"), F.col("item_b").cast("string")).alias("k"))
    p = p.withColumn("h", hash_key("k", 19)).withColumn("o", F.struct("h", "item_a", "item_b")).withColumn("c", F.lit(1).cast("long"))
    r = running_sums(p, ["bucket"], "o", ["c"], F.substring("h", 1, 2))
    n = p.groupBy("bucket").agg(count("N"))
    return r.join(n, "bucket").where(F.col("below_c") + 1 <= F.ceil(F.col("N") * 0.25)).select("bucket", "item_a", "item_b")


@query("k13_exposure_policies", """
WITH s AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(event_type, (round(m, 6), event_type)) AS greedy, arg_min(event_type, (n, event_type)) AS uncertain, arg_max(event_type, (round(m + 40 / sqrt(n), 6), event_type)) AS optimistic FROM s GROUP BY user_id""")
def k13(spark, d):
    """The arm that each exposure policy shows a user: the best mean, the least seen, the best upper bound."""
    s = read(spark, d, "events").groupBy("user_id", "event_type").agg(count(), F.avg("value").alias("m"))
    e = F.col("event_type")
    return s.groupBy("user_id").agg(F.max_by(e, F.struct(rnd(F.col("m")), e)).alias("greedy"), F.min_by(e, F.struct("n", e)).alias("uncertain"), F.max_by(e, F.struct(rnd(F.col("m") + 40 / F.sqrt("n")), e)).alias("optimistic"))


def _targets(spark, d):
    t = items(spark, d).where("age is not null").select("item", F.col("age").alias("value"), "entity", "split")
    return t.where("item % 50 = 0").withColumnRenamed("item", "query"), t


@query("x11_nearest_match")
def x11(spark, d):
    """Targets get partners of the nearest attribute, each partner once; ties in hash order."""
    return nearest_matching(*_targets(spark, d), 2, ["split"], "entity", 23)


@query("x17_match_coverage")
def x17(spark, d):
    """How many targets have candidates, and how many get a partner."""
    q, t = _targets(spark, d)
    got = nearest_matching(q, t, 2, ["split"], "entity", 23)
    there = t.groupBy("value", "split").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"))  # another entity is there if not both are the target's
    near = q.withColumn("value", F.explode(F.sequence(F.col("value") - 2, F.col("value") + 2))).join(there, ["value", "split"]).where("lo <> entity or hi <> entity")
    return q.select("query").join(near.select("query").distinct().withColumn("c", F.lit(1)), "query", "left").join(got.select("query", F.lit(1).alias("g")), "query", "left").agg(count("targets"), F.count("c").alias("with_candidates"), F.count("g").alias("matched"))


@query("v10_fixed_grid_accuracy", """
WITH f AS (SELECT item_a % 10 AS fold, score, y FROM pairs), g AS (SELECT i AS g FROM range(0, 2001) r(i)),
h AS (SELECT fold, least(2000, greatest(0, floor(round((score + 1) / 0.001, 6))))::BIGINT AS cell, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM f GROUP BY 1, 2),
a AS (SELECT h.fold, g.g, sum(CASE WHEN h.cell >= g.g THEN p ELSE n END) AS ok, sum(p + n) AS total FROM h, g GROUP BY 1, 2),
b AS (SELECT fold, g, ok, total, (sum(ok) OVER (PARTITION BY g) - ok)::DOUBLE / (sum(total) OVER (PARTITION BY g) - total) AS train FROM a),
c AS (SELECT fold, arg_max(ok::DOUBLE / total, (round(train, 9), -g)) AS test FROM b GROUP BY fold)
SELECT round(avg(test), 6) AS accuracy, round(stddev_samp(test), 6) AS sd FROM c""")
def v10(spark, d):
    """Each fold at the best threshold of a fixed fine grid on the other folds, by histogram and running sums."""
    cell = F.least(F.lit(2000), F.greatest(F.lit(0), F.floor(F.round((F.col("score") + 1) / 0.001, 6))))
    h = pairs(spark, d).groupBy((F.col("item_a") % 10).alias("fold"), cell.alias("g")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    folds = h.groupBy("fold").agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    grid = folds.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(2000)).cast("array<bigint>"))).join(h, ["fold", "g"], "left").na.fill(0, ["p", "n"])
    below = Window.partitionBy("fold").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # 2,001 rows for each fold
    ok = F.col("all_p") - F.coalesce(F.sum("p").over(below), F.lit(0)) + F.coalesce(F.sum("n").over(below), F.lit(0))
    a = grid.select("fold", "g", ok.alias("ok"), (F.col("all_p") + F.col("all_n")).alias("total"))
    w = Window.partitionBy("g")
    a = a.withColumn("train", (F.sum("ok").over(w) - F.col("ok")) / (F.sum("total").over(w) - F.col("total")))
    best = a.groupBy("fold").agg(F.max_by(F.col("ok") / F.col("total"), F.struct(F.round("train", 9), -F.col("g"))).alias("test"))
    return best.agg(rnd(F.avg("test")).alias("accuracy"), rnd(F.stddev_samp("test")).alias("sd"))


@query("v23_kernel_discrepancy")
def v23(spark, d):
    """Kernel discrepancy of two groups' vectors by random Fourier features: two mean vectors instead of all pairs."""
    return probes.kernel_discrepancy(items(spark, d).select("gender", "vec"), "gender", "vec", 64)


@query("v34_version_discrepancy")
def v34(spark, d):
    """The same between versions, here the splits, each against the training one."""
    return probes.kernel_discrepancy(items(spark, d).select("split", "vec"), "split", "vec", 64)


def cka_sql() -> str:
    c = lambda a, b: " + ".join(f"power(covar_pop(vec[{i}], vec[{j}]), 2)" for i in a for j in b)
    x, y = range(1, 5), range(5, 9)
    return f"({c(x, y)}) / sqrt(({c(x, x)}) * ({c(y, y)}))"


@query("v26_linear_cka", f"SELECT round({cka_sql()}, 6) AS cka FROM items")
def v26(spark, d):
    """Linear centred kernel alignment of two representations, from covariances alone."""
    return items(spark, d).agg(rnd(probes.linear_cka([F.col("vec")[i] for i in range(4)], [F.col("vec")[i] for i in range(4, 8)])).alias("cka"))


@query("v36_representation_bundle", f"""
SELECT (SELECT round({cka_sql()}, 6) FROM items) AS cka, (SELECT round(avg(1 - score), 6) FROM pairs) AS drift, (SELECT round(avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0), 6) FROM pairs) AS separability""")
def v36(spark, d):
    """Alignment, cosine drift and separability in one row."""
    of = lambda k: F.avg(F.when(F.col("y") == k, F.col("score")))
    p = pairs(spark, d).agg(rnd(F.avg(1 - F.col("score"))).alias("drift"), rnd(of(1) - of(0)).alias("separability"))
    return v26(spark, d).crossJoin(F.broadcast(p))  # one row each


@query("g34_common_metrics", """
WITH s AS (SELECT item % 3 AS seed, avg(quality) AS quality, avg(age) AS age, CASE WHEN item % 3 = 2 THEN NULL ELSE avg(gender) END AS gender FROM items GROUP BY item % 3),
l AS (SELECT 'quality' AS metric, quality AS v FROM s UNION ALL SELECT 'age', age FROM s UNION ALL SELECT 'gender', gender FROM s)
SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(max(v) - min(v), 6) AS width FROM l WHERE v IS NOT NULL GROUP BY metric HAVING count(*) = 3""")
def g34(spark, d):
    """Summary over checkpoints of the metrics that all of them have."""
    seed = F.col("item") % 3
    s = items(spark, d).groupBy(seed.alias("seed")).agg(F.avg("quality").alias("quality"), F.avg("age").alias("age"), F.avg("gender").alias("g"))
    s = s.select("seed", "quality", "age", F.when(F.col("seed") != 2, F.col("g")).alias("gender"))
    return s.unpivot(["seed"], ["quality", "age", "gender"], "metric", "v").where("v is not null").groupBy("metric").agg(rnd(F.avg("v")).alias("mean"), rnd(F.stddev_samp("v")).alias("sd"), rnd(F.max("v") - F.min("v")).alias("width"), count()).where("n = 3").drop("n")


@query("g38_pooled_readout")
def g38(spark, d):
    """Mean vectors of records, then a ridge readout of the record's quality."""
    from millrace.functions.vectors import centroid

    t = items(spark, d)
    c = centroid(t.select("grp", "entity", F.slice("vec", 1, 16).alias("vec")), "vec", 16, "grp", "entity").select("grp", "entity", F.col("centroid").alias("vec"))
    c = c.join(t.groupBy("grp").agg(F.avg("quality").alias("quality")), "grp")
    return models.ridge_probe(c.join(group_folds(t, "entity", 3, 7), "entity"), "vec", "quality", "fold")


@query("m11_normal_tail")
def m11(spark, d):
    """Two-sided normal tail of standardised scores."""
    z = (F.col("quality") - 0.745) / 0.144
    return items(spark, d).select("item", probes.normal_tail(z).alias("p"))


@query("l02_crossfit_residual")
def l02(spark, d):
    """Out-of-fold residuals of boosted trees; every row is predicted by a model that did not see its entity."""
    t = items(spark, d).where("age is not null")
    x = t.join(group_folds(t, "entity", 3, 7), "entity").select("item", "age", "fold", "quality", *[F.col("vec")[i].alias(f"x{i}") for i in range(3)])
    return probes.crossfit_residual(x, "age", ["quality", "x0", "x1", "x2"], "fold")


@query("l04_block_ablation")
def l04(spark, d):
    """The ridge probe on growing blocks of the vector."""
    t = items(spark, d).where("age is not null")
    t = t.join(group_folds(t, "entity", 3, 7), "entity")
    out = None
    for n in (4, 16, 64):
        part = models.ridge_probe(t.withColumn("vec", F.slice("vec", 1, n)), "vec", "age", "fold").withColumn("dims", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


@query("l05_permutation_importance")
def l05(spark, d):
    """Spearman lost on the held-out fold when a column is shuffled."""
    t = items(spark, d).where("age is not null")
    x = t.join(group_folds(t, "entity", 5, 7), "entity").select("item", "age", "fold", "quality", "gender", *[F.col("vec")[i].alias(f"x{i}") for i in range(3)])
    return crossfit.permutation_importance(x, "item", "age", ["quality", "gender", "x0", "x1", "x2"], "fold")


@query("l17_nested_ridge")
def l17(spark, d):
    """Out-of-fold predictions: a line in the prior and a ridge on the vectors for the rest, tuned on inner folds of entities."""
    t = items(spark, d).where("age is not null").withColumn("prior", F.col("item") % 7 + 10 * F.col("quality"))
    return crossfit.nested_ridge(t, "item", "vec", "quality", "prior", "entity")


@query("l08_linear_probe")
def l08(spark, d):
    """Balanced accuracy of a linear probe of an attribute on the held-out splits."""
    t = items(spark, d).select("split", "gender", F.slice("vec", 1, 16).alias("vec"))
    return probes.balanced_probe(t, "vec", "gender", F.col("split") == "train")


@query("l12_difference_ranker")
def l12(spark, d):
    """Ridge on differences within an entity, each with its mirror image."""
    t = items(spark, d).select("entity", "item", "quality", F.slice("vec", 1, 8).alias("vec"))
    j = t.toDF("entity", "a", "qa", "va").join(t.toDF("entity", "b", "qb", "vb"), "entity").where("a < b")  # an entity has six items at most
    diff = lambda p, q: F.zip_with(p, q, lambda x, y: x - y)
    one = j.select("entity", diff("va", "vb").alias("vec"), (F.col("qa") - F.col("qb")).alias("dq"))
    both = one.unionByName(j.select("entity", diff("vb", "va").alias("vec"), (F.col("qb") - F.col("qa")).alias("dq")))
    return models.ridge_probe(both.join(group_folds(t, "entity", 3, 7), "entity"), "vec", "dq", "fold")


@query("n06_inputs_unchanged", "SELECT 2::BIGINT AS files, 0::BIGINT AS changed")
def n06(spark, d):
    """Digests of the inputs before and after a run."""
    paths = [f"{d}/{t}.parquet" for t in ("region", "nation")]
    a, b = (files.digests(spark, paths).select("file", F.col("sha256").alias(c)) for c in ("before", "after"))
    return a.join(b, "file", "full").agg(count("files"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))


@query("n14_alias_conflicts", "SELECT n_chars, count(*) AS rows, count(DISTINCT sha256(text)) AS contents FROM documents GROUP BY n_chars HAVING count(DISTINCT sha256(text)) > 1")
def n14(spark, d):
    """Keys under which different contents are stored."""
    t = read(spark, d, "documents").select("n_chars", F.sha2("text", 256).alias("h"))
    return t.groupBy("n_chars").agg(count("rows"), F.count_distinct("h").alias("contents")).where("contents > 1")
