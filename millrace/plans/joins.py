"""J: join shapes; U: set operations; X: graph operators; N, E: validators and governance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.vectors import centroid, dot
from millrace.operators.graph import component_labels
from millrace.operators.governance import hmac_sha256
from millrace.operators.similarity import band_join, search
from millrace.plans.registry import query
from millrace.plans.tables import items, pairs, read

count = lambda name="n": F.count(F.lit(1)).alias(name)
rnd = lambda c, n=6: F.round(c, n)


@query("j01_explode_members", "SELECT conv_id, turn, role, length(text) AS len FROM conversations")
def j01(spark, d):
    """Records nest their members in order; one row for each member."""
    posts = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("members"))
    return posts.select("conv_id", F.explode("members").alias("m")).select("conv_id", "m.turn", "m.role", F.char_length("m.text").cast("long").alias("len"))


@query("j02_star_join", """
SELECT o_orderkey, l_linenumber, c_mktsegment, n_name, p_brand, round(l_extendedprice * (1 - l_discount), 4) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey
WHERE o_orderpriority = '1-URGENT'""")
def j02(spark, d):
    li, o, c, n, p = (read(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "part"))
    out = li.join(o.where("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return out.select("o_orderkey", "l_linenumber", "c_mktsegment", "n_name", "p_brand", rnd(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"))


@query("j03_default_to_own_key", """
WITH m AS (SELECT DISTINCT grp, entity FROM items WHERE grp % 3 <> 0) SELECT i.item, coalesce(m.entity, i.grp) AS person FROM items i LEFT JOIN m USING (grp)""")
def j03(spark, d):
    t = items(spark, d)
    m = t.where("grp % 3 <> 0").select("grp", "entity").distinct()
    return t.select("item", "grp").join(m, "grp", "left").select("item", F.coalesce("entity", "grp").alias("person"))


@query("j04_two_sided_lookup", """
WITH p AS (SELECT item AS a, item + 4 AS b FROM items),
j AS (SELECT a, b, x.vec AS va, y.vec AS vb FROM p JOIN (SELECT * FROM items WHERE usable) x ON p.a = x.item JOIN (SELECT * FROM items WHERE usable) y ON p.b = y.item)
SELECT (SELECT count(*) FROM p) - count(*) AS skipped, count(*) AS joined, round(avg(list_dot_product(va, vb)), 6) AS mean_cosine FROM j""")
def j04(spark, d):
    """Pairs whose both vectors exist, and how many are skipped."""
    t = items(spark, d)
    p = t.select(F.col("item").alias("a"), (F.col("item") + 4).alias("b"))
    ok = t.where("usable").select("item", "vec")
    j = p.join(ok.select(F.col("item").alias("a"), F.col("vec").alias("va")), "a", "left").join(ok.select(F.col("item").alias("b"), F.col("vec").alias("vb")), "b", "left")
    both = F.col("va").isNotNull() & F.col("vb").isNotNull()
    return j.agg(F.count_if(~both).alias("skipped"), F.count_if(both).alias("joined"), rnd(F.avg(F.when(both, dot(F.col("va"), F.col("vb"))))).alias("mean_cosine"))


@query("j05_semi_join", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j05(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang", "source").join(read(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("j06_anti_join", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j06(spark, d):
    return read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j07_unordered_anti", """
SELECT least(item_a, item_b) AS lo, greatest(item_a, item_b) AS hi FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.y = 1 AND least(q.item_a, q.item_b) = least(p.item_a, p.item_b) AND greatest(q.item_a, q.item_b) = greatest(p.item_a, p.item_b))""")
def j07(spark, d):
    p = pairs(spark, d).select(F.least("item_a", "item_b").alias("lo"), F.greatest("item_a", "item_b").alias("hi"), "y")
    return p.select("lo", "hi").join(p.where("y = 1").select("lo", "hi"), ["lo", "hi"], "left_anti")


@query("j08_exclude_endpoints", "SELECT item_a, item_b FROM pairs WHERE item_a % 13 <> 0 AND item_b % 13 <> 0")
def j08(spark, d):
    bad = items(spark, d).where("not usable").select("item")
    p = pairs(spark, d).select("item_a", "item_b")
    return p.join(bad, F.col("item_a") == F.col("item"), "left_anti").join(bad, F.col("item_b") == F.col("item"), "left_anti")


@query("j09_within_group_pairs", "SELECT a.grp, a.item AS item_a, b.item AS item_b, abs(a.age - b.age) AS gap FROM items a JOIN items b ON a.grp = b.grp AND a.item < b.item")
def j09(spark, d):
    """Groups have three members at most."""
    t = items(spark, d).select("grp", "item", "age")
    a, b = t.toDF("grp", "item_a", "age_a"), t.toDF("grp", "item_b", "age_b")
    return a.join(b, "grp").where("item_a < item_b").select("grp", "item_a", "item_b", F.abs(F.col("age_a") - F.col("age_b")).alias("gap"))


SIM_SQL = "SELECT q.item AS query, g.item AS item, q.grp AS qg, g.grp AS gg, q.entity AS qe, g.entity AS ge, q.split AS qs, g.split AS gs, round(list_dot_product(q.vec, g.vec), 9) AS sim FROM items q, items g WHERE q.item % 50 = 0 AND q.item <> g.item"


def _similar(spark, d, k, least=None):
    t = items(spark, d)
    got = search(t.where("item % 50 = 0"), t, k=k, least=least)
    meta = t.select("item", "grp", "entity", "split")
    q = meta.toDF("query", "qg", "qe", "qs")
    return got.join(q, "query").join(meta.toDF("item", "gg", "ge", "gs"), "item")


@query("j10_similarity_threshold", f"WITH s AS ({SIM_SQL}) SELECT query, item, sim FROM s WHERE sim >= 0.25 AND qg <> gg")
def j10(spark, d):
    """Rows of other groups at least so similar to a query; every row whose id is divisible by 50 is a query."""
    return _similar(spark, d, None, 0.25).where("qg <> gg").select("query", "item", "sim")


@query("j11_similarity_within_group", "SELECT a.item AS item_a, b.item AS item_b, round(list_dot_product(a.vec, b.vec), 9) AS sim FROM items a JOIN items b ON a.grp = b.grp AND a.item < b.item WHERE round(list_dot_product(a.vec, b.vec), 9) >= 0.05")
def j11(spark, d):
    t = items(spark, d).select("grp", "item", "vec")
    j = t.toDF("grp", "item_a", "va").join(t.toDF("grp", "item_b", "vb"), "grp").where("item_a < item_b")
    return j.select("item_a", "item_b", rnd(dot(F.col("va"), F.col("vb")), 9).alias("sim")).where("sim >= 0.05")


@query("j12_hard_negatives", f"WITH s AS ({SIM_SQL}) SELECT query, item, sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item)::INTEGER AS rank FROM s WHERE qg <> gg AND sim >= 0.1 AND sim < 0.4 QUALIFY rank <= 5")
def j12(spark, d):
    """The five most similar rows of other groups inside a band of similarity."""
    t = items(spark, d)
    return search(t.where("item % 50 = 0"), t, 5, least=0.1, below=0.4, differ=("grp",))


@query("j13_cross_split_centroids", """
WITH c AS (SELECT grp, any_value(split) AS split, any_value(entity) AS entity, [avg(vec[1]), avg(vec[2]), avg(vec[3]), avg(vec[4])] AS c FROM items GROUP BY grp),
s AS (SELECT q.grp AS query, g.grp AS grp, round(list_dot_product(q.c, g.c), 9) AS sim FROM c q, c g WHERE q.grp % 50 = 0 AND q.split <> g.split AND q.entity <> g.entity)
SELECT query, grp, sim FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, grp) <= 3""")
def j13(spark, d):
    """The nearest centroids in another split and of another entity; centroids over the first four dimensions."""
    t = items(spark, d)
    c = centroid(t.select("grp", "split", "entity", F.slice("vec", 1, 4).alias("vec")), "vec", 4, "grp", "split", "entity").drop("n")
    return search(c.where("grp % 50 = 0"), c, 3, key="grp", vec="centroid", differ=("split", "entity")).select("query", F.col("item").alias("grp"), "sim")


@query("j15_topk_or_threshold", f"""
WITH s AS ({SIM_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS rank FROM s)
SELECT query, item, sim, CASE WHEN rank <= 3 AND sim >= 0.3 THEN 'both' WHEN rank <= 3 THEN 'top_k' ELSE 'cosine_threshold' END AS source FROM r WHERE rank <= 3 OR sim >= 0.3""")
def j15(spark, d):
    t = items(spark, d)
    q = t.where("item % 50 = 0")
    both = search(q, t, 3).select("query", "item", "sim", F.lit("top_k").alias("source")).unionByName(search(q, t, None, least=0.3).select("query", "item", "sim", F.lit("cosine_threshold").alias("source")))
    src = F.when(F.count(F.lit(1)) == 2, "both").otherwise(F.min("source"))
    return both.groupBy("query", "item", "sim").agg(src.alias("source"))


@query("j16_band_join", """
SELECT q.item AS query, g.item AS item FROM items q JOIN items g ON abs(q.age - g.age) <= 2 AND q.entity <> g.entity AND q.split = g.split WHERE q.item % 50 = 0""")
def j16(spark, d):
    t = items(spark, d).where("age is not null")
    q = t.where("item % 50 = 0").select(F.col("item").alias("query"), F.col("age").alias("qa"), F.col("entity").alias("qe"), F.col("split").alias("qs"))
    g = t.select("item", "age", "entity", "split")
    return band_join(q, g, "qa", "age", 2).where("qe <> entity and qs = split").select("query", "item")


@query("j17_exact_attribute_join", """
SELECT q.item AS query, g.item AS item FROM items q JOIN items g ON q.age = g.age AND q.entity <> g.entity WHERE q.item % 50 = 0 AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.item_a = q.item AND p.item_b = g.item)""")
def j17(spark, d):
    t = items(spark, d).where("age is not null").select("item", "age", "entity")
    j = t.where("item % 50 = 0").toDF("query", "age", "qe").join(t, "age").where("qe <> entity").select("query", "item")
    used = pairs(spark, d).select(F.col("item_a").alias("query"), F.col("item_b").alias("item"))
    return j.join(used, ["query", "item"], "left_anti")


HASH_SQL = "SELECT item, list_sum([CASE WHEN vec[i + 1] > 0 THEN (1::BIGINT << i) ELSE 0 END FOR i IN range(0, 32)])::BIGINT AS h FROM items"


@query("j18_hamming_join", f"""
WITH h AS ({HASH_SQL}) SELECT q.item AS query, g.item AS item, bit_count(xor(q.h, g.h))::INTEGER AS distance FROM h q JOIN h g ON q.item <> g.item WHERE q.item % 50 = 0 AND bit_count(xor(q.h, g.h)) <= 3""")
def j18(spark, d):
    """Sign hashes at a Hamming distance of at most three: of four blocks of eight bits one is equal."""
    h = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(F.get(F.col("vec"), i) > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s + v)
    t = items(spark, d).select("item", h.alias("h"))
    block = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright("h", 8 * k).bitwiseAND(F.lit(255)).alias("b")) for k in range(4)]))
    q = t.where("item % 50 = 0").select(F.col("item").alias("query"), F.col("h").alias("hq"), block.alias("x"))
    j = q.join(t.select("item", "h", block.alias("x")), "x").where("query <> item").select("query", "item", "hq", "h").distinct()
    return j.select("query", "item", F.bit_count(F.col("hq").bitwiseXOR(F.col("h"))).alias("distance")).where("distance <= 3")


@query("j19_content_hash_join", """
WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), m AS (SELECT h, min(doc_id) AS first, count(*) AS n FROM h GROUP BY h)
SELECT doc_id, first, n FROM h JOIN m USING (h) WHERE n > 1""")
def j19(spark, d):
    """Documents with equal contents, with their class: no pairs of copies."""
    h = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    m = h.groupBy("h").agg(F.min("doc_id").alias("first"), count()).where("n > 1")
    return h.join(m, "h").select("doc_id", "first", "n")


@query("j20_ambiguous_lookup", """
WITH m AS (SELECT age AS key, count(DISTINCT entity) AS persons, count(*) AS aliases, min(entity) AS person FROM items WHERE age IS NOT NULL GROUP BY 1)
SELECT i.item, CASE WHEN m.persons = 1 THEN m.person END AS person, CASE WHEN m.key IS NULL THEN 'unmatched' WHEN m.persons > 1 THEN 'ambiguous' ELSE 'matched' END AS status, coalesce(m.aliases, 0) AS aliases
FROM items i LEFT JOIN m ON i.item % 100 + 1 = m.key""")
def j20(spark, d):
    t = items(spark, d)
    m = t.where("age is not null").groupBy(F.col("age").alias("key")).agg(F.count_distinct("entity").alias("persons"), count("aliases"), F.min("entity").alias("person"))
    status = F.when(F.col("key").isNull(), "unmatched").when(F.col("persons") > 1, "ambiguous").otherwise("matched")
    return t.select("item", (F.col("item") % 100 + 1).alias("want")).join(m, F.col("want") == F.col("key"), "left").select("item", F.when(F.col("persons") == 1, F.col("person")).alias("person"), status.alias("status"), F.coalesce("aliases", F.lit(0)).alias("aliases"))


@query("j21_block_join_invariants", """
WITH p AS (SELECT item_a, item_b, age_b, row_number() OVER (PARTITION BY item_a ORDER BY item_b) AS r FROM pairs WHERE y = 1),
n AS (SELECT item_a, item_b, age_b, row_number() OVER (PARTITION BY item_a ORDER BY item_b) AS r FROM pairs WHERE y = 0)
SELECT count(*) AS blocks, count(*) FILTER (abs(p.age_b - n.age_b) > 5) AS age_violations, count(*) FILTER (p.item_b = n.item_b) AS same_item FROM p JOIN n ON p.item_a = n.item_a AND p.r = n.r""")
def j21(spark, d):
    """One-to-one blocks of a positive and its negative with the same anchor, and how many break a tolerance."""
    w = Window.partitionBy("item_a").orderBy("item_b")
    t = pairs(spark, d).select("item_a", "item_b", "age_b", "y")
    p = t.where("y = 1").withColumn("r", F.row_number().over(w)).select("item_a", "r", F.col("item_b").alias("pb"), F.col("age_b").alias("pa"))
    n = t.where("y = 0").withColumn("r", F.row_number().over(w)).select("item_a", "r", F.col("item_b").alias("nb"), F.col("age_b").alias("na"))
    return p.join(n, ["item_a", "r"]).agg(count("blocks"), F.count_if(F.abs(F.col("pa") - F.col("na")) > 5).alias("age_violations"), F.count_if(F.col("pb") == F.col("nb")).alias("same_item"))


@query("j22_best_match_argmax", """
SELECT item_a, arg_max(item_b, (score, -item_b)) AS best, max(score) AS score FROM pairs GROUP BY item_a""")
def j22(spark, d):
    return pairs(spark, d).groupBy("item_a").agg(F.max_by("item_b", F.struct("score", -F.col("item_b"))).alias("best"), F.max("score").alias("score"))


@query("j23_positional_join", """
WITH m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations), l AS (SELECT DISTINCT conv_id, 'left' AS side, 0 AS pos FROM conversations UNION SELECT DISTINCT conv_id, 'right', 1 FROM conversations)
SELECT l.conv_id, l.side, m.turn FROM l LEFT JOIN m ON l.conv_id = m.conv_id AND l.pos = m.pos""")
def j23(spark, d):
    """Labels that refer to members by position."""
    members = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    sides = F.inline(F.array(F.struct(F.lit("left").alias("side"), F.get("turns", F.lit(0)).alias("turn")), F.struct(F.lit("right").alias("side"), F.get("turns", F.lit(1)).alias("turn"))))
    return members.select("conv_id", sides)


@query("j24_hash_exclusion", "SELECT doc_id FROM documents WHERE substr(sha256('task|' || doc_id::VARCHAR), 1, 10) NOT IN (SELECT substr(sha256('task|' || doc_id::VARCHAR), 1, 10) FROM labels)")
def j24(spark, d):
    task = F.substring(F.sha2(F.concat(F.lit("task|"), F.col("doc_id").cast("string")), 256), 1, 10).alias("task")
    return read(spark, d, "documents").select("doc_id", task).join(read(spark, d, "labels").select(task), "task", "left_anti").select("doc_id")


@query("j25_merge_aggregates", "SELECT e.event_id, e.user_id, a.n, round(a.v, 4) AS mean_value FROM events e JOIN (SELECT user_id, count(*) AS n, avg(value) AS v FROM events GROUP BY 1) a USING (user_id)")
def j25(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", "user_id").join(e.groupBy("user_id").agg(count(), rnd(F.avg("value"), 4).alias("mean_value")), "user_id").select("event_id", "user_id", "n", "mean_value")


@query("j26_best_item_per_record", "SELECT grp, arg_max(item, (quality, -item)) AS item, max(quality) AS quality FROM items WHERE usable AND age >= 20 GROUP BY grp")
def j26(spark, d):
    return items(spark, d).where("usable and age >= 20").groupBy("grp").agg(F.max_by("item", F.struct("quality", -F.col("item"))).alias("item"), F.max("quality").alias("quality"))


@query("j27_modelling_table", """
WITH t AS (SELECT grp, avg(quality) AS target FROM items GROUP BY grp), s AS (SELECT avg(target) AS m, stddev_pop(target) AS sd FROM t)
SELECT item, grp, round((target - m) / (sd + 1e-9), 6) AS target FROM items JOIN t USING (grp), s WHERE usable AND age >= 20""")
def j27(spark, d):
    """Usable adult items with their record's standardised target."""
    t = items(spark, d)
    g = t.groupBy("grp").agg(F.avg("quality").alias("t"))
    s = g.agg(F.avg("t").alias("m"), F.stddev_pop("t").alias("sd"))
    return t.where("usable and age >= 20").join(g.crossJoin(F.broadcast(s)), "grp").select("item", "grp", rnd((F.col("t") - F.col("m")) / (F.col("sd") + 1e-9)).alias("target"))  # one row


@query("u01_union_pairs", "SELECT 'positive' AS kind, item_a, item_b FROM pairs WHERE y = 1 UNION ALL SELECT 'hard', item_a, item_b FROM pairs WHERE y = 0 AND score >= 0.2 UNION ALL SELECT 'simple', item_a, item_b FROM pairs WHERE y = 0 AND score < -0.2")
def u01(spark, d):
    p = pairs(spark, d)
    part = lambda kind, cond: p.where(cond).select(F.lit(kind).alias("kind"), "item_a", "item_b")
    return part("positive", "y = 1").unionByName(part("hard", "y = 0 and score >= 0.2")).unionByName(part("simple", "y = 0 and score < -0.2"))


@query("u02_intersection", "SELECT item FROM items WHERE usable INTERSECT SELECT item FROM items WHERE age IS NOT NULL")
def u02(spark, d):
    t = items(spark, d)
    return t.where("usable").select("item").intersect(t.where("age is not null").select("item"))


@query("u03_difference", "SELECT item FROM items EXCEPT SELECT item FROM items WHERE usable")
def u03(spark, d):
    t = items(spark, d)
    return t.select("item").exceptAll(t.where("usable").select("item"))


@query("u04_coverage_check", """
WITH a AS (SELECT item FROM items WHERE item % 4 <> 0), b AS (SELECT item FROM items WHERE item % 6 <> 0)
SELECT count(*) FILTER (a.item IS NULL) AS missing, count(*) FILTER (b.item IS NULL) AS extra, count(*) FILTER (a.item = b.item) AS shared FROM a FULL JOIN b ON a.item = b.item""")
def u04(spark, d):
    t = items(spark, d)
    a, b = t.where("item % 4 <> 0").select(F.col("item").alias("a")), t.where("item % 6 <> 0").select(F.col("item").alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full").agg(F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("extra"), F.count_if(F.col("a") == F.col("b")).alias("shared"))


@query("u05_remove_shared_entities", """
WITH two AS (SELECT entity FROM items WHERE split = 'train' INTERSECT SELECT entity FROM items WHERE split = 'test')
SELECT item, entity, split FROM items WHERE split IN ('train', 'test') AND entity NOT IN (SELECT entity FROM two)""")
def u05(spark, d):
    t = items(spark, d).where("split in ('train', 'test')")
    both = t.groupBy("entity").agg(F.count_distinct("split").alias("n")).where("n > 1")
    return t.join(both, "entity", "left_anti").select("item", "entity", "split")


@query("u06_multiset_equality", """
WITH t AS (SELECT doc_id, lang, source FROM documents),
c AS (SELECT 'same rows in another order' AS pair, lang, source, 1 AS s FROM t UNION ALL SELECT 'same rows in another order', lang, source, -1 FROM t
  UNION ALL SELECT 'even and odd ids', lang, source, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END FROM t)
SELECT pair, count(*) FILTER (s <> 0) = 0 AS equal, count(*) FILTER (s <> 0) AS unequal_keys FROM (SELECT pair, lang, source, sum(s) AS s FROM c GROUP BY ALL) GROUP BY pair""")
def u06(spark, d):
    """Whether two tables have the same rows as often: signed counts all cancel; for tables that have and for tables that have not."""
    t = read(spark, d, "documents").select("doc_id", "lang", "source")
    same = t.withColumn("s", F.lit(1)).unionByName(t.orderBy(F.desc("doc_id")).withColumn("s", F.lit(-1))).withColumn("pair", F.lit("same rows in another order"))
    halves = t.withColumn("s", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(-1)).withColumn("pair", F.lit("even and odd ids"))
    s = same.unionByName(halves).groupBy("pair", "lang", "source").agg(F.sum("s").alias("s"))
    unequal = F.count_if(F.col("s") != 0)
    return s.groupBy("pair").agg((unequal == 0).alias("equal"), unequal.alias("unequal_keys"))


@query("u07_arm_overlap", "SELECT a.split AS left_split, b.split AS right_split, count(*) AS shared FROM (SELECT DISTINCT entity, split FROM items) a JOIN (SELECT DISTINCT entity, split FROM items) b ON a.entity = b.entity AND a.split < b.split GROUP BY 1, 2")
def u07(spark, d):
    e = items(spark, d).select("entity", "split").distinct()
    return e.toDF("entity", "left_split").join(e.toDF("entity", "right_split"), "entity").where("left_split < right_split").groupBy("left_split", "right_split").agg(count("shared"))


@query("u08_split_stamping", "SELECT CASE WHEN split_a = split_b THEN split_a END AS split, count(*) AS n FROM pairs GROUP BY 1")
def u08(spark, d):
    return pairs(spark, d).groupBy(F.when(F.col("split_a") == F.col("split_b"), F.col("split_a")).alias("split")).agg(count())


COMPONENTS_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT least(grp_a, grp_b) AS u, greatest(grp_a, grp_b) AS v FROM pairs WHERE score >= {t} AND grp_a <> grp_b),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(node, label) AS (SELECT DISTINCT u, u FROM b UNION SELECT b.v, r.label FROM r JOIN b ON r.node = b.u)
SELECT node, min(label) AS root FROM r GROUP BY node"""
SWEEP_SQL = " UNION ALL ".join(f"SELECT {t} AS threshold, (SELECT count(DISTINCT grp) FROM items) - (SELECT count(*) FROM ({COMPONENTS_SQL.strip().replace('{t}', str(t))}) WHERE node <> root) AS components" for t in ("0.15::DOUBLE", "0.2::DOUBLE", "0.3::DOUBLE"))




@query("x01_components", COMPONENTS_SQL.replace("{t}", "0.2"))
def x01(spark, d):
    """Groups linked by similar items; every linked group with the smallest group of its component."""
    return component_labels(pairs(spark, d).where("score >= 0.2 and grp_a <> grp_b").select("grp_a", "grp_b"), "grp_a", "grp_b")


@query("x02_threshold_sweep", SWEEP_SQL)
def x02(spark, d):
    """The number of components at nested thresholds, from one pass over the similarities."""
    p = pairs(spark, d).where("score >= 0.15 and grp_a <> grp_b").select("grp_a", "grp_b", "score")
    total = items(spark, d).select("grp").distinct().count()
    out = None
    for t in (0.15, 0.2, 0.3):
        lab = component_labels(p.where(F.col("score") >= t), "grp_a", "grp_b")
        row = lab.agg(F.lit(t).alias("threshold"), (F.lit(total) - F.count_if(F.col("node") != F.col("root"))).alias("components"))
        out = row if out is None else out.unionByName(row)
    return out


@query("x03_redundant_items", """
WITH e AS (SELECT a.grp, a.item AS x, b.item AS y FROM items a JOIN items b ON a.grp = b.grp AND a.item < b.item WHERE round(list_dot_product(a.vec, b.vec), 9) >= 0.05)
SELECT DISTINCT y AS item FROM e""")
def x03(spark, d):
    """Items that are not the first of their cluster of near duplicates inside a group: whatever is linked with an earlier one."""
    t = items(spark, d).select("grp", "item", "vec")
    j = t.toDF("grp", "x", "va").join(t.toDF("grp", "y", "vb"), "grp").where("x < y").where(F.round(dot(F.col("va"), F.col("vb")), 9) >= 0.05)
    return j.select(F.col("y").alias("item")).distinct()


@query("x04_prune_members", """
SELECT grp, list(item ORDER BY item) AS members FROM items WHERE item % 7 <> 3 GROUP BY grp""")
def x04(spark, d):
    """Groups without the items of a global redundancy set; emptied groups go."""
    t = items(spark, d).select("grp", "item")
    gone = t.where("item % 7 = 3").select("item")
    return t.join(gone, "item", "left_anti").groupBy("grp").agg(F.sort_array(F.collect_list("item")).alias("members"))


@query("x05_task_components", """
WITH RECURSIVE e AS (SELECT DISTINCT entity_a AS u, entity_b AS v FROM pairs WHERE y = 1 AND entity_a <> entity_b),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(node, label) AS (SELECT DISTINCT u, u FROM b UNION SELECT b.v, r.label FROM r JOIN b ON r.node = b.u)
SELECT node, min(label) AS root FROM r GROUP BY node""")
def x05(spark, d):
    """Components of tasks that share a source: a task is a pair, its sources are its entities."""
    t = pairs(spark, d).where("y = 1")
    return component_labels(t.select("entity_a", "entity_b"), "entity_a", "entity_b")


@query("e01_drop_minors", "SELECT grp, list(item ORDER BY item) AS members FROM items WHERE age >= 18 GROUP BY grp")
def e01(spark, d):
    members = items(spark, d).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("item", "age"))).alias("m"))
    kept = F.transform(F.filter("m", lambda x: x["age"] >= 18), lambda x: x["item"])
    return members.select("grp", kept.alias("members")).where(F.size("members") > 0)


@query("e02_pseudonymised_pairs", """
SELECT substr(sha256('a|' || item_a::VARCHAR), 1, 16) AS a, substr(sha256('a|' || item_b::VARCHAR), 1, 16) AS b, y FROM pairs WHERE age_a >= 18 AND age_b >= 18""")
def e02(spark, d):
    h = lambda c: F.substring(F.sha2(F.concat(F.lit("a|"), F.col(c).cast("string")), 256), 1, 16)
    return pairs(spark, d).where("age_a >= 18 and age_b >= 18").select(h("item_a").alias("a"), h("item_b").alias("b"), "y")


@query("s17_keyed_pseudonym")
def s17(spark, d):
    """HMAC-SHA256 by two nested digests; no UDF."""
    return items(spark, d).select("item", F.substring(hmac_sha256("secret-salt", F.col("item").cast("string")), 1, 16).alias("pseudonym"))


@query("e03_release_scan", "SELECT count(*) FILTER (regexp_matches(text, '[0-9]{3}-[0-9]{4}')) AS phone_like, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+')) AS mail_like, count(*) AS n FROM documents")
def e03(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").agg(F.count_if(t.rlike("[0-9]{3}-[0-9]{4}")).alias("phone_like"), F.count_if(t.rlike("[A-Za-z0-9._]+@[A-Za-z0-9]+")).alias("mail_like"), count())


@query("e04_minor_entities", "SELECT item, entity FROM items WHERE entity NOT IN (SELECT entity FROM items GROUP BY entity HAVING coalesce(max(age), 0) < 40)")
def e04(spark, d):
    t = items(spark, d).select("item", "entity", "age")
    young = t.groupBy("entity").agg(F.max("age").alias("m")).where("coalesce(m, 0) < 40")
    return t.join(young, "entity", "left_anti").select("item", "entity")


@query("e05_adult_features", "SELECT grp, count(*) AS n, count(*) FILTER (age < 18) AS children, round(avg(quality) FILTER (age >= 18), 6) AS adult_quality FROM items GROUP BY grp")
def e05(spark, d):
    return items(spark, d).groupBy("grp").agg(count(), F.count_if(F.col("age") < 18).alias("children"), rnd(F.avg(F.when(F.col("age") >= 18, F.col("quality")))).alias("adult_quality"))


@query("e06_guardrail_counters", "SELECT count(*) AS seen, count(*) FILTER (NOT usable) AS unusable, count(*) FILTER (usable AND age IS NULL) AS unknown_age, count(*) FILTER (usable AND age < 18) AS minors, count(*) FILTER (usable AND age >= 18) AS kept FROM items")
def e06(spark, d):
    u, a = F.col("usable"), F.col("age")
    return items(spark, d).agg(count("seen"), F.count_if(~u).alias("unusable"), F.count_if(u & a.isNull()).alias("unknown_age"), F.count_if(u & (a < 18)).alias("minors"), F.count_if(u & (a >= 18)).alias("kept"))


@query("e07_public_aggregate", "SELECT split, gender, count(*) AS n FROM items WHERE age >= 18 GROUP BY ALL HAVING count(*) >= 5")
def e07(spark, d):
    """Only groups of at least five rows leave, without identifiers."""
    return items(spark, d).where("age >= 18").groupBy("split", "gender").agg(count()).where("n >= 5")


@query("e08_blinded_pack", """
SELECT who, substr(sha256('task|' || doc_id::VARCHAR), 1, 12) AS task, row_number() OVER (PARTITION BY who ORDER BY sha256(who || '|' || doc_id::VARCHAR)) AS position
FROM labels, (VALUES ('A'), ('B')) v(who) WHERE doc_id % 50 = 0""")
def e08(spark, d):
    """Opaque tasks in an order of its own for each annotator."""
    w = Window.partitionBy("who").orderBy(F.sha2(F.concat("who", F.lit("|"), F.col("doc_id").cast("string")), 256))
    t = read(spark, d, "labels").where("doc_id % 50 = 0").withColumn("who", F.explode(F.array(F.lit("A"), F.lit("B"))))
    return t.select("who", F.substring(F.sha2(F.concat(F.lit("task|"), F.col("doc_id").cast("string")), 256), 1, 12).alias("task"), F.row_number().over(w).cast("long").alias("position"))


@query("e11_response_domain", "SELECT count(*) FILTER (quality NOT IN (0, 1)) AS bad_quality, count(*) FILTER (toxic NOT IN (0, 1)) AS bad_toxic FROM labels")
def e11(spark, d):
    return read(spark, d, "labels").agg(F.count_if(~F.col("quality").isin(0, 1)).alias("bad_quality"), F.count_if(~F.col("toxic").isin(0, 1)).alias("bad_toxic"))


@query("n01_arm_invariants", """
SELECT 'duplicate_pair' AS check_name, count(*) - count(DISTINCT (item_a, item_b)) AS violations FROM pairs
UNION ALL SELECT 'self_pair', count(*) FILTER (item_a = item_b) FROM pairs
UNION ALL SELECT 'label_vs_entity', count(*) FILTER (y <> (entity_a = entity_b)::INTEGER) FROM pairs
UNION ALL SELECT 'split_leak', count(*) FILTER (split_a <> split_b) FROM pairs
UNION ALL SELECT 'entity_in_two_splits', count(*) FROM (SELECT entity FROM items GROUP BY entity HAVING count(DISTINCT split) > 1)""")
def n01(spark, d):
    p = pairs(spark, d)
    s = p.agg((F.count(F.lit(1)) - F.count_distinct("item_a", "item_b")).alias("duplicate_pair"), F.count_if(F.col("item_a") == F.col("item_b")).alias("self_pair"), F.count_if(F.col("y") != (F.col("entity_a") == F.col("entity_b")).cast("int")).alias("label_vs_entity"), F.count_if(F.col("split_a") != F.col("split_b")).alias("split_leak"))
    names = ["duplicate_pair", "self_pair", "label_vs_entity", "split_leak"]
    out = s.unpivot([], names, "check_name", "violations")
    two = items(spark, d).groupBy("entity").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit("entity_in_two_splits").alias("check_name"), "violations")
    return out.unionByName(two)


@query("n02_lineage_counts", """
SELECT count(*) AS records, count(*) FILTER (grp % 5 IN (0, 2, 4)) AS noisy, count(*) FILTER (grp % 5 NOT IN (0, 2, 4) AND item % 7 = 3) AS redundant, count(*) FILTER (grp % 5 NOT IN (0, 2, 4) AND item % 7 <> 3) AS retained FROM items""")
def n02(spark, d):
    noisy, red = F.col("grp") % 5 % 2 == 0, F.col("item") % 7 == 3
    return items(spark, d).agg(count("records"), F.count_if(noisy).alias("noisy"), F.count_if(~noisy & red).alias("redundant"), F.count_if(~noisy & ~red).alias("retained"))


@query("n04_policy_sensitivity", """
WITH bad AS (SELECT grp FROM items GROUP BY grp HAVING bool_or(NOT usable))
SELECT split_a AS split, y, count(*) AS before, count(*) FILTER (grp_a NOT IN (SELECT grp FROM bad) AND grp_b NOT IN (SELECT grp FROM bad)) AS after FROM pairs GROUP BY 1, 2""")
def n04(spark, d):
    """Pairs that survive if any unusable member spoils its group."""
    bad = items(spark, d).groupBy("grp").agg(F.bool_or(~F.col("usable")).alias("bad")).where("bad")
    p = pairs(spark, d)
    for s in "ab":
        p = p.join(bad.select(F.col("grp").alias(f"grp_{s}"), F.lit(True).alias(f"bad_{s}")), f"grp_{s}", "left")
    ok = F.col("bad_a").isNull() & F.col("bad_b").isNull()
    return p.groupBy(F.col("split_a").alias("split"), "y").agg(count("before"), F.count_if(ok).alias("after"))


@query("n08_whole_blocks", "SELECT grp, count(*) AS n FROM items WHERE usable GROUP BY grp HAVING count(*) = 3")
def n08(spark, d):
    """Blocks that lost a member are dropped whole."""
    return items(spark, d).where("usable").groupBy("grp").agg(count()).where("n = 3")


@query("n12_label_consistency", "SELECT item_a, item_b, y FROM pairs WHERE y <> (entity_a = entity_b)::INTEGER")
def n12(spark, d):
    return pairs(spark, d).where(F.col("y") != (F.col("entity_a") == F.col("entity_b")).cast("int")).select("item_a", "item_b", "y")


@query("z01_incremental_ingest", "SELECT event_id, user_id, event_type FROM events WHERE event_id % 3 <> 0")
def z01(spark, d):
    """What is new in a batch against the keys that were processed before."""
    e = read(spark, d, "events").select("event_id", "user_id", "event_type")
    return e.join(e.where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti")


