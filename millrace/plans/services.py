"""Streams with state and resume, sinks that count, extractors by name, and the verification of manifests."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.functions import extractors
from millrace.operators.lineage import verify_manifests
from millrace.plans.registry import query
from millrace.plans.tables import items, read
from millrace.plans.texts import CAPTIONS_SQL, captions
from millrace.session import staged
from millrace.sources import files
from millrace.streaming import online_head, resumable

rnd = lambda c, n=6: F.round(c, n)


@query("z03_online_head", """
WITH s AS (
  SELECT label, count(*) AS n, 2 + sum((1 + item % 2) * vec[1] * vec[1] / 0.5) AS a, sum((1 + item % 2) * vec[1] * vec[2] / 0.5) AS b, 2 + sum((1 + item % 2) * vec[2] * vec[2] / 0.5) AS c,
         sum((1 + item % 2) * vec[1] * quality / 0.5) AS u, sum((1 + item % 2) * vec[2] * quality / 0.5) AS v
  FROM items GROUP BY label)
SELECT label, n, round((c * u - b * v) / (a * c - b * b), 6) AS first, round((a * v - b * u) / (a * c - b * b), 6) AS second,
       round(((c * u - b * v) + (a * v - b * u)) / (a * c - b * b), 6) AS at_ones, round((a + c - 2 * b) / (a * c - b * b) + 0.5, 6) AS variance
FROM s""")
def z03(spark, d):
    """A weighted linear head for each label from a stream in two runs, the second from the first one's checkpoint; prediction at (1, 1)."""
    root = files.new_folder(spark, "heads")
    t = items(spark, d).select("item", "label", F.slice("vec", 1, 2).alias("x"), "quality", (1 + F.col("item") % 2).cast("double").alias("w"))
    schema, head = t.drop("item").schema, online_head.Head(2, prior_precision=2.0, noise=0.5)
    for half in (0, 1):
        t.where(F.col("item") % 3 % 2 == half).drop("item").write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{root}/landing")
        online_head.update_stream(stream, head, root, "label", "x", "quality", "w")
    state = online_head.heads(spark, root, head, "label", dict(t.dtypes)["label"])
    asks = state.select("label", F.array(F.lit(1.0), F.lit(1.0)).alias("x"))
    p = online_head.predict(asks, state, head, "label", "x").select("label", "head_mean", "head_variance")
    out = online_head.solved(state, head).join(p, "label")
    return out.select("label", "n", rnd(F.col("mean")[0]).alias("first"), rnd(F.col("mean")[1]).alias("second"), rnd(F.col("head_mean")).alias("at_ones"), rnd(F.col("head_variance")).alias("variance"))


@query("z04_resumable_ingest", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value, count(*) FILTER (event_id % 50 = 7) AS retried FROM events GROUP BY event_type")
def z04(spark, d):
    """Events with repeats as a file stream: a run in which some rows fail, and one that tries them again; each event comes through once."""
    root = files.new_folder(spark, "resumable")
    e = read(spark, d, "events").select("event_id", "ts", "event_type", "value")
    e.unionByName(e.where("event_id % 10 = 0")).write.parquet(f"{root}/landing")
    failing = F.when(F.col("event_id") % 50 == 7, F.lit("not yet"))
    for error in (failing, F.lit(None).cast("string")):
        resumable.ingest(spark, f"{root}/landing", e.schema, root, "event_id", "ts", lambda b, error=error: b.withColumn("error", error), lateness="60 days")
    got = resumable.rows(spark, root, "event_id")
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"), F.count_if(F.col("event_id") % 50 == 7).alias("retried"))


@query("a02_counted_sink", "SELECT count(*) AS written, count(*) FILTER (turn = 0) AS appended, count(*) + count(*) FILTER (turn = 0) AS present FROM conversations")
def a02b(spark, d):
    """What a sink wrote, counted by the pass that wrote it, against what is there."""
    path, t = files.new_folder(spark, "counted"), read(spark, d, "conversations")
    written, appended = files.write_jsonl(t, path), files.write_jsonl(t.where("turn = 0"), path, append=True)
    present = files.read_jsonl(spark, path, t.schema).agg(F.count(F.lit(1)).alias("present"))
    return present.select(F.lit(written).cast("long").alias("written"), F.lit(appended).cast("long").alias("appended"), "present")


@query("s12_counted_lookup", f"""
WITH {CAPTIONS_SQL}, k AS (SELECT DISTINCT trim(caption) AS caption, n_photos FROM cap WHERE item % 4 = 0)
SELECT count(*) FILTER (k.caption IS NOT NULL) AS hits, count(*) FILTER (k.caption IS NULL) AS misses FROM cap LEFT JOIN k ON trim(cap.caption) = k.caption AND cap.n_photos = k.n_photos""")
def s12b(spark, d):
    """Hits and misses of a cache of captions, counted by the pass that writes the ages."""
    rows, seen = captions(spark, d).withColumnRenamed("item", "id"), Observation("lookup")
    entry = F.array(F.struct(F.lit(0).alias("place"), F.col("age").cast("int").alias("age"), F.lit("unknown").alias("reference"), F.lit("cache").alias("source"), F.lit(0.9).alias("confidence")))
    cache = rows.where("id % 4 = 0").select("caption", "n_photos", entry.alias("entries"))
    extractors.extract("cached", rows, cache=cache, metrics=seen).write.parquet(files.new_folder(spark, "ages"))
    return spark.createDataFrame([(seen.get["hits"], seen.get["misses"])], "hits long, misses long")


@query("s25_reply_function", """
SELECT item AS id, 0 AS place, age::INTEGER AS age, 'left' AS reference, 0.6::DOUBLE AS confidence FROM items WHERE item % 4 = 0 AND age < 99
UNION ALL SELECT item, 1, (age + 1)::INTEGER, 'unknown', 1.0::DOUBLE FROM items WHERE item % 4 = 0 AND age < 99""")
def s25(spark, d):
    """Ages that free-text replies state, one row each, by a lateral table function."""
    age = F.col("age")
    good = F.concat(F.lit("Sure [see below]: ```[{\"age\": "), age.cast("string"), F.lit(", \"ref\": \" Left \"}, {\"age\": \""), (age + 1).cast("string"), F.lit("\", \"confidence\": 2}, {\"age\": 140}]``` and ] more"))
    rows = items(spark, d).where("age < 99").select(F.col("item").alias("id"), F.when(F.col("item") % 4 == 0, good).when(F.col("item") % 4 == 1, F.lit("none [1, 2] at all")).alias("reply"))
    return extractors.extract("reply", rows).drop("source")


@query("s26_combined_extractor", f"""
WITH {CAPTIONS_SQL},
r AS (SELECT item AS id, 0 AS place, split_part(caption, '/', 1)::INTEGER AS age, 'caption_regex' AS source FROM cap WHERE item % 6 = 0 AND n_photos = 2
 UNION ALL SELECT item, 1, split_part(caption, '/', 2)::INTEGER, 'caption_regex' FROM cap WHERE item % 6 = 0 AND n_photos = 2
 UNION ALL SELECT item, 0, regexp_extract(caption, '(\\d+)', 1)::INTEGER, 'caption_regex' FROM cap WHERE item % 6 IN (1, 2) AND n_photos = 2
 UNION ALL SELECT item, 1, regexp_extract(caption, '\\d+\\D+(\\d+)', 1)::INTEGER, 'caption_regex' FROM cap WHERE item % 6 IN (1, 2) AND n_photos = 2),
w AS (SELECT item AS id, 0 AS place, regexp_extract(caption, '(\\d+)', 1)::INTEGER AS age, 'caption_regex' AS source FROM cap WHERE item % 6 IN (1, 2, 3) AND NOT (item % 6 IN (1, 2) AND n_photos = 2)
 UNION ALL SELECT item, 1, regexp_extract(caption, '\\d+\\D+(\\d+)', 1)::INTEGER, 'caption_regex' FROM cap WHERE item % 6 IN (1, 2) AND n_photos <> 2),
p AS (SELECT item AS id, 0 AS place, 33 AS age, 'reply' AS source FROM cap WHERE item % 5 = 0 AND item NOT IN (SELECT id FROM r))
SELECT * FROM r UNION ALL SELECT * FROM p UNION ALL SELECT * FROM w WHERE id NOT IN (SELECT id FROM p)""")
def s26(spark, d):
    """The rules where they are sure, else what a reply says, else the rules after all."""
    rows = captions(spark, d).withColumnRenamed("item", "id").withColumn("reply", F.when(F.col("id") % 5 == 0, F.lit('[{"age": 33}]')))
    return extractors.extract("combined", rows).select("id", "place", "age", "source")


@query("n10_manifest_graph", """
WITH l AS (SELECT l_orderkey AS k, md5(count(*)::VARCHAR || '|' || sum(l_linenumber)::VARCHAR) AS sha FROM lineitem GROUP BY l_orderkey),
o AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 3 AS r, l.sha,
         lag(o_orderkey) OVER w AS prev, row_number() OVER w = 1 AS first, max(o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey % 3) AS last
  FROM orders LEFT JOIN l ON l.k = o_orderkey WINDOW w AS (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey)),
q AS (SELECT *, CASE WHEN first AND c % 40 = 0 THEN last ELSE prev END AS input FROM o),
s AS (
  SELECT q.*, (q.sha IS NULL OR q.k % 23 = 0 OR (input IS NOT NULL AND (l.sha IS NULL OR input % 23 = 0))) AS missing,
         ((q.sha IS NOT NULL AND q.k % 23 <> 0 AND q.k % 17 = 0) OR (input IS NOT NULL AND l.sha IS NOT NULL AND input % 23 <> 0 AND input % 17 = 0)) AS drifted
  FROM q LEFT JOIN l ON l.k = q.input)
SELECT k AS manifest, CASE WHEN c % 10 = 3 THEN 'unreachable' WHEN missing THEN 'missing' WHEN drifted THEN 'drifted' WHEN c % 40 = 0 THEN 'cyclic'
       WHEN max((missing OR drifted)::INTEGER) OVER (PARTITION BY c, r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'blocked' ELSE 'verified' END AS status
FROM s""")
def n10(spark, d):
    """Orders as manifests: each states the digest of its own lines and of the order before it; some digests are off, some files gone, some chains closed to rings."""
    from pyspark.sql import Window

    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.md5(F.concat_ws("|", F.count(F.lit(1)), F.sum("l_linenumber"))).alias("sha256"))
    path = lambda c: F.concat(F.lit("order/"), F.col(c).cast("string")).alias("path")
    chain = Window.partitionBy("o_custkey", F.col("o_orderkey") % 3)
    o = staged(read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), F.lag("o_orderkey").over(chain.orderBy("o_orderkey")).alias("prev"), F.max("o_orderkey").over(chain).alias("last")), "chains")
    before = F.when(F.col("prev").isNull() & (F.col("o_custkey") % 40 == 0), F.col("last")).otherwise(F.col("prev"))
    claims = o.select(F.col("k").alias("manifest"), F.explode(F.array(F.struct(F.lit("output").alias("role"), F.col("k").alias("k")), F.struct(F.lit("input").alias("role"), before.alias("k")))).alias("r")).select("manifest", "r.*").where("k is not null")
    claims = claims.join(lines, "k", "left").select("manifest", "role", path("k"), F.when(F.col("k") % 17 == 0, F.lit("off")).otherwise(F.col("sha256")).alias("sha256"))
    there = lines.where("k % 23 <> 0").select(path("k"), "sha256")
    return verify_manifests(claims, there, o.where("k = last and o_custkey % 10 <> 3").select(F.col("k").alias("manifest")))
