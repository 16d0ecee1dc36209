"""Audits of packs, replays, inputs and protocols against tables with faults in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import packs
from millrace.plans.registry import query
from millrace.plans.tables import read
from millrace.sources import files

_PACK_SQL = """t AS (SELECT doc_id, substr(sha256('audit|' || doc_id::VARCHAR), 1, 12) AS task, md5(text) AS payload, doc_id % 11 AS place FROM labels JOIN documents USING (doc_id))"""


def _tasks(spark, d):
    t = read(spark, d, "labels").select("doc_id").join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return t.select("doc_id", packs.blind("doc_id", "audit").alias("task"), F.md5("text").alias("payload"), (F.col("doc_id") % 11).alias("place"), F.lit(None).cast("string").alias("response"))


@query("n11_pack_audit", f"""
WITH {_PACK_SQL}, n AS (
SELECT count(*) FILTER (doc_id % 43 = 0 AND doc_id % 37 <> 0) AS repeated_b, count(*) FILTER (doc_id % 37 = 0) AS missing_b, count(*) FILTER (doc_id % 59 = 0) AS missing_key, count(*) FILTER (doc_id % 41 = 0 AND doc_id % 37 <> 0) AS payload,
       count(*) FILTER (doc_id % 47 = 0 AND doc_id % 37 <> 0) AS answered, count(*) FILTER (doc_id % 53 = 0) AS leaked FROM t)
SELECT 'repeated_a' AS check_name, 0::BIGINT AS violations UNION ALL SELECT 'repeated_b', repeated_b FROM n UNION ALL SELECT 'repeated_key', 0 UNION ALL SELECT 'missing_a', 0 UNION ALL SELECT 'missing_b', missing_b FROM n
UNION ALL SELECT 'missing_key', missing_key FROM n UNION ALL SELECT 'payload', payload FROM n UNION ALL SELECT 'same_order', 0 UNION ALL SELECT 'answered', answered + (SELECT count(*) FROM t WHERE doc_id % 43 = 0 AND doc_id % 47 = 0 AND doc_id % 37 <> 0) FROM n UNION ALL SELECT 'leaked', leaked FROM n""")
def n11b(spark, d):
    """Two packs and their key with rows lost, repeated, changed, answered and one note that shows where a task comes from."""
    t = _tasks(spark, d)
    note = F.when(F.col("doc_id") % 53 == 0, F.concat(F.lit("see source "), F.col("doc_id"))).otherwise(F.lit("-")).alias("note")
    a = t.select("task", "place", "payload", "response", note)
    b = t.where("doc_id % 37 <> 0")
    b = b.unionByName(b.where("doc_id % 43 = 0"))
    changed = F.when(F.col("doc_id") % 41 == 0, F.lit("other")).otherwise(F.col("payload")).alias("payload")
    b = b.select("task", (F.col("doc_id") % 13).alias("place"), changed, F.when(F.col("doc_id") % 47 == 0, F.lit("yes")).alias("response"), F.lit("-").alias("note"))
    key = t.where("doc_id % 59 <> 0").select("task", F.concat(F.lit("documents/"), F.col("doc_id")).alias("source"))
    return packs.outgoing_checks(a, b, key, ["payload"], ["note"], "source [0-9]+")


@query("e10_returned_pack", f"""
WITH {_PACK_SQL}, k AS (SELECT * FROM t WHERE doc_id % 37 <> 0), n AS (
SELECT count(*) FILTER (doc_id % 29 = 0) AS moved, count(*) FILTER (doc_id % 41 = 0) AS frozen, count(*) FILTER (doc_id % 7 = 0) AS unanswered, count(*) FILTER (doc_id % 61 = 0 AND doc_id % 7 <> 0) AS not_allowed, count(*) FILTER (doc_id % 5 = 0 AND doc_id % 31 = 0) AS repeated FROM k)
SELECT 'repeated' AS check_name, repeated AS violations FROM n UNION ALL SELECT 'lost', (SELECT count(*) FROM t WHERE doc_id % 37 = 0) UNION ALL SELECT 'added', (SELECT count(*) FROM k WHERE doc_id % 67 = 0)
UNION ALL SELECT 'moved', moved FROM n UNION ALL SELECT 'frozen', frozen FROM n UNION ALL SELECT 'unanswered', unanswered FROM n UNION ALL SELECT 'not_allowed', not_allowed FROM n""")
def e10b(spark, d):
    """A pack that came back with tasks lost, added, repeated and moved, a frozen field changed and responses that are not allowed."""
    t = _tasks(spark, d)
    k = t.where("doc_id % 37 <> 0")
    i = F.col("doc_id")
    back = k.select(i.alias("doc_id"), "task", F.when(i % 29 == 0, F.col("place") + 100).otherwise(F.col("place")).alias("place"), F.when(i % 41 == 0, F.lit("x")).otherwise(F.col("payload")).alias("payload"), F.when(i % 7 == 0, None).when(i % 61 == 0, F.lit("maybe")).otherwise(F.when(i % 2 == 0, F.lit("yes")).otherwise("no")).alias("response"))
    back = back.unionByName(back.where("doc_id % 5 = 0 and doc_id % 31 = 0")).unionByName(back.where("doc_id % 67 = 0").withColumn("task", F.concat(F.lit("new-"), "task")))
    return packs.returned_checks(t, back.drop("doc_id"), ["payload"], ["yes", "no"])


@query("e12_guard_refusal", "SELECT source, CASE WHEN source = min(source) OVER () THEN n ELSE 0 END AS stored, source <> min(source) OVER () AS refused FROM (SELECT source, count(*) AS n FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY source)")
def e12b(spark, d):
    """A store takes one source and refuses the others."""
    path, t = files.new_folder(spark, "guarded"), read(spark, d, "documents").where("source in ('src1', 'src2', 'src3')").select("doc_id", "source")
    rows = []
    for source in sorted(r[0] for r in t.select("source").distinct().collect()):  # three
        try:
            files.guarded_append(spark, t.where(F.col("source") == source), "source", path)
            rows.append((source, False))
        except ValueError:
            rows.append((source, True))
    tried = spark.createDataFrame(rows, "source string, refused boolean")
    stored = spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("stored"))
    return tried.join(stored, "source", "left").na.fill(0, ["stored"]).select("source", "stored", "refused")


@query("n03_independent_replay", """
WITH a AS (SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1),
b AS (SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity * l_extendedprice > 2000000) GROUP BY 1)
SELECT count(*) FILTER (a.c IS NULL) AS only_second, count(*) FILTER (b.c IS NULL) AS only_first, count(*) FILTER (a.n <> b.n) AS different, count(*) FILTER (a.n = b.n) AS same FROM a FULL JOIN b ON a.c = b.c""")
def n03b(spark, d):
    """Counts by customer from two rules for large orders, key by key: found by one only, different, the same."""
    lines, orders = read(spark, d, "lineitem"), read(spark, d, "orders")
    counted = lambda rule, name: orders.join(lines.where(rule).select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").groupBy(F.col("o_custkey").alias(f"c_{name}")).agg(F.count(F.lit(1)).alias(name))
    a, b = counted("l_quantity > 45", "a"), counted("l_quantity * l_extendedprice > 2000000", "b")
    n = lambda c, name: F.count_if(c).alias(name)
    return a.join(b, F.col("c_a") == F.col("c_b"), "full").agg(n(F.col("a").isNull(), "only_second"), n(F.col("b").isNull(), "only_first"), n(F.col("a") != F.col("b"), "different"), n(F.col("a") == F.col("b"), "same"))


@query("n06_changed_inputs", """
SELECT 'nation' AS input, count(*) AS rows_before, count(*) FILTER (n_nationkey <> 3) AS rows_after, true AS changed FROM nation
UNION ALL SELECT 'region', count(*), count(*), false FROM region UNION ALL SELECT 'labels', count(*), count(*), count(*) FILTER (doc_id % 50 = 0) > 0 FROM labels""")
def n06b(spark, d):
    """Row counts and order-free digests of inputs before a run and after it: one lost a row, one had a value changed, one only its order."""
    before = {t: read(spark, d, t) for t in ("nation", "region", "labels")}
    after = {
        "nation": before["nation"].where("n_nationkey <> 3"), "region": before["region"].orderBy(F.desc("r_name")),
        "labels": before["labels"].withColumn("toxic", F.when(F.col("doc_id") % 50 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast(dict(before["labels"].dtypes)["toxic"])),
    }
    read_back = lambda m, name: m.select("input", F.from_json("manifest", "rows long, digest string").alias(name))
    a, b = (read_back(files.manifest(spark, m, {}), n) for m, n in ((before, "a"), (after, "b")))
    return a.join(b, "input").select("input", F.col("a.rows").alias("rows_before"), F.col("b.rows").alias("rows_after"), ((F.col("a.rows") != F.col("b.rows")) | (F.col("a.digest") != F.col("b.digest"))).alias("changed"))


@query("n07_table_protocol", """
WITH l AS (SELECT sha256(doc_id::VARCHAR || '=' || quality::VARCHAR || '|' || toxic::VARCHAR) AS h FROM labels)
SELECT sha256(count(*)::VARCHAR || '|' || sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR || '|' || sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR) AS digest FROM l""")
def n07b(spark, d):
    """One digest of a whole table, whatever its order: sums of the rows' digests, so nothing is sorted or brought together."""
    text = lambda c: F.col(c).cast("string")
    h = read(spark, d, "labels").select(F.sha2(F.concat(text("doc_id"), F.lit("="), text("quality"), F.lit("|"), text("toxic")), 256).alias("h"))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return h.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), part(1), part(16)), 256).alias("digest"))
