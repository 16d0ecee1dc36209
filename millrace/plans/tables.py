"""Derived tables that give the operators their inputs: items, pairs, records, engagement.

Every table grows in proportion to its source; all definitions are integer or rounded
arithmetic that Spark and DuckDB compute alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.vectors import dot

OFFSETS = (1, 2, 3, 7, 11, 29)

BASE_SQL = """WITH items AS (
  SELECT vec_id AS item, vec_id // 3 AS grp, vec_id // 6 AS entity,
         CASE WHEN vec_id % 11 = 0 THEN NULL ELSE (vec_id * 7) % 80 + 1 END AS age,
         vec_id % 2 AS gender, vec_id % 13 <> 0 AS usable, 0.5::DOUBLE + (vec_id % 50)::DOUBLE / 100 AS quality,
         label, embedding::DOUBLE[] AS vec,
         CASE WHEN ('0x' || substr(md5('42|' || (vec_id // 3)::VARCHAR), 1, 4))::INTEGER < 45875 THEN 'train'
              WHEN ('0x' || substr(md5('42|' || (vec_id // 3)::VARCHAR), 1, 4))::INTEGER < 55705 THEN 'val' ELSE 'test' END AS split
  FROM embeddings),
pairs AS (
  SELECT a.item AS item_a, b.item AS item_b, a.grp AS grp_a, b.grp AS grp_b, a.entity AS entity_a, b.entity AS entity_b,
         a.age AS age_a, b.age AS age_b, abs(a.age - b.age) AS gap, (a.label = b.label)::INTEGER AS y,
         round(list_dot_product(a.vec, b.vec), 9) AS score, round(round(list_dot_product(a.vec, b.vec), 9) + 0.05 * (a.label = b.label)::INTEGER, 9) AS tuned,
         a.split AS split_a, b.split AS split_b
  FROM items a, (VALUES (1), (2), (3), (7), (11), (29)) o(k), items b WHERE b.item = a.item + o.k),
daily AS (
  SELECT user_id, CAST(ts AS DATE) AS day,
         count(*) FILTER (event_type = 'click') AS likes, count(*) FILTER (event_type = 'signup') AS comments,
         count(*) FILTER (event_type = 'purchase') AS reposts, count(*) FILTER (event_type = 'view') AS views, max(ts) AS last_ts
  FROM events GROUP BY 1, 2)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_fraction(text: Column) -> Column:
    """The first four hex digits of the MD5 as an integer from 0 to 65,535."""
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")


def split_of(grp: Column, train: float = 0.7, val: float = 0.15, seed: int = 42) -> Column:
    h = hash_fraction(F.concat(F.lit(f"{seed}|"), grp.cast("string")))
    return F.when(h < int(65536 * train), "train").when(h < int(65536 * (train + val)), "val").otherwise("test")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    grp = F.expr("vec_id div 3")
    return read(spark, sf_dir, "embeddings").select(
        i.alias("item"), grp.alias("grp"), F.expr("vec_id div 6").alias("entity"),
        F.when(i % 11 != 0, i * 7 % 80 + 1).alias("age"), (i % 2).alias("gender"), (i % 13 != 0).alias("usable"),
        (F.lit(0.5) + (i % 50).cast("double") / 100).alias("quality"), "label",
        F.col("embedding").cast("array<double>").alias("vec"), split_of(grp).alias("split"),
    )


def pairs(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Six pairs for each item; an equi-join on the partner's id."""
    cols = list(dict.fromkeys(["item", "grp", "entity", "age", "label", "vec", "split", *extra]))
    a = items(spark, sf_dir).select(*[F.col(c).alias(f"{c}_a") for c in cols])
    a = a.withColumn("item_b", F.explode(F.array(*[F.col("item_a") + k for k in OFFSETS])))
    b = items(spark, sf_dir).select(*[F.col(c).alias(f"{c}_b") for c in cols])
    y = (F.col("label_a") == F.col("label_b")).cast("int")
    score = F.round(dot(F.col("vec_a"), F.col("vec_b")), 9)
    return a.join(b, "item_b").select(
        "item_a", "item_b", "grp_a", "grp_b", "entity_a", "entity_b", "age_a", "age_b",
        F.abs(F.col("age_a") - F.col("age_b")).alias("gap"), y.alias("y"), score.alias("score"),
        F.round(score + 0.05 * y, 9).alias("tuned"), "split_a", "split_b", *[f"{c}_{s}" for c in extra for s in "ab"],
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement of a user's day: clicks, sign-ups, purchases and views stand for likes, comments, reposts and views."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        n("click").alias("likes"), n("signup").alias("comments"), n("purchase").alias("reposts"), n("view").alias("views"), F.max("ts").alias("last_ts"))
