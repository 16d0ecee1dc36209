"""Incremental ingest: batches against processed keys, and a file stream with running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import new_folder


def new_rows(batch: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not processed before."""
    return batch.join(done.select(key), key, "left_anti")


def stream_totals(spark: SparkSession, events: DataFrame, files_at_once: int = 64) -> DataFrame:
    """Totals by event type from a file stream of ``events``; each micro-batch appends partial sums, a replayed one replaces its own.

    An id counts once in the whole stream: the state store keeps the ids seen, so it grows with
    them (on a cluster, use the RocksDB provider). The landing folder, the checkpoint and the sums
    are in the shared folder.
    """
    root = new_folder(spark, "stream")
    events.select("event_id", "event_type", "value").write.parquet(f"{root}/landing")
    source = spark.readStream.schema("event_id long, event_type string, value double").option("maxFilesPerTrigger", files_at_once).parquet(f"{root}/landing").dropDuplicates(["event_id"])

    def keep(batch: DataFrame, epoch: int) -> None:
        sums = batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
        sums.write.mode("overwrite").parquet(f"{root}/sums/epoch={epoch}")

    q = source.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    sums = spark.read.option("basePath", f"{root}/sums").schema("event_type string, n long, value double").parquet(f"{root}/sums")
    return sums.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("value"), 4).alias("value"))
