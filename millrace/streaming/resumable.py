"""Ingest of a file stream that can be killed and run again: bounded state, failures tried again, and a breaker."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.session import staged

#: So many micro-batches in a row in which every row fails end the run.
BREAKER = 3


class Broken(RuntimeError):
    """The breaker has ended a run; the batch that set it off is not done and comes first in the next run."""


def ingest(spark: SparkSession, landing: str, schema: StructType, root: str, key: str, ts: str, process: Callable[[DataFrame], DataFrame], lateness: str, files_at_once: int = 64, breaker: int = BREAKER) -> None:
    """Works off the files of ``landing`` that are new since the last run, and first the rows that failed in earlier runs.

    ``process`` maps a batch to a DataFrame with a column ``error``; rows in which it is null are written under
    ``root``/rows, the others' inputs under ``root``/failed, each micro-batch in a folder of its own number that a repeated
    batch replaces.  A run that is killed anywhere goes on from the checkpoint.

    Repeated keys are dropped by a state that keeps a key for ``lateness`` of event time only; a repeat
    that comes later is worked off again and dropped by ``rows``.  Rows that come more than ``lateness`` behind the latest are dropped by the watermark, so it
    must cover the disorder of the files.  Rows with a null key or time are not taken.
    """
    _again(spark, schema, root, key, process)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(landing)
    source = source.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
    in_a_row = [0]

    def keep(batch: DataFrame, epoch: int) -> None:
        got = staged(process(batch), "processed")
        n, bad = got.agg(F.count(F.lit(1)), F.count("error")).first()
        in_a_row[0] = in_a_row[0] + 1 if n and n == bad else (in_a_row[0] if not n else 0)
        if in_a_row[0] >= breaker:
            raise Broken(f"{breaker} batches in a row failed")
        got.where("error is null").drop("error").write.mode("overwrite").parquet(f"{root}/rows/part=batch-{epoch}")
        batch.join(got.where("error is not null").select(key), key, "left_semi").write.mode("overwrite").parquet(f"{root}/failed/part=batch-{epoch}")

    q = source.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except Exception as e:
        if "batches in a row failed" in str(e):
            raise Broken(f"{breaker} batches in a row failed") from e
        raise


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def _again(spark: SparkSession, schema: StructType, root: str, key: str, process: Callable[[DataFrame], DataFrame]) -> None:
    """Makes the tables of the first run, and works off what earlier runs have failed to."""
    none = spark.createDataFrame([], schema)
    none.write.mode("ignore").parquet(f"{root}/failed/part=begin")
    process(none).drop("error").write.mode("ignore").parquet(f"{root}/rows/part=begin")
    todo = staged(still_failed(spark, root, key).select(*schema.fieldNames()), "again")
    if todo.limit(1).count():
        got = staged(process(todo), "processed")  # those that fail again stay in failed, where they are already
        got.where("error is null").drop("error").write.parquet(f"{root}/rows/part=again-{uuid.uuid4().hex}")


def rows(spark: SparkSession, root: str, key: str) -> DataFrame:
    """What all runs so far have worked off, one row for each key."""
    got = _read(spark, f"{root}/rows")
    first = got.groupBy(key).agg(F.min_by(F.struct(*[c for c in got.columns if c != "part"]), "part").alias("r"))
    return first.select("r.*")


def still_failed(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The inputs that no run has worked off, one row for each key."""
    failed, done = _read(spark, f"{root}/failed"), _read(spark, f"{root}/rows")
    return failed.drop("part").dropDuplicates([key]).join(done.select(key), key, "left_anti")
