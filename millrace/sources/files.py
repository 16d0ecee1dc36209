"""File sources and sinks: JSON lines, digests, manifests, allow-listed exports, guarded stores."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.session import shared_dir


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def or_missing(read: Callable, default):
    """What ``read`` gives, or ``default`` if the path that it reads is not there."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return default


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> int:
    """Writes JSON lines and returns how many rows went out, counted by the pass that writes them."""
    seen = Observation("written")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append" if append else "overwrite").json(path)
    return int(seen.get["rows"])


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of JSON lines under an explicit schema: unknown keys are ignored, absent ones are null; a missing path is an empty table."""
    return or_missing(lambda: spark.read.schema(schema).json(path), spark.createDataFrame([], schema))


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, bytes and sha256 of each file; files are read whole, so they should be small ones."""
    out = spark.read.format("binaryFile").load(paths)
    return out.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, inputs: dict[str, DataFrame], parameters: dict) -> DataFrame:
    """One JSON document for each input: its row count, an order-free digest of its rows, and the run's parameters."""
    out = None
    for name, df in inputs.items():
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest"))
        doc = F.to_json(F.struct("digest", F.lit(name).alias("input"), F.lit(json.dumps(parameters, sort_keys=True)).alias("parameters"), "rows"))
        row = row.select(F.lit(name).alias("input"), doc.alias("manifest"))
        out = row if out is None else out.unionByName(row)
    return out


def export(df: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """``df`` as it leaves: written to a new folder once, only with allowed columns."""
    extra = [c for c in df.columns if c not in allowed]
    if extra:
        raise ValueError(f"columns that may not leave: {extra}")
    path = new_folder(df.sparkSession, "export")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def guarded_append(spark: SparkSession, df: DataFrame, column: str, path: str | None = None) -> DataFrame:
    """Appends to a store unless its first row or the new rows have another value of ``column``."""
    path = path or new_folder(spark, "store")
    new = [r[0] for r in df.select(column).distinct().limit(2).collect()]
    if len(new) > 1:
        raise ValueError(f"rows of more than one {column}")
    first = or_missing(lambda: spark.read.schema(df.schema).parquet(path).select(column).first(), None)
    if first and new and first[0] != new[0]:
        raise ValueError(f"the store holds {column} {first[0]}, not {new[0]}")
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
