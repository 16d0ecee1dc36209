"""Online heads and resumable ingest: any cut and any interruption gives the rows of one unbroken run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.streaming import online_head, resumable
from millrace.streaming.online_head import Head


def head_rows(n, seed=1):
    rnd = np.random.default_rng(seed)
    return [(int(rnd.integers(0, 4)), [float(v) for v in rnd.standard_normal(3)], float(rnd.standard_normal()), float(rnd.integers(1, 4))) for _ in range(n)]


SCHEMA = "k long, x array<double>, y double, w double"


def plain(rows, prior, noise):
    out = {}
    for k, x, y, w in rows:
        lam, b, n = out.get(k, (prior * np.eye(3), np.zeros(3), 0))
        x = np.array(x)
        out[k] = lam + w * np.outer(x, x) / noise, b + w * x * y / noise, n + 1
    return out


def same(got, want):
    assert {r["k"]: r["n"] for r in got} == {k: v[2] for k, v in want.items()}
    for r in got:
        assert np.allclose(r["precision"], want[r["k"]][0].ravel()) and np.allclose(r["moment"], want[r["k"]][1])


def test_any_cut_of_the_stream_gives_the_batch_posterior(spark, tmp_path):
    rows, head = head_rows(90), Head(3, 2.0, 0.5)
    bad = [(None, [1.0, 1.0, 1.0], 1.0, 1.0), (1, None, 1.0, 1.0), (1, [1.0], 1.0, 1.0), (1, [1.0, None, 1.0], 1.0, 1.0), (1, [1.0, 1.0, 1.0], None, 1.0)]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    want = plain(rows, 2.0, 0.5)
    same(online_head.batch_posterior(df, head, "k", "x", "y", "w").collect(), want)
    landing, root = str(tmp_path / "in"), str(tmp_path / "root")
    before = spark.conf.get(online_head.PROVIDER, None)
    for i, part in enumerate((rows[:20], rows[20:21] + bad, rows[21:])):  # a run for each: the second and third go on from the checkpoint
        spark.createDataFrame(part, SCHEMA).repartition(1 + i).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1 + i % 2).parquet(landing)
        online_head.update_stream(stream, head, root, "k", "x", "y", "w")
    assert spark.conf.get(online_head.PROVIDER, None) == before
    state = online_head.heads(spark, root, head, "k", "long")
    same(state.collect(), want)
    asks = spark.createDataFrame([(0, [1.0, 2.0, -1.0]), (3, [0.5, 0.0, 0.0]), (77, [1.0, 1.0, 1.0])], "k long, x array<double>")
    for r in online_head.predict(asks, state, head, "k", "x").collect():
        lam, b, _ = want.get(r["k"], (2.0 * np.eye(3), np.zeros(3), 0))
        x, cov = np.array(r["x"]), np.linalg.inv(lam)
        assert np.isclose(r["head_mean"], x @ cov @ b) and np.isclose(r["head_variance"], x @ cov @ x + 0.5)


EVENTS = "id long, ts timestamp, v double"


def land(spark, path, ids):
    df = spark.createDataFrame([(i, float(i)) for i in ids], "id long, v double").select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), "v")
    df.coalesce(1).write.mode("append").parquet(path)


def ok_but(bad):
    """A process in which the given ids fail."""
    return lambda b: b.select("*", (F.col("v") * 2).alias("w"), F.when(F.col("id").isin(list(bad)), "failed").alias("error"))


def found(spark, root):
    return sorted((r["id"], r["w"]) for r in resumable.rows(spark, root, "id").collect())


def test_runs_resume_after_failures_and_repeats(spark, tmp_path):
    landing, root = str(tmp_path / "in"), str(tmp_path / "root")
    schema = spark.createDataFrame([], EVENTS).schema
    run = lambda process, **k: resumable.ingest(spark, landing, schema, root, "id", "ts", process, "1 day", files_at_once=1, **k)
    land(spark, landing, range(5))
    land(spark, landing, [3, 4, 5, 6])
    run(ok_but({2, 6}))
    assert found(spark, root) == [(i, 2.0 * i) for i in (0, 1, 3, 4, 5)] and {r["id"] for r in resumable.still_failed(spark, root, "id").collect()} == {2, 6}
    # a run that is killed in the middle of a batch
    land(spark, landing, [7, 8])

    def dies(b):
        if b.where("id = 8").count():
            raise ValueError("killed")
        return ok_but({6})(b)

    with pytest.raises(Exception, match="killed"):
        run(dies)
    assert {i for i, _ in found(spark, root)} == {0, 1, 2, 3, 4, 5}  # 2 was tried again before the batch
    run(ok_but(()))
    assert found(spark, root) == [(i, 2.0 * i) for i in range(9)] and resumable.still_failed(spark, root, "id").count() == 0
    run(ok_but(()))
    assert found(spark, root) == [(i, 2.0 * i) for i in range(9)]


def test_breaker_ends_a_run_and_loses_nothing(spark, tmp_path):
    landing, root = str(tmp_path / "in"), str(tmp_path / "root")
    schema = spark.createDataFrame([], EVENTS).schema
    for i in range(4):
        land(spark, landing, [i])
    with pytest.raises(resumable.Broken):
        resumable.ingest(spark, landing, schema, root, "id", "ts", ok_but(range(9)), "1 day", files_at_once=1)
    resumable.ingest(spark, landing, schema, root, "id", "ts", ok_but(()), "1 day", files_at_once=1)
    assert found(spark, root) == [(i, 2.0 * i) for i in range(4)]
