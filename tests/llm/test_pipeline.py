"""The corpus pipeline stage by stage against brute force, and the registered SQL."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import oracles, queries, quality

from .conftest import prose
from .test_operators import WORD, near_brute

SMALL = "/root/testdata/sf0.001"


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "token_output"]


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        ids = Counter(r["doc_id"] for r in after)
        if name != "token_output":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality":
            bad = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 0").where(quality.held_out("doc_id"))
            assert len(after) > 0.7 * len(before) and not set(ids) & {r["doc_id"] for r in bad.collect()}
        elif name == "near_dedup":
            want = near_brute([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert set(ids) == {d for d, c in want.items() if d == c}
        elif name == "decontamination":
            bench = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert {r["doc_id"] for r in before} - set(ids) == {r["doc_id"] for r in before if any(b in r["text"] for b in bench)}
        elif name == "mixing":
            size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in before}
            assert max(ids.values()) <= 3 and set(ids) <= set(size)
            source = {r["doc_id"]: r["source"] for r in before}
            full = Counter()
            for doc, n in size.items():
                full[source[doc]] += n
            for s, target in filled(full).items():  # no further off than one document of the source
                taken = sum(size[doc] * n for doc, n in ids.items() if source[doc] == s)
                assert abs(taken - target) <= max(n for doc, n in size.items() if source[doc] == s)
        else:
            assert len(after) == len(before) and sum(r["n_tokens"] for r in after) == max(r["start"] + r["n_tokens"] for r in after)


def filled(full):
    """Targets of the mix by source: shares by weight, what exceeds three times a source goes to the others."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(full, key=lambda s: (s is None, s)))}
    target, open_, left = {}, set(full), sum(full.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * full[s]}
        for s in over or set(open_):
            target[s] = 3 * full[s] if over else left * weight[s] / total
        open_ -= over or set(open_)
        left -= sum(target[s] for s in over)
    return target


def test_run_equals_stages(spark, tmp_path):
    """The run's rows are those of the stages one after the other, each over all that the one before has kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


def test_planted_copies_and_clean_documents(spark):
    rnd = random.Random(12)
    base = [prose(rnd, 80) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " tail") for i, t in enumerate(base[:5])]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, SMALL).collect()}
    assert kept == set(range(20))


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(name, spark, duck):
    def norm(v):
        return round(float(v), 6) if isinstance(v, float) and not math.isnan(v) else v

    df = queries.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    want = duck.sql(oracles.oracle_sql()[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str) == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_registered_queries_cover_whole_tables(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").agg(F.count_distinct("doc_id")).first()[0]
    for name in ("op2_fingerprints", "op4_quality", "op5_mixing", "op7_suffix_dedup", "op9_near_dedup"):
        assert queries.queries()[name](spark, SMALL).count() == n


def test_stages_on_edge_cases(docs, empty, spark, tmp_path):
    """Null texts and ids, repeated ids, a very long text, clashing columns and no rows, through all stages."""
    for of, rows in (("docs", docs), ("empty", empty)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{of}{k}")
            stage(spark, rows, SMALL).write.parquet(out)
            after = spark.read.parquet(out)
            assert name == "token_output" or after.columns == rows.columns
            rows = after
        assert (rows.count() > 0) == (of == "docs")
