"""Every registered query of the reference's operators against its SQL, or at least run, on the smallest tables."""

import math
from decimal import Decimal

import pytest

from millrace.plans import registry

SMALL = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, spark, duck):
    df = registry.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    want = duck.sql(registry.ORACLES[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_query_runs(name, spark):
    assert registry.QUERIES[name](spark, SMALL).count() >= 0


def _odd_equals_sql(name, table, rows, schema, spark, tmp_path):
    import duckdb

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    got = sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    for other in ("embeddings", "events"):
        con.sql(f"CREATE VIEW {other} AS SELECT * FROM '{SMALL}/{other}.parquet'")
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert got == sorted(con.sql(registry.ORACLES[name]).fetchall(), key=str)


def test_p08_words_end_at_letters_outside_ascii(spark, tmp_path):
    texts = ["é et", "été", "yé", "éand", "ä and ö", "undé", "_und", "und_", "e\u0301y", "y\u0301", "AND", "band", "", None, "et\n", "кот y дом", "коту", "y٣"]
    _odd_equals_sql("p08_multi_person_caption", "conversations", [(i, t, x) for i, x in enumerate(texts) for t in (1, 2)], "conv_id long, turn long, text string", spark, tmp_path)


def test_s23_keys_end_at_letters_outside_ascii(spark, tmp_path):
    texts = ["é0123456789abcdef 1", "0123456789abcdefé", "x0123456789abcdef", "0123456789abcdef0_", "(0123456789abcdef0)"]
    _odd_equals_sql("s23_sanitise", "documents", list(enumerate(texts)), "doc_id long, text string", spark, tmp_path)


@pytest.mark.parametrize("name", ["b09_query_bootstrap", "b11_cluster_mean", "b12_equal_person_error"])
def test_bootstrap_sums_make_no_rows_by_replicate(name, spark):
    assert "explode(sequence(1, 1000" not in registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
