"""Importance resampling, sharding and vector codes against brute force, on edge cases and against SQL."""

import hashlib
import itertools
import math
import random
import re
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import importance, oracles, quality, queries, sharding, vector_codes
from millrace.llm.common import staged, text_buffer

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", ["op11_importance", "op12_sharding", "op13_vector_codes"])
def test_query_equals_sql(name, spark, duck):
    df = queries.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    want = duck.sql(oracles.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


# ---------------------------------------------------------------- importance


def plain_features(text, max_n):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return len(w), [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain_ranks(rows, target, max_n, n_buckets, percent, min_words, seed):
    bucket = lambda f: crc32(f.encode()) % n_buckets
    s, t = [0] * n_buckets, [0] * n_buckets
    for texts, into in (([r[1] for r in rows], s), (target, t)):
        for text in texts:
            for f in plain_features(text, max_n)[1]:
                into[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + n_buckets) / ((a + 1) * (T + n_buckets)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text, *_ in rows:
        words, fs = plain_features(text, max_n)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_importance_equals_brute_force(max_n, spark, docs, rows, monkeypatch):
    target = [rows[3][1], "river stone market é", None, ""]
    got = importance.ranked(docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string"), max_n, 500, 30, 5, 7).collect()
    want, drawn = plain_ranks(rows, target, max_n, 500, 30, 5, 7)
    value = lambda r: (r["doc_id"], r["importance_words"], r["importance_features"], r["importance_weight"], r["importance_score"])
    assert sorted(map(value, got), key=str) == sorted(want, key=str)
    assert [value(r) for r in sorted((r for r in got if r["importance_rank"]), key=lambda r: r["importance_rank"])] == drawn
    assert sorted(r["importance_rank"] for r in got if r["importance_rank"]) == list(range(1, len(drawn) + 1))


@pytest.mark.parametrize("max_n", [1, 2, 4])
def test_long_texts_in_pieces(max_n, monkeypatch):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["aa", "Bb", "x" * 90, "é1", "-", "  ", "c" * rnd.randint(1, 9)]) for _ in range(rnd.choice([0, 1, 30, 700]))) for _ in range(12)] + ["y" * 5000, " " * 900 + "z", "q" * 300 + " " + "r" * 300 + " s"]
    monkeypatch.setattr(importance, "BLOCK_BYTES", 64)
    monkeypatch.setattr(importance, "blocks", lambda offsets: ((i, i + 1) for i in range(len(offsets) - 1)))
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]
    got = sorted((int(d), int(b), n) for doc, bucket, n in importance.features(data, offsets, max_n, 1000) for d, b in zip(doc, bucket))
    assert got == sorted((d, crc32(f.encode()) % 1000, f.count(" ") + 1) for d, t in enumerate(texts) for f in plain_features(t, max_n)[1])


def test_suffix_order_and_prefixes():
    rnd = np.random.default_rng(3)
    ids, ends = rnd.integers(0, 3, 200), np.sort(rnd.integers(1, 201, 9))
    ends[-1] = 200
    left = np.array([min(e for e in ends if e > i) - i for i in range(200)])
    for depth in (1, 2, 3, 5):
        order = importance.suffix_order(ids, left, depth)
        suffix = [tuple(ids[i : i + min(left[i], depth)]) for i in order]
        assert sorted(order.tolist()) == list(range(200)) and suffix == sorted(suffix)
        shared = importance.common_prefixes(ids, left, order, depth)
        assert shared[1:].tolist() == [len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a, b)))) for a, b in zip(suffix, suffix[1:])]


def test_resample_keeps_columns_and_empty_tables(spark, docs, empty):
    bench = spark.createDataFrame([(1, "the river")], "item_id int, text string")
    got = importance.resample(docs, bench, max_n=2, percent=50, min_words=1)
    assert set(docs.columns) - set(importance.COLUMNS) <= set(got.columns)
    assert {r["doc_id"] for r in got.collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert importance.ranked(empty, bench).count() == 0 and importance.resample(empty, bench).count() == 0
    assert importance.ranked(docs, bench.limit(0)).count() == docs.count()
    clash = docs.withColumnsRenamed({"size": "importance_rank", "key": "importance_score"})
    assert importance.resample(clash, bench, percent=100, min_words=0).count() == docs.count()


# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (4, 2), (3, 1)])
def test_hilbert_curve_steps_to_neighbours(dims, bits):
    grid = np.array(list(itertools.product(range(1 << bits), repeat=dims))).T
    index = sharding.hilbert_index(list(grid), bits)
    assert sorted(index.tolist()) == list(range(grid.shape[1]))
    path = grid[:, np.argsort(index)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def test_cells_hold_equal_shares(spark):
    values = [None] * 10 + [f"v{i:02d}" for i in range(30)] * 2 + ["v99"] * 30
    df = staged(spark.createDataFrame([(v,) for v in values], "dim string"), "t")
    edges = sharding.cell_edges(df, "dim", 3)
    got = {r["dim"]: r["c"] for r in df.select("dim", sharding.cell_of("dim", edges).alias("c")).distinct().collect()}
    below = lambda v: sum(1 for x in values if v is not None and (x is None or x < v))
    assert got == {v: below(v) * 8 // len(values) for v in set(values)}


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_follow_their_law(law, spark, docs, rows):
    slim = staged(sharding.measured(docs).drop("text"), "t")
    got = sharding.assign(slim, shards=6, bits=3, law=law).collect()
    assert len(got) == len(rows) and {r["key"] for r in got} == {"key"}
    by = {s: [r for r in got if r["shard"] == s] for s in range(6)}
    for s, part in by.items():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()) + 8, crc32((r[1] or "").encode())) for r in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["shard_size"], r["shard_crc32"]) for r in got) == want
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        total, top = sum(w[1] for w in want), max(w[1] for w in want)
        assert all(abs(sum(r["shard_size"] for r in part) - total / 6) <= top for part in by.values())
    line = [r["shard_curve"] for s in range(6) for r in sorted(by[s], key=lambda r: r["slot"])]
    assert line == sorted(line)


def test_shards_prune_ranges_of_every_dimension(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.randint(0, 400), f"s{rnd.randint(0, 40):02d}", f"l{rnd.randint(0, 9)}") for i in range(2000)]
    docs = staged(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), "t")
    manifest = sharding.write_shards(docs, str(tmp_path / "a"), shards=27, law="bytes").collect()
    assert sum(m["rows"] for m in manifest) == 2000 and sum(m["bytes"] for m in manifest) == sum(len(r[1]) + 8 for r in rows)
    # a seventh of the values of a dimension is in under half of the shards, whichever dimension
    for dim, low, high in (("source", "s10", "s15"), ("lang", "l4", "l4"), ("shard_size", 100, 150)):
        hit = [m for m in manifest if m[f"max_{dim}"] >= low and m[f"min_{dim}"] <= high]
        assert 0 < len(hit) < 18
        got = {r["doc_id"] for r in sharding.read_range(spark, str(tmp_path / "a"), **{dim: (low, high)}).collect()}
        value = {"source": lambda r: r[2], "lang": lambda r: r[3], "shard_size": lambda r: len(r[1]) + 8}[dim]
        assert got == {r[0] for r in rows if low <= value(r) <= high}


def test_shards_of_no_rows_and_fewer_rows_than_shards(spark, empty, docs):
    assert sharding.assign(staged(sharding.measured(empty), "t")).count() == 0
    few = staged(sharding.measured(docs.limit(3)), "t")
    for law in ("rows", "bytes"):
        got = sharding.assign(few, shards=5, law=law).collect()
        assert len(got) == 3 and all(r["slot"] == 0 or law == "bytes" for r in got) and all(0 <= r["shard"] < 5 for r in got)
    with pytest.raises(ValueError):
        sharding.assign(few, law="other")


# ---------------------------------------------------------------- vector codes


@pytest.mark.parametrize("length,spread", [(1, 3), (4, 40), (5, 2), (8, 1), (4, 1 << 23)])
def test_nearest_equals_full_search(length, spread):
    rnd = np.random.default_rng(length)
    x, entries = rnd.integers(-spread, spread + 1, (5000, length)), rnd.integers(-spread, spread + 1, (37, length))
    entries[20] = entries[3]  # a tie for certain
    full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    entry, error, measured = vector_codes.nearest(x, entries)
    assert (entry == full.argmin(axis=1)).all() and (error == full.min(axis=1)).all()
    if length == 8:
        assert measured < full.size


def plain_codes(rows, parts, k, rounds):
    v = {i: np.floor(np.array(e, float) * 256).astype(int) for i, e in rows}
    ids = sorted(v)
    length = len(v[ids[0]]) // parts
    cut = {i: v[i].reshape(parts, length) for i in ids}
    books = np.array([[cut[i][j] for i in ids[:k]] for j in range(parts)])
    near = lambda x, b: min(range(len(b)), key=lambda e: (((x - b[e]) ** 2).sum(), e))
    for _ in range(rounds):
        new = books.copy()
        for j in range(parts):
            groups = {}
            for i in ids:
                groups.setdefault(near(cut[i][j], books[j]), []).append(cut[i][j])
            for e, xs in groups.items():
                new[j, e] = [sum(c) // len(xs) for c in zip(*(x.tolist() for x in xs))]
        books = new
    out = {i: ([near(cut[i][j], books[j]) for j in range(parts)]) for i in ids}
    return books, {i: (c, sum(int(((cut[i][j] - books[j][e]) ** 2).sum()) for j, e in enumerate(c))) for i, c in out.items()}


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(5)
    return [(int(i), [float(x) for x in np.round(rnd.standard_normal(12), 2)], [0, 1, None][i % 3]) for i in range(90)]


def test_codes_equal_brute_force(spark, vectors):
    bad = [(500, None, 1), (501, [None] + [0.0] * 11, 1), (502, [float("nan")] * 12, 2), (503, [float("inf")] * 12, 2), (504, [1.0] * 6, 2), (505, [], 2)]
    df = spark.createDataFrame([(*r, "extra") for r in vectors + bad], "vec_id long, embedding array<double>, label int, vector_error string").repartition(5)
    books = vector_codes.fit(df, parts=3, n_entries=10, rounds=2)
    want_books, want = plain_codes([(r[0], r[1]) for r in vectors], 3, 10, 2)
    assert books.entries.tolist() == want_books.tolist()
    coded = staged(vector_codes.encode(df, books), "t")
    got = {r["vec_id"]: r for r in vector_codes.with_label_error(coded).collect()}
    assert {i: (list(r["vector_code"]), r["vector_error"]) for i, r in got.items()} == want
    for i, _, label in vectors:
        assert got[i]["label_error"] == sum(want[j][1] for j, _, other in vectors if other == label)
    back = books.decode(np.array([list(got[i]["vector_code"]) for i in range(90)]))
    assert np.isclose(((back * 256 - np.floor(np.array([v for _, v, _ in vectors]) * 256)) ** 2).sum(), sum(e for _, e in want.values()))


def test_label_sums_by_shuffle(spark, vectors, monkeypatch):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    coded = staged(vector_codes.encode(df, vector_codes.fit(df, parts=3, n_entries=4)), "t")
    want = sorted((r["vec_id"], r["label_error"]) for r in vector_codes.with_label_error(coded).collect())
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert sorted((r["vec_id"], r["label_error"]) for r in vector_codes.with_label_error(coded).collect()) == want


def test_codes_of_few_repeated_huge_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert vector_codes.fit(spark.createDataFrame([], schema), parts=2) is None
    assert vector_codes.fit(spark.createDataFrame([(1, None, 1), (2, [1.0, 2.0, 3.0], 1)], schema), parts=2) is None
    df = spark.createDataFrame([(7, [0.5, 1.0], 1), (7, [0.5, 1.0], 1), (None, [0.25, -1e300], None)], schema)
    books = vector_codes.fit(df, parts=2, n_entries=64)
    assert books.entries.shape == (2, 3, 1)
    got = vector_codes.encode(df, books).collect()
    assert len(got) == 3 and all(r["vector_error"] == 0 for r in got) and {bytes(r["vector_code"]) for r in got} == {bytes([0, 0]), bytes([2, 2])}


# ---------------------------------------------------------------- votes of the quality classifier


def test_votes_are_weighted_by_similarity_and_ties_go_to_the_smaller_id():
    rnd = np.random.default_rng(3)
    texts = ["alpha beta gamma", "alpha beta", "delta epsilon zeta eta", "Alpha BETA", "", None, "gamma gamma 12", "x" * 300 + " beta"]
    data, offsets = text_buffer(pa.array(texts))
    dims = 6
    model = quality.QualityModel(rnd.standard_normal((quality.FEATURES, dims)).astype(np.float32), np.zeros((1, dims), np.float32), np.zeros(1), 1)
    v = model.embed(data, offsets)
    near = rnd.standard_normal((40, dims))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    near[5:15] = near[5]  # ten equal neighbours with mixed labels
    near[20:23] = v[0]
    y = rnd.integers(0, 2, 40).astype(float)
    for k in (1, 3, 7, 40):
        got = quality.QualityModel(model.projection, near.astype(np.float32), y, k).score(data, offsets)
        for row, score in zip(v, got):
            cos = np.round((near.astype(np.float32) @ row).astype(float), 6)
            first = sorted(range(40), key=lambda i: (-cos[i], i))[:k]
            w = np.maximum(cos[first], 0) ** quality.POWER
            assert score == pytest.approx((w * y[first]).sum() / w.sum() if w.sum() else y.mean(), abs=1e-4)
