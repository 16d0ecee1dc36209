"""Operators against brute force on small fixtures, and their edge cases."""

import hashlib
import hmac
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import buckets, text
from millrace.functions.vectors import cosine, normalise
from millrace.operators import crossfit, models, probes, replicates
from millrace.operators import verification as v
from millrace.operators.governance import hmac_sha256
from millrace.operators.graph import component_labels, contract
from millrace.operators.matching import greedy_matching, nearest_matching
from millrace.operators.quantiles import positions, quantiles
from millrace.operators.running import running_sums, score_bucket
from millrace.operators.sampling import group_folds, hash_priority, hash_sample
from millrace.operators.similarity import band_join, search
from millrace.sources import files
from millrace.streaming import incremental


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


@pytest.mark.parametrize("rows", [
    [(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)], [(0.1, 1), (0.2, 1), (0.8, 0), (0.9, 0)], [(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 0)], [(0.5, 1), (0.6, 1)],
    [(round(random.Random(i).uniform(-1, 1), 1), i % 2) for i in range(60)],
])
def test_auc(spark, rows):
    got = v.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()["auc"]
    want = brute_auc(rows)
    assert got is None if want is None else abs(got - want) < 1e-9


def test_eer_and_tar(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "s double, y int")
    assert v.eer(df, "s", "y").first()["eer"] == 0.5
    assert v.tar_at_far(df, "s", "y", 0.0).first()["tar"] == 0.5


def test_running_sums(spark):
    rnd = random.Random(3)
    rows = [(k, round(rnd.uniform(-2, 2), 3), rnd.randint(0, 9)) for k in "ab" for _ in range(40)]
    rows = list({(k, s): (k, s, w) for k, s, w in rows}.values())
    got = running_sums(spark.createDataFrame(rows, "k string, s double, w int"), ["k"], "s", ["w"], score_bucket("s"))
    for r in got.collect():
        assert r["below_w"] == sum(w for k, s, w in rows if k == r["k"] and s < r["s"])


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in component_labels(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert component_labels(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_hmac(spark):
    got = spark.createDataFrame([("x",), ("é",)], "v string").select("v", hmac_sha256("salt", F.col("v")).alias("h")).collect()
    assert all(r["h"] == hmac.new(b"salt", r["v"].encode(), hashlib.sha256).hexdigest() for r in got)


def test_search_and_ranks_over_many_blocks(spark, monkeypatch):
    from millrace.operators import similarity

    monkeypatch.setattr(similarity, "QUERY_BLOCK", 3)
    monkeypatch.setattr(similarity, "GALLERY_BLOCK", 7)
    monkeypatch.setattr(similarity, "STEP", 2)
    rnd = np.random.default_rng(4)
    v = np.round(rnd.standard_normal((40, 3)), 1)
    v[30:34] = v[0]  # ties
    label = [i % 4 if i != 5 else 9 for i in range(40)]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], label[i]) for i in range(40)], "item long, vec array<double>, label int")
    asked, sim = df.where("item < 8"), np.round(v @ v.T, 9)
    order = {q: sorted((i for i in range(40) if i != q), key=lambda i: (-sim[q, i], i)) for q in range(8)}
    got = sorted((r["query"], r["rank"], r["item"], r["sim"]) for r in similarity.search(asked, df, 5).collect())
    assert got == [(q, k + 1, order[q][k], sim[q, order[q][k]]) for q in range(8) for k in range(5)]
    every = sorted((r["query"], r["item"]) for r in similarity.search(asked, df, None, least=0.5, below=2.0, differ=("label",)).collect())
    assert every == [(q, i) for q in range(8) for i in range(40) if i != q and 0.5 <= sim[q, i] < 2.0 and label[q] != label[i]]
    ranks = {r["query"]: r["rank"] for r in similarity.first_ranks(asked, df, "label").collect()}
    best = {q: max((sim[q, i] for i in range(40) if i != q and label[i] == label[q]), default=None) for q in range(8)}
    assert ranks == {q: 1 + sum(sim[q, i] > b for i in range(40) if i != q) for q, b in best.items() if b is not None} and 5 not in ranks
    assert similarity.search(asked.limit(0), df, 5).count() == 0 and similarity.search(asked, df.limit(0), 5).count() == 0


def test_search(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(50)]
    df = spark.createDataFrame(rows, "item long, vec array<double>")
    got = {}
    for r in search(df.where("item < 5"), df, 3).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["item"]))
    for q in range(5):
        sims = sorted(((-round(sum(a * b for a, b in zip(rows[q][1], x, strict=True)), 9), i) for i, x in rows if i != q))[:3]
        assert [i for _, i in sorted(got[q])] == [i for _, i in sims]


def test_band_join(spark):
    a = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "x int")
    b = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "y int")
    got = {(r["x"], r["y"]) for r in band_join(a, b, "x", "y", 2).collect()}
    assert got == {(x, y) for x, y in itertools.product(range(0, 40, 3), range(0, 40, 2)) if abs(x - y) <= 2}


def test_hash_order_and_samples(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "k long, g int")
    want = sorted(range(100), key=lambda i: hashlib.md5(f"7|{i}".encode()).hexdigest())
    assert [r["k"] for r in sorted(hash_priority(df, "k", 7).collect(), key=lambda r: r["position"])] == want
    assert {r["k"] for r in hash_sample(df, "k", ["g"], 5, 7).collect()} == {k for g in range(3) for k in [x for x in want if x % 3 == g][:5]}
    assert group_folds(df, "k", 5, 7).groupBy("fold").count().where("count <> 20").count() == 0


def test_buckets(spark):
    df = spark.createDataFrame([(None,), (0,), (5,), (6,), (24,), (25,), (200,), (201,)], "a int")
    assert [r[0] for r in df.select(buckets.gap_bucket(F.col("a"))).collect()] == ["unknown", "0-5", "5-10", "5-10", "15-25", "25-200", "25+", "25+"]
    assert [r[0] for r in df.select(buckets.pair_age_bucket(F.col("a"))).collect()] == [None, "0-5", "0-5", "6-12", "18-25", "18-25", "51-200", None]


def test_anchor_rules(spark):
    rows = [("5/15/30", 3, [5, 15, 30]), ("5/15", 3, []), ("05/2019/1", 3, []), ("left 9, right is 12", 2, [9, 12]), ("in 7 and in 30", 2, [7, 30]), ("at 12 years and 30 years", 2, []), ("10 years ago", 1, []), (None, 1, [])]
    df = spark.createDataFrame([(c, n) for c, n, _ in rows], "c string, n int")
    got = df.select(text.age_anchors(F.col("c"), F.col("n")).alias("a")).collect()
    assert [r["a"] or [] for r in got] == [w for *_, w in rows]


def test_chunks(spark):
    t = "aa bbb " + "x" * 23 + " c"
    got = spark.createDataFrame([(t,), ("",)], "t string").select(text.chunks(F.col("t"), 10).alias("c")).collect()
    assert got[0]["c"] == ["aa bbb", "x" * 10, "x" * 10, "xxx c"] and got[1]["c"] == []


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(cosine(F.col("a"), F.col("b")).alias("c"), normalise(F.col("a")).alias("n")).collect()
    assert abs(got[0]["c"] - 0.96) < 1e-9 and got[1]["c"] == 0 and got[1]["n"] == [0.0, 0.0]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert files.read_jsonl(spark, str(tmp_path / "none"), df.schema).count() == 0
    files.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "j"), df.schema).collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        files.export(df, ("x",))
    store = str(tmp_path / "s")
    files.guarded_append(spark, df.where("x = 1"), "y", store)
    with pytest.raises(ValueError):
        files.guarded_append(spark, spark.createDataFrame([(3, "b")], "x int, y string"), "y", store)


def test_greedy_matching(spark):
    rnd = random.Random(6)
    edges = sorted({(rnd.randint(0, 3), a, b) for a, b in ((rnd.randint(0, 25), rnd.randint(0, 25)) for _ in range(90)) if a != b})
    for bipartite in (False, True):
        used, want = set(), set()
        for w, a, b in edges:
            ends = {(0, a), (int(bipartite), b)}
            if not used & ends:
                used |= ends
                want.add((a, b))
        df = spark.createDataFrame([*edges, (0, None, 1)], "w int, a long, b long")
        assert {(r["a"], r["b"]) for r in greedy_matching(df, "a", "b", ["w"], bipartite).collect()} == want
        assert greedy_matching(df.limit(0), "a", "b", ["w"], bipartite).count() == 0


def test_kernel_discrepancy(spark):
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((60, 3)), rng.standard_normal((50, 3)) + 0.7
    df = spark.createDataFrame([("x", r.tolist()) for r in x] + [("y", r.tolist()) for r in y] + [(None, [0.0] * 3)], "g string, vec array<double>")

    def k(a, b):
        d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        return sum(np.exp(-d / (2 * s * s)).mean() for s in (0.5, 1.0, 2.0))

    got = probes.kernel_discrepancy(df, "g", "vec", 3, features=4096).first()["mmd2"]
    assert abs(got - (k(x, x) + k(y, y) - 2 * k(x, y))) < 0.05


def test_replicate_multiplicity(spark):
    df = replicates.replicate(spark.range(3000), 2, replicates.multiplicity(F.col("id"), 3))
    assert all(abs(r["sum(w)"] / 3000 - 1) < 0.08 for r in df.groupBy("rep").agg(F.sum("w")).collect())


def test_numpy_draws_equal_columns(spark):
    want = {(r["id"], r["rep"]): r["w"] for r in replicates.replicate(spark.range(20), 31, replicates.multiplicity(F.col("id"), 3)).collect()}
    assert all(want.get((u, k + 1), 0) == w for u in range(20) for k, w in enumerate(replicates.poisson(f"3|{u}", 31)))
    flips = np.array([replicates.coin(f"3|{u}", 200) for u in range(200)])
    assert abs(flips[:, 1:].mean() - 0.5) < 0.01 and (replicates.coin("!3|7", 200) == 1 - replicates.coin("3|7", 200)).all()


@pytest.mark.parametrize("step", [2_000_000, 60])
def test_areas_by_replicate(spark, monkeypatch, step):
    """Ties over borders of tasks and steps, a group without one class, null scores."""
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), round(rnd.uniform(0, 1), 1), rnd.randint(0, 1), f"u{i % 40}") for i in range(300)] + [("c", 0.5, 1, "u1"), ("a", None, 1, "u2")]
    df = spark.createDataFrame(rows, "g string, s double, y int, u string")
    monkeypatch.setattr(replicates, "STEP", step)
    got = {(r["g"], r["rep"]): r["v"] for r in replicates.auc_by_replicate(df, "s", 20, [F.concat(F.lit("1|"), "u")], ("g",)).collect()}
    w = {u: replicates.poisson(f"1|{u}", 20) for u in {r[3] for r in rows}}
    for g in "abc":
        for k in range(20):
            own = [(s, y, int(w[u][k])) for h, s, y, u in rows if h == g and s is not None]
            pairs = [(a, b, x * z) for a, y, x in own if y for b, q, z in own if not q]
            total = sum(m for *_, m in pairs)
            want = sum(m * ((a > b) + 0.5 * (a == b)) for a, b, m in pairs) / total if total else None
            assert got.get((g, k + 1)) == (pytest.approx(want) if total else None)


def test_paired_permutation(spark):
    rnd = random.Random(5)
    rows = [(str(i), i % 2, rnd.gauss(i % 2, 1), rnd.gauss(0, 1)) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, y int, a double, b double")
    r = replicates.paired_permutation(df, "a", "b", F.col("k"), 300, 2).first()
    area = lambda pts: brute_auc(pts)
    c = np.array([replicates.coin(f"2|{k}", 301) for k, *_ in rows])
    d = [abs(area([((b if c[i, j] else a), y) for i, (_, y, a, b) in enumerate(rows)]) - area([((a if c[i, j] else b), y) for i, (_, y, a, b) in enumerate(rows)])) for j in range(301)]
    assert r["difference"] == pytest.approx(d[0]) and r["p"] == pytest.approx((sum(x >= d[0] - 1e-12 for x in d[1:]) + 1) / 301)


def test_nearest_matching_is_the_greedy_one(spark):
    """More queries than items, blocks of three items, and nothing listed by pairs."""
    rnd = random.Random(8)
    q = [(i, rnd.randint(1, 6), rnd.choice("ab"), rnd.randint(0, 3)) for i in range(40)] + [(40, None, "a", 1)]
    t = [(i, rnd.randint(1, 6), rnd.choice("ab"), rnd.randint(0, 3)) for i in range(45)]
    edges = sorted((abs(v - w), hashlib.md5(f"5|{a}|{b}".encode()).hexdigest(), a, b) for a, v, s, e in q if v for b, w, s2, e2 in t if s == s2 and e != e2 and abs(v - w) <= 2)
    left, right, want = set(), set(), set()
    for *_, a, b in edges:
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b))
    got = nearest_matching(spark.createDataFrame(q, "query long, value int, s string, e int"), spark.createDataFrame(t, "item long, value int, s string, e int"), 2, ["s"], "e", 5, block=3)
    assert set(map(tuple, got.collect())) == want


def test_draws_are_dealt_to_all_cores(spark):
    """Narrow rows are not joined into one task: a draw that names the task finds several."""
    from pyspark import TaskContext

    here = lambda unit, n: np.eye(1, n, TaskContext.get().partitionId(), dtype=np.uint8)[0]
    df = spark.range(400).selectExpr("id", "cast(id % 2 as int) as y", "id / 400 as s").repartition(2)
    unit = F.concat(F.lit("1|"), F.col("id").cast("string"))
    assert replicates.auc_by_replicate(df, "s", 50, [unit], draw=here).count() >= 4
    sums = replicates.sums_by_replicate(df, [F.lit(1)], 50, [unit], draw=here)
    assert sums.where("s0 > 0").count() >= 4 and sums.agg(F.sum("s0")).first()[0] == 400


def test_a_task_of_draws_holds_little():
    """Steps and kept draws are bounded for 1,000 and for 10,001 replicates alike."""
    import tracemalloc

    for n, draw in ((1000, replicates.poisson), (10_001, replicates.coin)):
        draw("1|x", n)
        tracemalloc.start()
        weights, step = replicates._weights(n, draw), max(1, replicates.STEP // n)
        for i in range(0, 6000, step):
            weights([[f"1|{k}", f"1|{k + 1}"] for k in range(i, i + step)])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 24e6


@pytest.mark.parametrize("step", [100_000, 60])
def test_areas_of_infinite_scores(spark, monkeypatch, step):
    monkeypatch.setattr(replicates, "STEP", step)
    rows = [(float(s), i % 2, f"u{i}") for i, s in enumerate(["-inf", "-inf", "0", "1", "inf", "inf", "nan", "nan", "inf", "nan"] * 6)]
    got = {r["rep"]: r["v"] for r in replicates.auc_by_replicate(spark.createDataFrame(rows, "s double, y int, u string"), "s", 20, [F.concat(F.lit("1|"), "u")]).collect()}
    rank = lambda s: (math.isnan(s), 0 if math.isnan(s) else s)
    for k in range(20):
        w = [int(replicates.poisson(f"1|{u}", 20)[k]) for *_, u in rows]
        pairs = [(rank(a), rank(b), x * z) for (a, y, _), x in zip(rows, w) if y for (b, q, _), z in zip(rows, w) if not q]
        assert got[k + 1] == pytest.approx(sum(m * ((a > b) + 0.5 * (a == b)) for a, b, m in pairs) / sum(m for *_, m in pairs))


def test_first_object():
    assert text.first_object('x {a {"k": "} {"} } y') == '{"k": "} {"}' and text.first_object("{ {") is None and text.first_object(None) is None


def test_stream_counts_an_id_once_over_batches(spark):
    rows = [(1, "view", 1.0), (2, "view", 2.0), (3, "click", 4.0)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, value double").coalesce(1)
    more = spark.createDataFrame([(2, "view", 2.0), (4, "click", 8.0), (3, "click", 4.0)], events.schema).coalesce(1)
    got = incremental.stream_totals(spark, events.unionByName(more), files_at_once=1).collect()
    assert sorted(map(tuple, got)) == [("click", 2, 12.0), ("view", 2, 3.0)]


@pytest.mark.parametrize("caption, want", [
    ("мне 25", [25]), ("25 лет", [25]), ("тут мне было 14", [14]), ("слева 5 лет, справа 30", [5, 30]), ("в 12 и сейчас в 28", [12, 28]), ("В 12 и в 28", [12, 28]),
    ("10 лет назад и сейчас", []), ("красивое фото", []), ("", []), ("12 to 43, married 29 years, 1971", [12, 43]), ("me (25)", [25]), ("her aged 7 in 1999", [7]), ("only 25", []), ("15 – 40", [15, 40]),
    ("married 29 years", []), ("we have been together 12 years", []), ("she was 12 years old", [12]), ("37 years ago", []), ("мне было 14, сейчас 30 лет", [14, 30]), ("5/26", []), ("18/06/2021", []),
])
def test_age_rules(spark, caption, want):
    df = spark.createDataFrame([(caption,)], "c string")
    got = df.select(text.age_anchors(F.col("c"), F.lit(1)).alias("a")).first()["a"]
    assert got == want


def test_apparent_age_phrases(spark):
    rows = ["выглядит на 20 максимум", "дал бы лет 25", "дала бы 30", "на вид лет 35", "не больше 22", "максимум 18", "на вид 3", ""]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string").select("i", text.apparent_ages(F.col("c")).alias("a")).orderBy("i").collect()
    assert [r["a"] for r in got] == [[20], [25], [30], [35], [22], [18], [], []]
    rows = ["an average 20 people", "village 12 km", "age 30", "looks 25", "looks 250", "married 29 years", "41 years old"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string").select("i", text.apparent_ages(F.col("c")).alias("a")).orderBy("i").collect()
    assert [r["a"] for r in got] == [[], [], [30], [25], [], [], [41]]


def _spearman(a, b):
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    return np.corrcoef(rank(a), rank(b))[0, 1]


def test_nested_ridge_equals_plain_fits(spark):
    rng = np.random.default_rng(5)
    x, prior, grp = rng.normal(size=(240, 6)), rng.normal(size=240), np.arange(240) // 4
    y = 2 * prior + x @ rng.normal(size=6) + 0.1 * rng.normal(size=240)
    df = spark.createDataFrame([(i, int(grp[i]), float(y[i]), float(prior[i]), x[i].tolist()) for i in range(240)], "id long, g long, t double, p double, v array<double>")
    grid = ((2, 1.0), (5, 1.0), (5, 500.0))
    got = {r["id"]: r for r in crossfit.nested_ridge(df.unionByName(df.limit(1).withColumn("id", F.lit(-1).cast("long")).withColumn("t", F.lit(None).cast("double"))), "id", "v", "t", "p", "g", grid=grid).collect()}
    assert got.keys() == set(range(240))
    folds = [{r["g"]: r["fold"] for r in group_folds(df, "g", n, s).collect()} for n, s in ((5, 7), (3, 8))]
    outer, inner = (np.array([f[k] for k in grp]) for f in folds)

    def fit(tr, te, k, a):
        m, sd = x[tr].mean(axis=0), x[tr].std(axis=0)
        z = (x - m) / sd
        u, s, vt = np.linalg.svd(z[tr], full_matrices=False)
        z = z @ vt[:k].T / s[:k] * np.sqrt(len(tr) - 1)
        c, d = np.polyfit(prior[tr], y[tr], 1)
        b = np.linalg.solve(z[tr].T @ z[tr] + a * np.eye(k), z[tr].T @ (y[tr] - c * prior[tr] - d))
        return c * prior[te] + d + z[te] @ b

    for o in range(5):
        score = [np.mean([_spearman(y[te], fit(np.flatnonzero((outer != o) & (inner != i)), te, *p)) for i in range(3) for te in [np.flatnonzero((outer != o) & (inner == i))]]) for p in grid]
        te, point = np.flatnonzero(outer == o), grid[int(np.argmax(score))]
        assert all((got[i]["k"], got[i]["alpha"]) == point for i in te)
        assert np.allclose([got[i]["prediction"] for i in te], fit(np.flatnonzero(outer != o), te, *point))
    assert crossfit.nested_ridge(df.limit(0), "id", "v", "t", "p", "g").count() == 0


def test_permutation_importance(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(b), float(3 * a), i % 4) for i, (a, b) in enumerate(rng.uniform(-1, 1, (400, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, t double, fold int")
    moved = crossfit.shuffled_rows(df, "id", ["a"], 2).collect()
    for k in (1, 2):
        assert sorted(r["donor"]["a"] for r in moved if r["repeat"] == k) == sorted(r[1] for r in rows)
        assert sum(r["donor"]["a"] == r["a"] for r in moved if r["repeat"] == k) < 20
    got = {r["feature"]: r for r in crossfit.permutation_importance(df, "id", "t", ["a", "b"], "fold").collect()}
    assert got.keys() == {"a", "b"} and got["a"]["spearman_drop"] > 0.7 and abs(got["b"]["spearman_drop"]) < 0.1


def test_kmeans_profile_finds_the_number_of_clusters(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (np.eye(4)[i % 4] * 10 + rng.normal(0, 0.2, 4)).tolist(), float(i % 4), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>, q double, g int")
    got = models.kmeans_profile(df, "id", "v", "q", ["g"]).collect()
    assert sorted((r["n"], r["q"]) for r in got) == [(50, 0.0), (50, 1.0), (50, 2.0), (50, 3.0)]
    assert all(abs(r["lo"] - r["q"]) < 1e-6 and abs(r["hi"] - r["q"]) < 1e-6 and r["silhouette"] > 0.9 for r in got)
    one = models.kmeans_profile(df.limit(2), "id", "v", "q", ["g"]).collect()
    assert [(r["cluster"], r["n"]) for r in one] == [(0, 2)]


@pytest.mark.parametrize("by", [[], ["k"]])
def test_quantiles(spark, by):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, round(rnd.gauss(0, 3), 2), 1.0])) for _ in range(300)] + [("only nulls", None), ("one", 5.0)]
    points = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = quantiles(spark.createDataFrame(rows, "k string, x double"), "x", points, by).collect()
    groups = {k: [x for g, x in rows if x is not None and (g == k or not by)] for k in ({g for g, _ in rows} if by else {None})}
    assert len(got) == sum(bool(x) for x in groups.values())
    for r in got:
        assert np.allclose(r["q"], np.quantile(groups[r["k"] if by else None], points), atol=1e-12)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "k string, x int")
    assert quantiles(none, "x", [0.5], ["k"]).count() == 0 and quantiles(none, "x", [0.5]).first()["q"] == [None]


def test_positions(spark):
    rnd = random.Random(4)
    rows = [(k, i, rnd.randint(0, 999)) for k in ("a", None) for i in range(50)]
    got = positions(spark.createDataFrame(rows, "k string, i int, x int"), ["k"], [F.col("x"), F.col("i")], F.floor(F.col("x") / 100))
    assert {(r["k"], r["i"]): r["position"] for r in got.collect()} == {(k, i): sum((y, j) < (x, i) for g, j, y in rows if g == k) for k, i, x in rows}


def test_leave_one_out_auc(spark):
    rnd = random.Random(6)
    rows = [(rnd.randint(0, 9) / 10, rnd.randint(0, 1), rnd.choice("abcd"), rnd.choice(["a", "b", "e", None])) for _ in range(80)] + [(None, 1, "a", "b")]
    everyone = spark.createDataFrame([(x,) for x in "abcdez"], "subject string")
    got = v.leave_one_out_auc(spark.createDataFrame(rows, "s double, y int, i string, j string"), "s", "y", ["i", "j"], everyone)
    for r in got.collect():
        assert abs(r["auc"] - brute_auc([(s, y) for s, y, i, j in rows if s is not None and r["subject"] not in (i, j)])) < 1e-12
    one_class = spark.createDataFrame([(0.1, 1, "a", "a"), (0.2, 0, "b", "b")], "s double, y int, i string, j string")
    assert v.leave_one_out_auc(one_class, "s", "y", ["i", "j"], everyone.where("subject = 'a'")).first()["auc"] is None
    assert {r["auc"] for r in v.leave_one_out_auc(one_class.limit(0), "s", "y", ["i", "j"], everyone).collect()} == {None}


@pytest.mark.parametrize("name", [int, str])
def test_components_are_contracted_in_tasks(spark, name):
    """A path dealt to three tasks; each holds few nodes at a time, and equal names, nulls and loops change nothing."""
    edges = [(name(i), name(i + 1)) for i in range(100)] + [(name(500), name(500)), (None, name(3)), (name(7), name(8)), (name(300), name(200))]
    links = spark.createDataFrame(edges, f"a {'long' if name is int else 'string'}, b {'long' if name is int else 'string'}").repartition(3)
    short = contract(links.where("a <> b").toDF("u", "v"), held=10)
    assert short.where("v >= u").count() == 0
    got = {r["node"]: r["root"] for r in component_labels(links, "a", "b").collect()}
    assert got == {name(i): min(map(name, range(101))) for i in range(101)} | {x: min(name(200), name(300)) for x in (name(200), name(300))}


def test_missing_path_is_an_empty_table_other_errors_stay(spark, tmp_path):
    schema = spark.createDataFrame([(1,)], "x long").schema
    assert files.read_jsonl(spark, str(tmp_path / "none"), schema).collect() == []
    with pytest.raises(Exception, match="no_such_column"):
        files.or_missing(lambda: spark.range(1).select("no_such_column"), None)
    df = spark.createDataFrame([("p1", 1)], "protocol string, x long")
    path = str(tmp_path / "store")
    assert files.guarded_append(spark, df, "protocol", path).count() == 1 and files.guarded_append(spark, df, "protocol", path).count() == 2
    with pytest.raises(ValueError, match="the store holds"):
        files.guarded_append(spark, df.withColumn("protocol", F.lit("p2")), "protocol", path)
