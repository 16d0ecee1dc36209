"""Values of the queries that have no SQL, worked out again with numpy."""

import hashlib
import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import probes
from millrace.operators.text_models import gram_counts, ngram_ridge
from millrace.plans import registry
from millrace.plans.tables import BASE_SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def items(duck):
    return duck.sql(BASE_SQL + " SELECT * FROM items ORDER BY item").df()


@pytest.fixture(scope="module")
def pair_rows(duck):
    return duck.sql(BASE_SQL + " SELECT * FROM pairs").df()


def run(spark, name):
    return registry.QUERIES[name](spark, SMALL).toPandas()


def folds(groups, n, seed):
    order = sorted(set(groups), key=lambda g: (hashlib.md5(f"{seed}|{g}".encode()).hexdigest(), g))
    return {g: i % n for i, g in enumerate(order)}


def ridge_errors(x, y, fold, alpha=1.0):
    """fold -> error of a ridge on the others with a free intercept, and of their mean."""
    out = {}
    for k in sorted(set(fold)):
        a, b = fold != k, fold == k
        xa = np.c_[np.ones(a.sum()), x[a]]
        penalty = alpha * np.eye(xa.shape[1])
        penalty[0, 0] = 0
        w = np.linalg.solve(xa.T @ xa + penalty, xa.T @ y[a])
        out[k] = np.abs(y[b] - np.c_[np.ones(b.sum()), x[b]] @ w).mean(), np.abs(y[b] - y[a].mean()).mean()
    return out


def check_probe(got, x, y, fold):
    want = ridge_errors(np.asarray(x, float), np.asarray(y, float), np.asarray(fold))
    assert {int(k): (m, n) for k, m, n in zip(got["fold"], got["mae"], got["mae_mean"])} == {k: pytest.approx(v, rel=1e-6) for k, v in want.items()}


def test_l07_ridge_probe(spark, items):
    t = items[items.age.notna()]
    check_probe(run(spark, "l07_ridge_probe"), np.stack(t.vec), t.age, t.entity.map(folds(items.entity[items.age.notna()], 5, 7)))


def test_l04_block_ablation(spark, items):
    t, got = items[items.age.notna()], run(spark, "l04_block_ablation")
    assert sorted(set(got.dims)) == [4, 16, 64]
    for n in (4, 16, 64):
        check_probe(got[got.dims == n], np.stack(t.vec)[:, :n], t.age, t.entity.map(folds(t.entity, 3, 7)))


def test_l12_difference_ranker_is_antisymmetric(spark, items):
    v, q, e = np.stack(items.vec)[:, :8], items.quality.to_numpy(), items.entity.to_numpy()
    at = [(i, j) for i in range(len(e)) for j in range(i + 1, min(i + 6, len(e))) if e[i] == e[j]]
    both = at + [(j, i) for i, j in at]
    f = folds(e, 3, 7)
    check_probe(run(spark, "l12_difference_ranker"), [v[i] - v[j] for i, j in both], [q[i] - q[j] for i, j in both], [f[e[i]] for i, _ in both])


def test_g38_pooled_readout(spark, items):
    t = items.assign(x=list(np.stack(items.vec)[:, :16])).groupby(["grp", "entity"]).agg(x=("x", lambda s: np.mean(np.stack(s), axis=0)), quality=("quality", "mean")).reset_index()
    f = t.entity.map(folds(items.entity, 3, 7))
    # a record counts once for each of its entity's items, as the fold table has them
    check_probe(run(spark, "g38_pooled_readout"), np.stack(t.x), t.quality, f)


def logit(x, y, reg):
    """Intercept and weights of the mean log loss + reg / 2 * |w * sd|^2."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    sd = x.std(axis=0, ddof=1)
    z = np.c_[np.ones(len(x)), x / sd]
    w, penalty = np.zeros(z.shape[1]), reg * np.eye(z.shape[1])
    penalty[0, 0] = 0
    for _ in range(60):
        mu = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(z.T @ (z * (mu * (1 - mu))[:, None]) / len(z) + penalty, z.T @ (mu - y) / len(z) + penalty @ w)
    return w[0], w[1:] / sd


def test_v16_platt_calibrator(spark, pair_rows):
    got = run(spark, "v16_platt_calibrator")
    t = pair_rows[pair_rows.gap.notna() & (pair_rows.split_a == "train")]
    columns = {"score": t.score, "gap": t.gap.astype(float), "cross": t.score * t.gap.astype(float)}
    for name, cols in (("score", ["score"]), ("attribute_aware", ["score", "gap", "cross"])):
        b, w = logit(np.stack([columns[c] for c in cols], 1), t.y, 1e-4)
        mine = got[got.model == name].set_index("term").weight
        assert mine["intercept"] == pytest.approx(b, abs=2e-3) and [mine[c] for c in cols] == pytest.approx(list(w), abs=2e-3)


def test_l08_linear_probe(spark, items):
    got = run(spark, "l08_linear_probe").iloc[0]
    x, y, train = np.stack(items.vec)[:, :16], items.gender.to_numpy(), (items.split == "train").to_numpy()
    b, w = logit(x[train], y[train], 1e-3)
    guess = (x[~train] @ w + b > 0).astype(int)
    assert got.classes == 2 and got.balanced_accuracy == pytest.approx(np.mean([(guess == y[~train])[y[~train] == k].mean() for k in (0, 1)]), abs=0.02)


def test_l09_overlap_weights(spark, items):
    got = run(spark, "l09_overlap_weights").set_index("gender")
    f, x, y = items.entity.map(folds(items.entity, 3, 7)).to_numpy(), np.stack([items.quality, np.stack(items.vec)[:, 0]], 1), items.gender.to_numpy()
    e = np.zeros(len(y))
    for k in range(3):
        b, w = logit(x[f != k], y[f != k], 1e-3)
        e[f == k] = 1 / (1 + np.exp(-(x[f == k] @ w + b)))
    for arm in (0, 1):
        at = y == arm
        w = np.where(arm == 1, 1 - e[at], e[at])
        assert got.n[arm] == at.sum() and got.ess[arm] == pytest.approx(w.sum() ** 2 / (w**2).sum(), rel=1e-3) and got.propensity[arm] == pytest.approx(e[at].mean(), abs=1e-3)


def test_v17_stratum_logistic(spark, pair_rows):
    got = run(spark, "v17_stratum_logistic").set_index("stratum")
    t = pair_rows[pair_rows.age_a.notna()]
    strata = (t.age_a // 10).astype(int)
    assert set(got.index) == set(strata)
    for s in set(strata):
        score, y = t.score[strata == s].to_numpy(), t.y[strata == s].to_numpy(float)
        assert got.n[s] == len(y)
        if len(y) >= 10 and 0 < y.sum() < len(y):
            x, w = np.c_[np.ones(len(y)), np.floor(np.abs(score) * 100 + 0.5) * np.sign(score) / 100], np.zeros(2)
            for _ in range(50):
                mu = 1 / (1 + np.exp(-x @ w))
                w = w + np.linalg.solve(x.T @ (x * (mu * (1 - mu))[:, None]) + 1e-6 * np.eye(2), x.T @ (y - mu))
            assert [got.intercept[s], got.slope[s]] == pytest.approx(list(w), rel=1e-3, abs=1e-3)
        else:
            assert math.isnan(got.slope[s])


def test_x17_match_coverage(spark, items):
    t = items[items.age.notna()]
    asked = [(int(r.item), int(r.age), r.entity, r.split) for r in t.itertuples() if r.item % 50 == 0]
    edges = []
    for q, age, entity, split in asked:
        for r in t.itertuples():
            if abs(r.age - age) <= 2 and r.entity != entity and r.split == split:
                edges.append((abs(int(r.age) - age), hashlib.md5(f"23|{q}|{r.item}".encode()).hexdigest(), q, int(r.item)))
    taken, used = set(), set()
    for _, _, q, i in sorted(edges):
        if q not in taken and i not in used:
            taken.add(q)
            used.add(i)
    got = run(spark, "x17_match_coverage").iloc[0]
    assert tuple(got[["targets", "with_candidates", "matched"]]) == (len(asked), len({e[2] for e in edges}), len(taken))


def test_x16_bradley_terry(spark, items, pair_rows):
    label, quality = dict(zip(items.item, items.label)), dict(zip(items.item, items.quality))
    games = [(a, b) if quality[a] > quality[b] else (b, a) for a, b in zip(pair_rows.item_a, pair_rows.item_b) if label[a] != label[b] and quality[a] != quality[b]]
    n, names = np.zeros((10, 10)), sorted(set(label.values()))
    for w, l in games:
        n[label[w], label[l]] += 1
    s = np.ones(10)
    for _ in range(3000):
        s = n.sum(axis=1) / ((n + n.T) / (s[:, None] + s)).sum(axis=1)
        s /= s.mean()
    got = run(spark, "x16_bradley_terry").set_index("player").strength
    assert [got[k] for k in names] == pytest.approx(list(s), rel=1e-3)


def test_l01_pca_composite(spark, duck):
    t = duck.sql(BASE_SQL + " SELECT * FROM daily WHERE views > 0").df()
    x = np.log((t[["likes", "comments", "reposts"]].to_numpy(float) + 1) / (t[["views"]].to_numpy(float) + 1))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.linalg.svd(z, full_matrices=False)[2][0]
    want = dict(zip(zip(t.user_id, t.day.astype(str)), z @ (w * np.sign(w[0]))))
    got = run(spark, "l01_pca_composite")
    assert {(u, str(d)[:10]): c for u, d, c in zip(got.user_id, got.day, got.composite)} == {(u, d[:10]): pytest.approx(c, abs=1e-5) for (u, d), c in want.items()}


def test_l10_bayesian_head(spark, items):
    got = run(spark, "l10_bayesian_head").set_index("label")
    for label, t in items.groupby("label"):
        x = np.stack(t.vec)[:, :4]
        assert got.n[label] == len(t) and list(got["mean"][label]) == pytest.approx(list(np.linalg.solve(np.eye(4) + x.T @ x, x.T @ t.quality)), rel=1e-6)


def test_l02_residuals_of_a_fold_do_not_see_its_targets(spark, items):
    got = run(spark, "l02_crossfit_residual")
    assert sorted(got.item) == sorted(items.item[items.age.notna()])
    rows = [(int(i), int(i) % 3, float(i % 7), float(v[0])) for i, v in zip(items.item[:120], items.vec)]
    df = spark.createDataFrame(rows, "item long, fold int, y double, x double")
    other = df.withColumn("y", F.when(F.col("fold") == 0, F.col("y") * -50).otherwise(F.col("y")))
    one, two = ({r["item"]: r["residual"] for r in probes.crossfit_residual(d, "y", ["x"], "fold").collect()} for d in (df, other))
    y = {r[0]: r[2] for r in rows}
    held = [i for i, f, *_ in rows if f == 0]
    assert [y[i] - one[i] for i in held] == pytest.approx([-50 * y[i] - two[i] for i in held])
    assert any(abs(one[i] - two[i]) > 1e-6 for i, f, *_ in rows if f)


def test_m11_normal_tail(spark, items):
    got = run(spark, "m11_normal_tail").set_index("item").p
    assert [got[i] for i in items.item] == pytest.approx([math.erfc(abs((q - 0.745) / 0.144) / math.sqrt(2)) for q in items.quality], rel=1e-9)


def test_s20_ngram_regression(spark, duck):
    got = run(spark, "s20_ngram_regression").iloc[0]
    t = duck.sql("SELECT doc_id, ln(1 + n_chars) AS y FROM documents").df()
    marks = spark.createDataFrame([(int(i),) for i in t.doc_id], "doc_id long").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0).alias("held")).toPandas()
    t = t.merge(marks, on="doc_id")
    assert got.n == t.held.sum() and got.rmse_mean == pytest.approx(math.sqrt(((t.y[t.held] - t.y[~t.held].mean()) ** 2).mean()), rel=1e-6)
    # where the text tells the target, the model beats the mean
    made = spark.createDataFrame([(i, ("abcab" if i % 2 else "xyzzy") * (1 + i % 5), float(10 * (i % 2))) for i in range(300)], "doc_id long, text string, target double")
    one = ngram_ridge(made).first()
    assert one["rmse"] < one["rmse_mean"] / 2


@pytest.mark.parametrize(("n", "window"), [(3, 7), (3, 1 << 21), (1, 3), (5, 1000)])
def test_gram_counts_are_those_of_spark(spark, n, window):
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer

    texts = ["", None, "a", "ab", "abc", "The  cat\n\tsat.", "\u0130stanbul \u03a3\u039f\u03a6\u039f\u03a3 \u00c9t\u00e9", "\U0001f600\U0001f601x\u4e2d\u6587\u0301", "a\0b\0c", "x" * 50, "\r\n\u2028\u00a0end"]
    texts += ["".join(chr(0x4E00 + (i * j) % 2000) for i in range(200)) for j in range(1, 4)] + ["ab"]
    t = spark.createDataFrame([(float(i), x) for i, x in enumerate(texts)], "target double, text string")
    x = RegexTokenizer(inputCol="text", outputCol="chars", pattern="(?s).", gaps=False).transform(t.fillna("", "text"))
    x = HashingTF(inputCol="grams", outputCol="tf", numFeatures=256).transform(NGram(n=n, inputCol="chars", outputCol="grams").transform(x))
    want = {r["target"]: r["tf"].toArray().astype(int).tolist() for r in x.collect()}
    lowered = t.select(F.lit(True).alias("held"), "target", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    got = lowered.mapInArrow(gram_counts(n, 256, window), "held boolean, target double, counts array<int>").collect()
    assert {r["target"]: r["counts"] for r in got} == want


def test_s20_reads_texts_once(spark):
    assert "documents.parquet" not in registry.QUERIES["s20_ngram_regression"](spark, SMALL)._jdf.queryExecution().toString()


def test_a16_a17_files(spark):
    got = run(spark, "a16_file_digests").set_index("file")
    for name in ("region", "nation", "benchmark"):
        data = Path(SMALL, f"{name}.parquet").read_bytes()
        assert got.bytes[f"{name}.parquet"] == len(data) and got.sha256[f"{name}.parquet"] == hashlib.sha256(data).hexdigest()
    docs = {k: json.loads(v) for k, v in run(spark, "a17_manifest").set_index("input").manifest.items()}
    assert {k: v["rows"] for k, v in docs.items()} == {t: spark.read.parquet(f"{SMALL}/{t}.parquet").count() for t in ("labels", "benchmark")}
    assert all(json.loads(v["parameters"]) == {"seed": 42} for v in docs.values())
