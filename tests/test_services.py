"""Extractors by name, counting sinks, manifest graphs and ratings."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import Observation

from millrace.functions import extractors
from millrace.operators import lineage, models
from millrace.operators.lineage import verify_manifests
from millrace.sources import files

ROWS = [
    (1, "мне 25", 1, '[{"age": 30}]'), (2, "5/26", 2, '[{"age": 31}]'), (3, "no age", 2, 'x [1] ```[{"age": "7", "ref": " A ", "confidence": -3}, {"age": true}, {"age": 100}, {"age": 8, "confidence": "high"}]``` ]'),
    (4, None, None, None), (5, "", 1, "[{'age': 3}]"), (6, "12 to 43", 2, "[" * 5000), (7, "nothing", 1, '[] [{"age": 9}]'),
]


@pytest.fixture(scope="module")
def captioned(spark):
    return spark.createDataFrame(ROWS, "id int, caption string, n_photos int, reply string")


def found(df):
    return sorted((r["id"], r["place"], r["age"], r["reference"], r["source"]) for r in df.collect())


def test_extractors_by_name(spark, captioned):
    rules = [(1, 0, 25, "position_0", "caption_regex"), (2, 0, 5, "position_0", "caption_regex"), (2, 1, 26, "position_1", "caption_regex"), (6, 0, 12, "position_0", "caption_regex"), (6, 1, 43, "position_1", "caption_regex")]
    assert found(extractors.extract("regex", captioned)) == rules
    replies = [(1, 0, 30, "unknown", "reply"), (2, 0, 31, "unknown", "reply"), (3, 0, 7, "a", "reply"), (3, 1, 8, "unknown", "reply")]
    got = extractors.extract("Reply", captioned)
    assert found(got) == replies and {(r["age"], r["confidence"]) for r in got.collect() if r["id"] == 3} == {(7, 0.0), (8, 0.6)}
    assert found(extractors.extract("combined", captioned)) == sorted([r for r in rules if r[0] in (2, 6)] + [r for r in replies if r[0] in (1, 3)])
    with pytest.raises(ValueError):
        extractors.extract("other", captioned)
    assert extractors.extract("regex", captioned.limit(0)).count() == 0


@pytest.mark.parametrize("fallback", ["regex", "reply"])
def test_cached_extractor_counts_in_the_pass_that_uses_it(spark, captioned, fallback):
    entry = "array<struct<place:int,age:int,reference:string,source:string,confidence:double>>"
    cache = spark.createDataFrame([(" no age ", 2, [(0, 50, "left", "cache", 0.9)]), ("", None, []), ("мне 25", 2, [(0, 1, "x", "cache", 0.9)])], f"caption string, n_photos int, entries {entry}")
    seen = Observation()
    got = found(extractors.extract("cached", captioned, cache=cache, fallback=fallback, metrics=seen))
    assert (3, 0, 50, "left", "cache") in got and not [r for r in got if r[0] == 4]
    assert {r[2] for r in got if r[0] == 1} == ({25} if fallback == "regex" else {30})
    assert seen.get["hits"] == 2 and seen.get["misses"] == 5  # the fallback over the reply reads the rows a second time, and counts them once


def test_sink_counts_what_it_writes(spark, captioned, tmp_path):
    path = str(tmp_path / "j")
    assert files.write_jsonl(captioned, path) == 7 and files.write_jsonl(captioned.where("id > 5"), path, append=True) == 2
    assert files.write_jsonl(captioned.limit(0), path, append=True) == 0 and files.write_jsonl(captioned.where("id = 1 and id = 2"), path, append=True) == 0
    assert files.read_jsonl(spark, path, captioned.schema).count() == 9


def test_manifest_statuses(spark):
    records = [
        ("a", "output", "/a", "1"), ("b", "input", "/a", "1"), ("b", "output", "/b", "2"), ("b", "output", "/b", "2"), ("c", "input", "/b", "2"), ("c", "output", "/c", "3"),
        ("d", "output", "/d", "4"), ("e", "input", "/d", "4"), ("e", "output", "/e", "5"), ("f", "input", "/e", "5"), ("f", "output", "/f", "6"),
        ("g", "output", "/gone", "7"), ("h", "input", "/gone", "7"), ("i", "output", "/h", "8"),
        ("r1", "input", "/r2", "9"), ("r1", "output", "/r1", "9"), ("r2", "input", "/r1", "9"), ("r2", "output", "/r2", "9"), ("s", "input", "/r2", "9"), ("s", "output", "/s", "9"),
        ("t", "input", "/t", "9"), ("t", "output", "/t", "9"), ("u", "output", "/u", None), ("x", "output", "/x", "9"), ("y", "output", "/two", "1"), ("z", "output", None, "1"),
    ]
    there = [("/a", "1"), ("/b", "2"), ("/c", "3"), ("/d", "OTHER"), ("/e", "5"), ("/f", "6"), ("/r1", "9"), ("/r2", "9"), ("/s", "9"), ("/t", "9"), ("/u", "1"), ("/x", "9"), ("/two", "1"), ("/two", "2"), ("/h", "8")]
    roots = [(m,) for m in ("c", "f", "h", "i", "s", "t", "u", "y", "z", "c", "unknown")]
    got = verify_manifests(spark.createDataFrame(records, "manifest string, role string, path string, sha256 string"), spark.createDataFrame(there, "path string, sha256 string"), spark.createDataFrame(roots, "manifest string")).collect()
    assert {r["manifest"]: r["status"] for r in got} == {
        "a": "verified", "b": "verified", "c": "verified", "d": "drifted", "e": "drifted", "f": "blocked", "g": "missing", "h": "missing", "i": "verified", "r1": "cyclic", "r2": "cyclic",
        "s": "blocked", "t": "cyclic", "u": "drifted", "x": "unreachable", "y": "drifted", "z": "missing",
    } and len(got) == 17


def _walked(start, steps):
    """What a walk from the start meets, one by one."""
    met, todo = set(start), list(start)
    while todo:
        for n in steps.get(todo.pop(), ()):
            if n not in met:
                met.add(n)
                todo.append(n)
    return met


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_manifest_statuses_of_random_graphs(spark, monkeypatch, seed):
    monkeypatch.setattr(lineage, "PIECES", 3)
    rnd, names = random.Random(seed), [f"m{i:02}" for i in range(70)]
    rests = {(a, b) for i, a in enumerate(names) for b in names[:i] if i - int(b[1:]) < 9 and rnd.random() < 0.2} | {tuple(rnd.sample(names[k : k + 12], 2)) for k in range(0, 60, 10)}
    off, gone = ({n for n in names if rnd.random() < p} for p in (0.04, 0.04))
    records = [(n, "output", f"/{n}", "1") for n in names] + [(a, "input", f"/{b}", "1") for a, b in rests for _ in range(1 + (a > b))]
    roots = rnd.sample(names, 6)
    frame = spark.createDataFrame
    got = verify_manifests(frame(records, "manifest string, role string, path string, sha256 string"), frame([(f"/{n}", "2" if n in off else "1") for n in names if n not in gone], "path string, sha256 string"), frame([(r,) for r in roots], "manifest string")).collect()
    down, up = ({n: {p[1 - k] for p in rests if p[k] == n} for n in names} for k in (0, 1))
    own = {n: {n} | down[n] for n in names}
    reached, rings = _walked(roots, down), {n for n in names if n in _walked(down[n], down)}
    cyclic = {n for n in names if n in rings or (_walked(down[n], down) & rings and _walked(up[n], up) & rings)}
    bad = cyclic | {n for n in names if own[n] & (off | gone)}
    blocked = _walked(bad, up)
    want = {n: "unreachable" if n not in reached else "missing" if own[n] & gone else "drifted" if own[n] & off else "cyclic" if n in cyclic else "blocked" if n in blocked else "verified" for n in names}
    assert {r["manifest"]: r["status"] for r in got} == want and len(got) == len(names)


def test_manifest_rounds_read_what_is_left(spark, monkeypatch):
    """A round reads no table of rounds long past, and the steps that are left get fewer with each."""
    read, sizes, write = [], [], lineage.staged

    def staged(df, label):
        read.append(len(set(re.findall(r"/reach-[0-9a-f]+", "".join(df.inputFiles())))))
        out = write(df, label)
        if label == "steps":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(lineage, "staged", staged)
    records = [(i, "output", f"/{i}", "1") for i in range(12)] + [(i, "input", f"/{i - 1}", "1") for i in range(1, 12)]
    got = verify_manifests(spark.createDataFrame(records, "manifest long, role string, path string, sha256 string"), spark.createDataFrame([(f"/{i}", "1" if i else "2") for i in range(12)], "path string, sha256 string"), spark.createDataFrame([(11,)], "manifest long"))
    assert {r["manifest"]: r["status"] for r in got.collect()} == {i: "drifted" if i < 2 else "blocked" for i in range(12)}
    assert max(read) <= 2 and sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[4] > sizes[8]


def test_ratings_by_joins_equal_those_on_the_driver(spark, monkeypatch):
    rnd = random.Random(6)
    games = [(f"p{i}", f"p{j}") for i, j in (sorted(rnd.sample(range(9), 2), key=lambda k: rnd.random() * (k + 2)) for _ in range(150))] + [("p0", "loser")] * 2 + [("p1", None), ("p1", "p1")]
    df = spark.createDataFrame(games, "w string, l string")
    small = {r["player"]: r["strength"] for r in models.bradley_terry(df, rounds=12).collect()}
    monkeypatch.setattr(models, "DRIVER_PLAYERS", 3)
    large = {r["player"]: r["strength"] for r in models.bradley_terry(df, rounds=12).collect()}
    names = sorted(small)
    n = np.array([[sum((w, l) in ((a, b), (b, a)) for w, l in games) if a != b else 0 for b in names] for a in names])
    wins, s = np.array([sum(w == a and l not in (a, None) for w, l in games) for a in names]), np.ones(len(names))
    for _ in range(12):
        new = np.where(wins > 0, wins / (n / (s[:, None] + s)).sum(axis=1), s)
        s = new / new.mean()
    assert np.allclose([small[p] for p in names], s) and np.allclose([large[p] for p in names], s)
    assert models.bradley_terry(df.limit(0)).count() == 0


def test_packs_are_refused_for_each_kind_of_fault(spark):
    from millrace.operators import packs

    schema = "task string, place int, payload string, note string, response string"
    a = [("t1", 1, "p", "-", None), ("t2", 2, "q", "-", None), ("t3", 3, None, None, None)]
    key = [("t1", "s/1"), ("t2", "s/2"), ("t3", None)]
    make = lambda rows: spark.createDataFrame(rows, schema)

    def found(b, k=key, first=a):
        report = packs.outgoing_checks(make(first), make(b), spark.createDataFrame(k, "task string, source string"), ["payload"], ["note"], "orig[0-9]+")
        return report, {r["check_name"]: r["violations"] for r in report.collect() if r["violations"]}

    good = [("t1", 3, "p", "x", None), ("t2", 1, "q", "y", None), ("t3", 2, None, None, None)]
    report, bad = found(good)
    assert bad == {}
    packs.refuse(report)
    assert found(a)[1] == {"same_order": 3}
    report, bad = found([("t1", 3, "CHANGED", "from s/1", "yes"), ("t1", 3, "CHANGED", "orig77", None), ("t9", 1, "q", None, None)], key[:2] * 2)
    assert bad == {"repeated_b": 1, "repeated_key": 2, "missing_a": 1, "missing_b": 2, "missing_key": 2, "payload": 1, "answered": 1, "leaked": 2}
    with pytest.raises(ValueError, match="answered \\(1\\), leaked \\(2\\)"):
        packs.refuse(report)
    assert not [r for r in packs.outgoing_checks(make([]), make([]), spark.createDataFrame([], "task string, source string"), ["payload"], ["note"], "x").collect() if r["violations"]]
    back = [("t1", 1, "p", "-", "yes"), ("t1", 1, "p", "-", "yes"), ("t2", 5, "Q", "-", "maybe"), ("t8", 1, "p", "-", None)]
    got = {r["check_name"]: r["violations"] for r in packs.returned_checks(make(a), make(back), ["payload"], ["yes", "no"]).collect()}
    assert got == {"repeated": 1, "lost": 1, "added": 1, "moved": 1, "frozen": 1, "unanswered": 0, "not_allowed": 1}
