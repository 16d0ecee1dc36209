"""Matching, assignment and samples under budgets against brute force."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import arms, bipartite


def most(edges):
    """Size of a maximum matching, by augmenting one path after the other."""
    near, own = {}, {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)

    def augment(u, seen):
        for v in near[u] - seen:
            seen.add(v)
            if v not in own or augment(own[v], seen):
                own[v] = u
                return True
        return False

    return sum(augment(u, set()) for u in near)


@pytest.mark.parametrize("edges", [
    [(1, 1), (1, 2), (2, 1)],  # a greedy pass may take (1, 1) and stop
    [(1, 7), (2, 7), (3, 7), (3, 8)],  # two targets, one partner
    [(1, 1), (1, 1), (None, 1), (2, None)],
    [(i, i + k) for i in range(9) for k in (0, 1)] + [(9, 0)],  # one long alternating path
    [(random.Random(i).randrange(30), random.Random(i + 999).randrange(22)) for i in range(60)],
])
def test_maximum_matching_and_its_certificate(spark, edges):
    m = bipartite.maximum_matching(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    real = {e for e in edges if None not in e}
    got = [tuple(r) for r in m.pairs.select("a", "b").collect()]
    assert set(got) <= real and len({a for a, _ in got}) == len({b for _, b in got}) == len(got) == most(real)
    left, right = {r[0] for r in m.stuck_left.collect()}, {r[0] for r in m.stuck_right.collect()}
    assert {b for a, b in real if a in left} == right
    assert len(left) - len(right) == len({a for a, _ in real}) - len(got)


def test_maximum_matching_of_nothing(spark):
    m = bipartite.maximum_matching(spark.createDataFrame([], "a long, b long"), "a", "b")
    assert m.pairs.count() == m.stuck_left.count() == m.stuck_right.count() == 0


def test_least_cost_equals_enumeration(spark):
    rnd = random.Random(3)
    edges = [(s, u, v, rnd.randint(0, 9)) for s in range(4) for u in range(4) for v in rnd.sample(range(5), 3)]
    edges += [(9, 0, 0, 5), (9, 1, 0, 1), (8, 0, 0, 0), (8, 1, 1, 3), (8, 1, 1, 7), (8, 0, None, 1)]
    got = bipartite.least_cost_assignment(spark.createDataFrame(edges, "s int, a int, b int, c long"), "a", "b", "c", ("s",))
    report = {r["s"]: r for r in got.report.collect()}
    pairs = got.pairs.collect()
    for s in {e[0] for e in edges}:
        cost = {}
        for _, u, v, c in [e for e in edges if e[0] == s and e[2] is not None]:
            cost[u, v] = min(c, cost.get((u, v), c))
        us, vs = sorted({u for u, _ in cost}), sorted({v for _, v in cost})
        totals = [sum(cost[u, v] for u, v in zip(us, p)) for p in itertools.permutations(vs, len(us)) if all((u, v) in cost for u, v in zip(us, p))]
        assert report[s]["complete"] == bool(totals) and report[s]["cost"] == (min(totals) if totals else None)
        mine = [(r["a"], r["b"], r["c"]) for r in pairs if r["s"] == s]
        assert len(mine) == (len(us) if totals else 0) and all(cost[u, v] == c for u, v, c in mine) and len({v for _, v, _ in mine}) == len(mine)
    with pytest.raises(ValueError):
        bipartite.least_cost_assignment(spark.createDataFrame([(1, 1, -1)], "a int, b int, c long"), "a", "b", "c")


def test_exact_gap_negatives(spark):
    rnd = random.Random(2)
    ends = [(i, i % 5, rnd.randint(10, 16)) for i in range(30)]
    age, subject = {i: a for i, _, a in ends}, {i: s for i, s, _ in ends}
    positives = [(i, j) for i in range(30) for j in range(i + 1, 30) if subject[i] == subject[j]]
    p = spark.createDataFrame([(i, j, subject[i], subject[j], age[i], age[j]) for i, j in positives], "left int, right int, subject_left int, subject_right int, age_left int, age_right int")
    got = bipartite.exact_gap_negatives(p, spark.createDataFrame(ends, "item int, subject int, age int"), tolerance=1).collect()
    edges = set()
    for i, j in positives:
        for keep, lose in ((i, j), (j, i)):
            edges |= {((i, j), (min(keep, x), max(keep, x))) for x in age if subject[x] != subject[keep] and abs(age[x] - age[lose]) <= 1 and abs(age[x] - age[keep]) == abs(age[i] - age[j])}
    found = [((r["left"], r["right"]), (r["negative_lo"], r["negative_hi"])) for r in got if r["negative_lo"] is not None]
    assert len(got) == len(positives) and set(found) <= edges and len({e for _, e in found}) == len(found) == most(edges)


def test_profile_sample_meets_every_budget(spark):
    rnd = random.Random(4)
    rows = [(f"p{k}-{i}-{j}", k, 100 * k + i, 100 * k + j) for k in range(12) for i in range(6) for j in range(i) if rnd.random() < 0.7]
    df = spark.createDataFrame([*rows, ("x", None, 1, 2), ("y", 1, None, 2), ("z", 1, 3, 3)], "pair string, person int, a int, b int")
    for people, pairs, items in ((5, 12, 16), (12, 24, 24 + 9), (3, 3, 6)):
        got = arms.profile_sample(df, people, pairs, items).collect()
        assert len(got) == pairs and len({r["person"] for r in got}) == people and len({x for r in got for x in (r["a"], r["b"])}) == items
        assert {tuple(r) for r in got} <= set(rows)
    for people, pairs, items in ((13, 20, 40), (5, 5, 9), (5, 6, 40)):
        with pytest.raises(ValueError):
            arms.profile_sample(df, people, pairs, items).count()


def test_endpoint_pool_takes_the_majority(spark):
    rows = [(1, 2, 10, 20, "p"), (1, 3, 10, 30, "p"), (1, 4, 11, 5, "p"), (2, 5, 20, None, "p"), (6, 2, 7, 21, "q")]
    pool, conflicts = arms.endpoint_pool(spark.createDataFrame(rows, "a int, b int, age_a int, age_b int, person string"))
    assert {r["item"]: (r["age"], r["person"]) for r in pool.collect()} == {1: (10, "p"), 2: (20, "p"), 3: (30, "p"), 4: (5, "p"), 6: (7, "q")} and conflicts == 2


def test_least_reuse_spreads_partners(spark):
    targets = [(f"t{i}", 1000 + i, 1000 + i, 34) for i in range(18)] + [("far", 1, 1, 90), ("edge", 2, 2, 39), ("unknown", 3, 3, None)]
    pool = [(i, 34, i) for i in range(10, 16)] + [(20, 35, 20), (30, 40, 30), (21, 39, 2)]
    t = spark.createDataFrame(targets, "target string, anchor int, anchor_person int, age int")
    got = {r["target"]: r for r in arms.least_reuse(t, spark.createDataFrame(pool, "item int, age int, person int"), seed=1).collect()}
    assert len(got) == len(targets) and got["far"]["partner"] is None and got["unknown"]["partner"] is None
    assert got["edge"]["partner"] is None  # 40 is another bin, 21 is the anchor's own person
    uses = Counter(got[f"t{i}"]["partner"] for i in range(18))
    assert set(uses) == set(range(10, 16)) and set(uses.values()) == {3} and all(got[f"t{i}"]["error"] == 0 for i in range(18))
    # one anchor never meets a partner twice, and a partner that all depend on takes few rounds
    same = spark.createDataFrame([(f"s{i}", 5, 5, 30) for i in range(4)] + [(f"h{i}", 50 + i, 50 + i, 70) for i in range(40)], "target string, anchor int, anchor_person int, age int")
    got = arms.least_reuse(same, spark.createDataFrame([(7, 30, 7), (8, 30, 8), (9, 70, 9)], "item int, age int, person int")).collect()
    mine = [r["partner"] for r in got if r["target"].startswith("s")]
    assert sorted(x for x in mine if x is not None) == [7, 8] and mine.count(None) == 2
    hot = [r for r in got if r["target"].startswith("h")]
    assert {r["partner"] for r in hot} == {9} and max(r["round"] for r in hot) <= arms.LEVELS + 6
    assert arms.negative_only(same, spark.createDataFrame([("a", 7), ("b", None)], "target string, partner int"), spark.createDataFrame([(5,), (7,)], "item int")) == 40


def overlap_in_sequence(rows, n, used=()):
    taken, used, usage = [], set(used), Counter()
    for key, members, off in sorted(rows, key=lambda r: (r[2], r[0])):
        if members and not used & set(members) and len(taken) < n:
            taken.append((key, 0))
            used |= set(members)
            usage.update(set(members))
    rest = sorted((sum(usage[m] for m in set(members)), off, key) for key, members, off in rows if members and key not in {k for k, _ in taken})
    return taken + [(key, o) for o, _, key in rest[: n - len(taken)]]


@pytest.mark.parametrize("n", [5, 20, 45])
def test_minimum_overlap_equals_the_sequence(spark, n):
    rnd = random.Random(n)
    rows = [(i, [rnd.randrange(40) for _ in range(rnd.choice([0, 1, 2, 3]))], rnd.randint(0, 5) / 10) for i in range(70)]
    df = spark.createDataFrame([*rows, (99, None, 0.0)], "key int, members array<int>, off double")
    got = arms.minimum_overlap(df, n, "key", "members", "off").select("key", "overlap").collect()
    assert sorted(map(tuple, got)) == sorted(overlap_in_sequence(rows, n))
    got = arms.minimum_overlap(df, n, "key", "members", "off", spark.createDataFrame([(3,), (7,)], "member int")).select("key", "overlap").collect()
    assert sorted(map(tuple, got)) == sorted(overlap_in_sequence(rows, n, (3, 7)))
    with pytest.raises(ValueError):
        arms.minimum_overlap(df, 71, "key", "members", "off").count()


def test_bounded_repair(spark):
    slots = [(i, i, 10 * i, 10 * i + 1, 20 + i, i < 4) for i in range(8)]
    pool = [(100 + i, 50 + i, 500 + 2 * i, 501 + 2 * i, 24 + i % 6) for i in range(12)] + [(200, 3, 700, 701, 24), (201, 70, 10, 702, 24), (202, 71, 500, 703, 24)]
    s = spark.createDataFrame(slots, "slot int, person int, a int, b int, age_b int, broken boolean")
    p = spark.createDataFrame(pool, "row int, person int, a int, b int, age_b int")
    context = s.where("not broken").select("age_b", "person")
    got = {r["slot"]: r for r in arms.bounded_repair(s, p, F.col("p.person") != F.col("c.person"), context, ["age_b"]).collect()}
    new = [got[i]["row"] for i in range(4)]
    assert len(got) == 8 and None not in new and len(set(new)) == 4 and not any(r["broken"] for r in got.values())
    by = {r[0]: r for r in pool}
    assert all(24 <= by[r][4] <= 27 for r in new) and not set(new) & {200, 201} and not {100, 202} <= set(new)
    few = arms.bounded_repair(s, p.where("row in (104, 105)"), F.col("p.person") != F.col("c.person"), context, ["age_b"]).collect()
    assert all(r["row"] is None for r in few) and sum(r["broken"] for r in few) == 4  # ages 28 and 29 have no support
    assert sum(r["broken"] for r in arms.bounded_repair(s, p.limit(0), F.lit(True), context, ["age_b"]).collect()) == 4


def test_partial_permutation_keeps_as_few_as_possible(spark):
    rows = [("a1", 1, 11, "A", 5), ("a2", 2, 12, "A", 5), ("b1", 3, 13, "B", 5), ("c1", 4, 14, "C", 6), ("d1", 5, 15, "D", 7), ("e1", 6, 16, "E", 7), ("n", None, 9, "F", 7)]
    rnd = random.Random(8)
    rows += [(f"r{i}", 100 + i, 200 + i, rnd.choice("XYZVW"), 9) for i in range(8)]
    forbidden = [(5, 16)] + [(100 + rnd.randrange(8), 200 + rnd.randrange(8)) for _ in range(12)]
    got = arms.partial_permutation(spark.createDataFrame(rows, "row string, a int, b int, person string, age int"), spark.createDataFrame(forbidden, "lo int, hi int"), "age", start=4).collect()
    by, out = {r[0]: r for r in rows}, {r["row"]: (r["donor"], r["kept"]) for r in got}
    assert set(out) == {r[0] for r in rows if r[1]} and sorted(d for d, _ in out.values()) == sorted(out)
    pairs = {(r[1], r[2]) for r in rows}
    for row, (donor, kept) in out.items():
        assert by[row][4] == by[donor][4] and kept == (row == donor)
        if not kept:
            new = (by[row][1], by[donor][2])
            assert by[row][3] != by[donor][3] and new not in forbidden and new not in pairs
    able = lambda x, y: by[x][3] != by[y][3] and (by[x][1], by[y][2]) not in forbidden
    for age in (5, 6, 7, 9):
        mine = [r for r in out if by[r][4] == age]
        least = min(sum(x == y for x, y in zip(mine, p)) for p in itertools.permutations(mine) if all(x == y or able(x, y) for x, y in zip(mine, p)))
        assert sum(out[r][1] for r in mine) == least


def test_partial_permutation_settles_by_swaps(spark, monkeypatch):
    """Strata in which all rows can move need no auction."""
    monkeypatch.setattr(arms, "least_cost_assignment", lambda *_, **__: pytest.fail("auction"))
    rows = [(f"r{i}", i, 1000 + i, f"p{i % 7}", 5) for i in range(60)]
    got = arms.partial_permutation(spark.createDataFrame(rows, "row string, a int, b int, person string, age int"), spark.createDataFrame([], "lo int, hi int"), "age").collect()
    assert sorted(r["donor"] for r in got) == sorted(r[0] for r in rows) and not any(r["kept"] or r["donor"] == r["row"] for r in got)
