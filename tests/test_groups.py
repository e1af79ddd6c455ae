"""Components and the greedy choice of pairs against plain scans: chains, cliques, stars, many small groups, and limits far below them."""

import random

import pytest

from terncove.operators import dedupe
from terncove.operators.groups import components, united  # noqa: F401


def plain_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in root}


def plain_scan(pairs):
    used, out = set(), []
    for a, b in sorted(set(pairs)):
        if a not in used and b not in used:
            used |= {a, b}
            out.append((a, b))
    return out


def chain(at, n):
    return [(at + i, at + i + 1) for i in range(n)]


def clique(at, n):
    return [(at + i, at + j) for i in range(n) for j in range(i + 1, n)]


def star(at, n):
    return [(at, at + i) for i in range(1, n)]


rnd = random.Random(2)
SMALL = [(1000 + 10 * k, 1001 + 10 * k) for k in range(60)] + [(1001 + 10 * k, 1002 + 10 * k) for k in range(0, 60, 2)]
MIXED = [*chain(0, 90), *clique(200, 14), *star(400, 50), *SMALL, *{(a, b) for a, b in ((rnd.randint(2000, 2060), rnd.randint(2000, 2060)) for _ in range(90)) if a < b}]


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, one_task):
    df = spark.createDataFrame([*MIXED, (7, 7), (9999, 9999)], "a long, b long")
    got = {r.node: r.root for r in components(df, one_task).collect()}
    assert got == plain_components(MIXED)
    assert components(df.where("a < 0"), one_task).count() == 0


@pytest.mark.parametrize("scan", [20, 10**6])
def test_greedy_pairs_are_the_scan_at_every_limit(spark, scan):
    df = spark.createDataFrame([(a, b, float(b - a)) for a, b in MIXED], "left_id long, right_id long, distance_m double")
    got = dedupe.greedy_pairs(df, scan)
    assert got.columns == ["left_id", "right_id", "distance_m"]
    assert sorted((r.left_id, r.right_id) for r in got.collect()) == plain_scan(MIXED)
    assert dedupe.greedy_pairs(df.where("left_id < 0"), scan).count() == 0


def test_a_long_chain_and_a_clique_take_one_round(spark, monkeypatch):
    rounds, firsts = [], dedupe._firsts
    monkeypatch.setattr(dedupe, "_firsts", lambda left: rounds.append(1) or firsts(left))
    pairs = chain(0, 1000) + clique(5000, 300)
    df = spark.createDataFrame(pairs, "left_id long, right_id long")
    assert sorted((r.left_id, r.right_id) for r in dedupe.greedy_pairs(df).collect()) == plain_scan(pairs)
    assert len(rounds) == 1


@pytest.mark.parametrize("local", [10, 10**6])
def test_components_by_any_hint(spark, local):
    from terncove.operators.groups import components_by

    rows = [(a, b, h) for k, (a, b) in enumerate(MIXED) for h in [["one", f"h{k % 3}", None][a % 3]]]
    got = [(r.node, r.root) for r in components_by(spark.createDataFrame(rows, "a long, b long, h string"), "h", local, 0).collect()]
    assert dict(got) == plain_components(MIXED) and len(got) == len(dict(got))
