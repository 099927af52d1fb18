"""Fixpoints that double or contract, on long chains and random graphs, against plain loops."""

import collections
import random

import pytest

from symloom.operators import graph, positions
from symloom.plans import fixpoint


@pytest.fixture
def cuts(monkeypatch):
    """Counts the rounds: every one writes its state at least once."""
    seen = []
    for module in (graph, positions, fixpoint):
        plain = module.cut
        monkeypatch.setattr(module, "cut", lambda df, plain=plain: seen.append(1) or plain(df))
    return seen


def plain_sweep(nodes, uses):
    gone = set()
    while True:
        held = {u for c, u in uses if c not in gone}
        more = {n for n, r in nodes if r and n not in gone and n not in held}
        if not more:
            return {n for n, _ in nodes} - gone
        gone |= more


def sweep(spark, nodes, uses):
    kept = graph.sweep_unused(
        spark.createDataFrame(nodes, "node long, removable boolean"), spark.createDataFrame(uses, "consumer long, used long")
    )
    rows = [r["node"] for r in kept.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_sweep_of_a_long_chain(spark, cuts):
    n = 10_000
    nodes = [(k, True) for k in range(n)] + [(n, False), (n + 1, True), (n + 2, True), (n + 3, True), (n + 4, True)]
    # a chain that hangs on nothing, one that hangs on a root, a ring with a tail
    uses = [(k, k + 1) for k in range(n - 1)] + [(n, n + 1), (n + 1, n + 2), (n + 3, n + 4), (n + 4, n + 3), (n + 4, 50), (40, 50)]
    assert sweep(spark, nodes, uses) == plain_sweep(nodes, uses)
    assert len(cuts) < 60


@pytest.mark.parametrize("seed", range(4))
def test_sweep_equals_plain_loop(spark, seed):
    rng = random.Random(seed)
    n = 120
    nodes = [(k, rng.random() < 0.93) for k in range(n)]
    uses = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * (0.7 + 0.2 * seed)))]
    # mostly forward, so that much can go
    uses = [(min(p), max(p)) if rng.random() < 0.95 else p for p in uses]
    assert sweep(spark, nodes, uses) == plain_sweep(nodes, uses)


def plain_throws(direct, calls, caught, subs):
    def stops(m, e):
        return any(c == e or c in subs.get(e, ()) or c in graph.CATCH_EVERYTHING for c in caught.get(m, ()))

    found = {(m, e) for m, e in direct if not stops(m, e)}
    todo = list(found)
    callers = collections.defaultdict(set)
    for a, b in calls:
        callers[b].add(a)
    while todo:
        m, e = todo.pop()
        for a in callers[m]:
            if (a, e) not in found and not stops(a, e):
                found.add((a, e))
                todo.append((a, e))
    return found


def throws(spark, direct, calls, caught, subs):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    closed = [(s, c) for s, ups in subs.items() for c in ups] or [("none", "none2")]
    got = graph.propagate_throws(
        frame(direct, "method string, exc string"), frame(calls, "caller string, callee string"),
        frame([(m, e) for m, own in caught.items() for e in own] or [("nobody", "none")], "method string, exc string"), frame(closed, "cls string, anc string"),
    )
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_throws_along_a_long_chain(spark, cuts):
    n = 1000
    calls = [(f"m{k}", f"m{k + 1}") for k in range(n)] + [("ring1", "ring2"), ("ring2", "ring1"), ("top", "m0"), ("other", "m0"), ("top", "ring1")]
    direct = [(f"m{n}", "A"), ("m600", "B"), ("m600", "A"), ("m300", "Sub"), ("ring1", "A"), (f"m{n}", "C")]
    caught = {"m700": ["A"], "m200": ["Base"], "m100": ["C"], "other": ["java.lang.Throwable"], "m650": ["B"], "m600": ["C"]}
    assert throws(spark, direct, calls, caught, {"Sub": ["Base"]}) == plain_throws(direct, calls, caught, {"Sub": ["Base"]})
    assert len(cuts) < 40


@pytest.mark.parametrize("seed", range(3))
def test_throws_equals_plain_loop(spark, seed):
    rng = random.Random(seed)
    names = [f"m{k}" for k in range(80)]
    calls = [(rng.choice(names), rng.choice(names)) for _ in range(60 + 25 * seed)]
    calls += [(names[k], names[k + 1]) for k in range(0, 60) if rng.random() < 0.8]
    direct = [(rng.choice(names), rng.choice("ABCD")) for _ in range(25)]
    caught = {m: [rng.choice(["A", "B", "Top", "java.lang.Exception"])] for m in rng.sample(names, 15)}
    subs = {"C": ["Top"], "D": ["Top"]}
    assert throws(spark, direct, calls, caught, subs) == plain_throws(direct, calls, caught, subs)


def test_cycles_of_pointers(spark, cuts):
    rows = [(k, k + 1) for k in range(3000)] + [(5000 + k, 5000 + (k + 1) % 700) for k in range(700)] + [(6000, 5010), (6001, 6000), (7000, 7000), (8000, None)]
    got = {r["node"]: r["cycle"] for r in graph.on_cycle(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert got == {5000 + k: 5000 for k in range(700)} | {7000: 7000}
    assert len(cuts) < 35
    none = graph.on_cycle(spark.createDataFrame(rows[:50], "node long, parent long"))
    assert none.collect() == []


def test_components_of_chains_stars_and_random_pairs(spark, cuts):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(3000)]
    star = [(9000 + k, 8000) for k in range(900)]
    pairs = chain + star + [(20_000 + rng.randrange(400), 20_000 + rng.randrange(400)) for _ in range(260)] + [(5, 5), (70_000, 70_000)]
    pairs += [(30_000 + k, 31_000 + rng.randrange(40)) for k in range(600)]
    rng.shuffle(pairs)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert len(cuts) < 60


def test_types_along_a_long_chain_of_moves(spark, cuts):
    n = 1000
    writes = [("m", 0, 0, "T", False, None)] + [("m", k, k, None, None, k - 1) for k in range(1, n)]
    writes += [("m", n + 5, 0, None, None, 500), ("m", n + 6, 1, None, None, 2000), ("k", 3, 1, "U", True, None), ("k", 4, 2, None, None, 1), ("k", 6, 1, None, None, 2)]
    reads = [("m", n + 10, n - 1), ("m", n + 10, 0), ("m", n + 10, 1), ("m", 0, 0), ("k", 9, 1), ("k", 4, 2), ("k", 5, 2)]
    df = spark.createDataFrame(writes, "method_key string, off int, reg int, type string, catch_all boolean, src_reg int")
    got = positions.last_known_type(df, spark.createDataFrame(reads, "method_key string, off int, reg int")).collect()
    assert {(r["method_key"], r["off"], r["reg"]): (r["type"], r["catch_all"]) for r in got} == {
        ("m", n + 10, n - 1): ("T", False), ("m", n + 10, 0): ("T", False), ("m", n + 10, 1): (None, None), ("m", 0, 0): (None, None),
        ("k", 9, 1): ("U", True), ("k", 4, 2): (None, None), ("k", 5, 2): ("U", True),
    }
    assert len(cuts) < 15
