"""Graph operators against small Python searches and hand-made cases."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from symloom.operators import graph
from symloom.plans.bounded import METHOD_ROWS_KEY, solve_groups
from symloom.session import cut

OBJ = graph.OBJECT


@pytest.fixture(scope="module")
def animals(spark):
    rows = [
        ("Animal", OBJ, [], 0), ("Dog", "Animal", [], 0), ("Puppy", "Dog", ["Cute"], 0x10), ("Cat", "Animal", [], 0),
        ("Alone", None, [], 0),
    ]
    classes = spark.createDataFrame(rows, "cls string, super string, interfaces array<string>, flags int")
    closed = graph.with_object(graph.closure(graph.supertype_edges(classes)), classes)
    return classes, closed.cache()


def test_closure(animals):
    _, closed = animals
    got = {(r.cls, r.anc): r.path for r in closed.collect()}
    assert got[("Puppy", "Animal")] == [0, 0] and got[("Puppy", "Cute")] == [1]
    assert ("Alone", OBJ) in got and len(got) == 10


def test_subtype(spark, animals):
    classes, closed = animals
    cases = {
        ("Puppy", "Animal"): "yes", ("Puppy", "Cute"): "yes", ("Animal", "Dog"): "no", ("Dog", "Puppy"): "no",
        ("Unknown", "Animal"): "unknown", ("Unknown", "java.lang.String"): "no", ("Dog", "Missing"): "unknown",
        ("Dog[]", "Animal[]"): "yes", ("int[]", "long[]"): "unknown", ("int[]", "int[]"): "yes", ("int[]", OBJ): "yes",
        ("int", OBJ): "unknown", ("Dog[][]", f"{OBJ}[]"): "yes", ("int[][]", f"{OBJ}[]"): "yes", ("int[]", f"{OBJ}[]"): "unknown",
    }
    pairs = spark.createDataFrame(list(cases), "sub string, sup string")
    got = {(r["sub"], r["sup"]): r.relation for r in graph.subtype(pairs, closed, classes).collect()}
    assert got == cases


def test_common_supertype(spark, animals):
    _, closed = animals
    cases = {("Dog", "Cat"): "Animal", ("Puppy", "Dog"): "Dog", ("Dog", "Puppy"): "Dog", ("java.lang.String", "Cat"): OBJ, ("Cat", "Cat"): "Cat"}
    pairs = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "pair_id int, a string, b string")
    got = {(r.a, r.b): r.joined for r in graph.common_supertype(pairs, closed).collect()}
    assert got == cases


def test_common_supertype_keeps_a_pair_one_row(spark):
    """Lists and single ancestors give the same; by lists no row per ancestor is made."""
    rng = random.Random(5)
    rows = [(k, rng.randrange(k), i) for k in range(1, 60) for i in range(rng.randrange(1, 3))]
    closed = graph.closure(spark.createDataFrame(rows, "cls long, parent long, idx int"))
    pairs = spark.createDataFrame([(rng.randrange(70), rng.randrange(70)) for _ in range(300)] + [(None, 3), (3, None)], "a long, b long")
    answers = []
    for listed in (10_000, 4, 0):
        found = graph.common_supertype(pairs, closed, root=-1, listed=listed)
        answers.append(sorted(map(str, found.select("a", "b", "joined").collect())))
        if listed == 10_000:
            assert "array_intersect" in found._jdf.queryExecution().executedPlan().toString()
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) == 302


def test_pointers_that_arrived_are_not_moved_again(spark, monkeypatch):
    rows = [(k, 5000) for k in range(1000)] + [(2001, 2002), (2002, 2003), (2003, 2001), (3000, 7)]
    written = []

    def counting(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counting)
    found = graph.terminal_targets(spark.createDataFrame(rows, "method_key long, target long"))
    got = {r.method_key: r.terminal for r in found.collect()}
    assert got == {k: 5000 for k in [*range(1000), 3000]} | {2001: None, 2002: None, 2003: None}
    assert len(got) == found.count() and sum(written) < 2 * len(rows)


def test_diamond_walk_order(spark):
    edges = [("d", "s", 0), ("d", "i", 1), ("s", "x", 1), ("i", "x", 0), ("x", "top", 0), ("s", "top", 0)]
    closed = graph.closure(spark.createDataFrame(edges, "cls string, parent string, idx int"))
    mine = sorted((r.path, r.anc, r.depth) for r in closed.collect() if r.cls == "d")
    assert mine == [([0], "s", 1), ([0, 0], "top", 2), ([0, 1], "x", 2), ([1], "i", 1)]


def test_ancestors_are_handed_down_once(spark, monkeypatch):
    """Only classes on or below a cycle are followed by rounds that compare with all pairs so far."""
    walked = []
    plain = graph.grow
    monkeypatch.setattr(graph, "grow", lambda *a, **k: walked.append(1) or plain(*a, **k))
    tree = [(k, (k - 1) // 3, 0) for k in range(1, 60)] + [(k, k // 10, 1) for k in range(10, 60)] + [(7, 7, 2)]
    looped = tree + [(100, 101, 0), (101, 100, 0), (101, 50, 1), (102, 101, 0), (102, 3, 1), (103, 59, 0)]
    for rows in (tree, looped, []):
        up = {}
        for cls, parent, idx in sorted(rows, key=lambda r: r[2]):
            if cls != parent and parent not in [p for p, _ in up.get(cls, [])]:
                up.setdefault(cls, []).append((parent, idx))
        want = {}
        for cls in up:
            depth, todo = {}, [(p, 1) for p, _ in up[cls]]
            for node, d in todo:
                if node not in depth and node != cls:
                    depth[node] = d
                    todo += [(p, d + 1) for p, _ in up.get(node, [])]
            for anc, d in depth.items():
                want[cls, anc] = d
        edges = spark.createDataFrame(rows, "cls long, parent long, idx int")
        closed = graph.closure(edges).collect()
        assert len(closed) == len(want) and {(r.cls, r.anc): r.depth for r in closed} == want
        for r in closed:
            at = r.cls
            for i in r.path:
                at = {idx: p for p, idx in up[at]}[i]
            assert at == r.anc
        assert {(r.cls, r.anc): r.depth for r in graph.ancestors(edges.select("cls", "parent")).collect()} == want
        assert bool(walked) == (rows is looped)
        walked.clear()


def test_top_ancestor_with_cycle(spark):
    rows = [(i, i - 1) for i in range(1, 40)] + [(0, None), (100, 101), (101, 102), (102, 100), (103, 100), (7000, 9999)]
    got = {r.node: r.top for r in graph.top_ancestor(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert all(got[i] == 0 for i in range(40))
    assert got[7000] == 9999 and [got[i] for i in (100, 101, 102, 103)] == [None] * 4


def random_flow(seed, methods=12, n=9):
    rnd = random.Random(seed)
    edges = set()
    for m in range(methods):
        for b in range(n - 1):
            if rnd.random() < 0.85:
                edges.add((m, b, b + 1))
        for _ in range(rnd.randrange(0, 9)):
            edges.add((m, rnd.randrange(n), rnd.randrange(n)))
    return sorted(edges)


def reach(adj, start, without=None):
    seen, todo = set(), [start] if start != without else []
    while todo:
        b = todo.pop()
        if b not in seen:
            seen.add(b)
            todo += [c for c in adj.get(b, ()) if c != without]
    return seen


@pytest.fixture(params=["inside tasks", "by rounds", "both ways"])
def way(request, spark):
    """Methods solved inside a task, by relational rounds, or some this way and some that way."""
    limit = {"inside tasks": None, "by rounds": "0", "both ways": "12"}[request.param]
    if limit is not None:
        spark.conf.set(METHOD_ROWS_KEY, limit)
    yield request.param
    spark.conf.unset(METHOD_ROWS_KEY)


@pytest.mark.parametrize("seed", [1, 2])
def test_control_flow_equals_brute_force(spark, seed, way):
    edges = random_flow(seed)
    ef = spark.createDataFrame(edges, "method_key long, src long, dst long")
    entries = spark.createDataFrame([(m, 0) for m in {e[0] for e in edges}], "method_key long, block long")
    dom = graph.dominators(ef, entries).cache()
    got_dom = set(map(tuple, dom.select("method_key", "block", "dom").collect()))
    got_idom = set(map(tuple, graph.immediate_dominators(dom).select("method_key", "block", "idom").collect()))
    got_front = set(map(tuple, graph.dominance_frontier(ef, dom).select("method_key", "block", "frontier").collect()))
    got_loop = set(map(tuple, graph.natural_loops(ef, dom).select("method_key", "header", "block").collect()))
    got_red = {r.method_key: r.reducible for r in graph.reducible(ef, dom).collect()}
    got_reach = set(map(tuple, graph.reachable(ef, entries).select("method_key", "block").collect()))
    doms, idoms, fronts, loops, red, reached = set(), set(), set(), set(), {}, set()
    for m in {e[0] for e in edges}:
        mine = [(s, d) for k, s, d in edges if k == m]
        adj, rev = {}, {}
        for s, d in mine:
            adj.setdefault(s, []).append(d)
            rev.setdefault(d, []).append(s)
        live = reach(adj, 0)
        reached |= {(m, b) for b in live}
        local = {b: {d for d in live if b not in reach(adj, 0, d)} for b in live}
        doms |= {(m, b, d) for b in live for d in local[b]}
        idoms |= {(m, b, max(local[b] - {b}, key=lambda d: len(local[d]))) for b in live if b != 0}
        fronts |= {(m, d, y) for x, y in mine if x in live for d in local[x] if not (d in local[y] and d != y)}
        back = {(s, d) for s, d in mine if s in live and d in local[s]}
        for s, h in back:
            body, todo = {h}, [s]
            while todo:
                b = todo.pop()
                if b not in body:
                    body.add(b)
                    todo += rev.get(b, [])
            loops |= {(m, h, b) for b in body}
        fwd = [e for e in mine if e not in back]
        fadj = {}
        for s, d in fwd:
            fadj.setdefault(s, []).append(d)
        red[m] = not any(s in reach(fadj, d) for s, d in fwd)
    assert got_reach == reached
    assert got_dom == doms and got_idom == idoms and got_front == fronts
    assert got_loop == loops and got_red == red


def test_post_dominators_without_exit(spark, way):
    edges = [(1, "a", "b"), (1, "a", "c"), (1, "b", "d"), (1, "c", "d"), (1, "c", "spin"), (1, "spin", "spin")]
    ef = spark.createDataFrame(edges, "method_key long, src string, dst string")
    exits = spark.createDataFrame([(1, "d")], "method_key long, block string")
    got = {(r.block, r.dom) for r in graph.dominators(ef, exits, reverse=True).collect()}
    assert got == {("d", "d"), ("b", "b"), ("b", "d"), ("c", "c"), ("c", "d"), ("a", "a"), ("a", "d")}


def test_liveness_equals_iteration(spark, way):
    rnd = random.Random(5)
    edges = random_flow(5, methods=6)
    acts = [(m, b, i, rnd.randrange(4), rnd.random() < 0.5) for m in range(6) for b in range(9) for i in range(rnd.randrange(4))]
    ef = spark.createDataFrame(edges, "method_key long, src long, dst long")
    af = spark.createDataFrame(acts, "method_key long, block long, idx int, reg int, use boolean")
    got = set(map(tuple, graph.liveness(ef, af.filter("use"), af.filter("not use")).select("method_key", "block", "reg").collect()))
    live = set()
    while True:
        new = set()
        for m in range(6):
            for b in range(9):
                out = {r for k, s, d in edges if k == m and s == b for (mm, bb, r) in live if (mm, bb) == (m, d)}
                for _, _, i, r, use in sorted((a for a in acts if a[:2] == (m, b)), key=lambda a: (a[2], a[4]), reverse=True):
                    out = out | {r} if use else out - {r}
                new |= {(m, b, r) for r in out}
        if new == live:
            break
        live = new
    assert got == live


def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_sweep_keeps_unused_cycle(spark):
    nodes = [("a", True), ("b", True), ("c", True), ("x", True), ("y", True), ("root", False), ("k", True)]
    uses = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("root", "k")]
    kept = graph.sweep_unused(
        spark.createDataFrame(nodes, "node string, removable boolean"), spark.createDataFrame(uses, "consumer string, used string")
    )
    assert {r.node for r in kept.collect()} == {"x", "y", "root", "k"}


def test_throws(spark):
    direct = [("leaf", "java.io.IOException"), ("leaf", "java.lang.IllegalStateException"), ("odd", "My"), ("cyc1", "X"), ("own", "Bad")]
    calls = [("mid", "leaf"), ("top", "mid"), ("guard", "mid"), ("all", "leaf"), ("cyc1", "cyc2"), ("cyc2", "cyc1"), ("top", "library"), ("top", "odd")]
    caught = [("guard", "java.lang.Throwable"), ("all", "Base"), ("cyc2", "X")]
    closed = spark.createDataFrame([("java.io.IOException", "Base"), ("My", "java.lang.RuntimeException")], "cls string, anc string")
    df = graph.checked_only(spark.createDataFrame(direct, "method string, exc string"), closed)
    found = graph.propagate_throws(
        df, spark.createDataFrame(calls, "caller string, callee string"), spark.createDataFrame(caught, "method string, exc string"), closed
    )
    assert set(map(tuple, found.collect())) == {
        ("leaf", "java.io.IOException"), ("mid", "java.io.IOException"), ("top", "java.io.IOException"), ("cyc1", "X"), ("own", "Bad"),
    }
    clause = {r.method: r.throws for r in graph.throws_clause(found).collect()}
    assert clause["top"] == ["java.io.IOException"]


def test_forwarder_chains(spark):
    rows = [("a", "b"), ("b", "real"), ("x", "y"), ("y", "x"), ("into", "x"), ("self", "self")]
    rows += [(f"l{i}", f"l{i + 1}") for i in range(100)]
    got = {r.method_key: r.terminal for r in graph.terminal_targets(spark.createDataFrame(rows, "method_key string, target string")).collect()}
    assert got["a"] == "real" and got["b"] == "real"
    assert [got[k] for k in ("x", "y", "into", "self")] == [None] * 4
    assert {got[f"l{i}"] for i in range(100)} == {"l100"}
    calls = spark.createDataFrame([("m", "a"), ("m", "l0"), ("m", "z")], "caller string, callee string")
    ends = spark.createDataFrame([("a", "real"), ("l0", None)], "method_key string, terminal string")
    assert {r.callee for r in graph.redirect_calls(calls, ends).collect()} == {"real", "l0", "z"}


@pytest.mark.parametrize("limits", [{}, {"together": 3}, {"listed": 4}, {"together": 0}])
def test_deepest_common_keeps_a_member_one_row(spark, limits):
    """Any hierarchy, levels that are not those of a tree, members that come twice, are null or in no class."""
    rng = random.Random(5)
    parents = {f"n{k:02}": {f"n{rng.randrange(k):02}" for _ in range(rng.choice([1, 1, 2]))} for k in range(1, 60)}
    above = {"n00": set()}
    for k in range(1, 60):
        above[f"n{k:02}"] = parents[f"n{k:02}"].union(*(above[p] for p in parents[f"n{k:02}"]))
    level = {n: rng.choice([None, 0, 1, 2, 3, 9]) for n in above if rng.random() < 0.9}
    names = [*above, "far", "other", None]
    sets = [(s, rng.choice(names[:60] if s % 4 else names)) for s in range(400) for _ in range(rng.choice([1, 2, 2, 3, 6]))]
    sets += [(900, None), (901, "far"), (901, "far"), (902, "far"), (902, "other"), (903, None), (903, "n01"), (None, "n05"), (904, "n59"), (904, "n59"), (905, "far"), (905, None)]
    members = {}
    for s, n in sets:
        members.setdefault(s, set()).add(n)
    want = {}
    for s, nodes in members.items():
        common = set.intersection(*(above.get(n, set()) | {n} for n in nodes))
        if s is not None and common:
            want[s] = None if common == {None} else max(common, key=lambda a: (level.get(a) or 0, a))
    closed = spark.createDataFrame([(c, a) for c, up in above.items() for a in up], "cls string, anc string")
    depth = spark.createDataFrame(list(level.items()), "anc string, level int")
    found = graph.deepest_common(spark.createDataFrame(sets, "set int, node string"), closed, depth, **limits)
    rows = found.collect()
    assert len(rows) == len(want) and {r.set: r.ancestor for r in rows} == want
    assert want[900] is None and want[901] == "far" and not {902, 903, 905} & set(want)
    assert "array_intersect" in found._jdf.queryExecution().executedPlan().toString()


def test_deepest_common_and_renderable(spark):
    tree = [("b", "a"), ("c", "a"), ("d", "b"), ("e", "b")]
    closed = graph.ancestors(spark.createDataFrame(tree, "cls string, parent string"))
    level = closed.groupBy(F.col("cls").alias("anc")).agg(F.max("depth").alias("level"))
    sets = spark.createDataFrame([(1, "d"), (1, "e"), (2, "d"), (2, "c"), (3, "d"), (3, "b"), (3, "d")], "set int, node string")
    assert {r.set: r.ancestor for r in graph.deepest_common(sets, closed, level).collect()} == {1: "b", 2: "a", 3: "b"}
    blocks = [("line", 0, 0, False), ("line", 1, 1, False), ("fork", 0, 0, False), ("fork", 1, 1, False), ("fork", 2, 2, False),
              ("loop", 0, 0, False), ("try", 0, 0, True), ("one", 0, 0, False)]
    edges = [("line", 0, 1), ("fork", 0, 1), ("fork", 0, 2), ("loop", 0, 0)]
    ok = graph.renderable(
        spark.createDataFrame(blocks, "method_key string, block int, ord int, is_handler boolean"),
        spark.createDataFrame(edges, "method_key string, src int, dst int"),
    )
    assert {r.method_key: r.ok for r in ok.collect()} == {"line": True, "fork": False, "loop": False, "try": False, "one": True}


def test_growth_is_the_same_when_rows_are_broadcast(spark, monkeypatch):
    from symloom.plans import fixpoint

    rnd = random.Random(11)
    edges = sorted({(rnd.randrange(60), rnd.randrange(60)) for _ in range(110)})
    ef = spark.createDataFrame(edges, "a long, b long")
    barred = spark.createDataFrame([(0, 5), (1, 7)], "s long, n long")
    allowed = spark.createDataFrame([(s, n) for s in (0, 1) for n in range(50)], "s long, n long")
    seed = spark.createDataFrame([(0, 0), (1, 1)], "s long, n long")

    def step(delta):
        return delta.join(ef, delta.n == ef.a).select("s", F.col("b").alias("n"))

    def run(shuffle_rows, broadcast_rows):
        monkeypatch.setattr(fixpoint, "SHUFFLE_ROWS", shuffle_rows)
        monkeypatch.setattr(fixpoint, "BROADCAST_ROWS", broadcast_rows)
        return set(map(tuple, fixpoint.grow(seed, step, barred=barred, allowed=allowed).collect()))

    plain = run(10**9, 0)
    assert plain == run(-1, 10**6) == run(-1, 3)
    want = set()
    for s in (0, 1):
        todo = [s]
        while todo:
            n = todo.pop()
            if (s, n) in want:
                continue
            want.add((s, n))
            todo += [b for a, b in edges if a == n and b < 50 and (s, b) not in {(0, 5), (1, 7)}]
    assert plain == want


def test_groups_above_a_union_are_whole(spark):
    """Sides of a union that have the key's partitioning and differ in size are not coalesced apart."""
    n, each = 5_000, 40
    text = F.col("id").cast("string")
    rows = spark.range(n * each).select((F.col("id") % n).alias("method_key"), text.alias("src"), F.md5(text).alias("dst"))
    ordered = Window.partitionBy("method_key").orderBy("dst")
    steps = rows.withColumn("src", F.lead("src").over(ordered)).filter("src IS NOT NULL").select("method_key", "src", "dst").distinct()
    first = rows.withColumn("at", F.row_number().over(ordered)).filter("at = 1").select("method_key", "src").distinct()
    counts = solve_groups(
        steps.unionByName(first.withColumn("dst", F.lit(""))), "method_key",
        lambda key, held: [(key, len(held), sum(r[2] == "" for r in held))], "method_key long, n long, marks long",
    )
    assert [tuple(r) for r in counts.groupBy("n", "marks").count().collect()] == [(each, 1, n)]
