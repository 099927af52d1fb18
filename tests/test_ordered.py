"""Ordered scans: the sliced form gives what the plain window gives."""

import random

import pytest
from pyspark.sql import functions as F

from symloom.operators import positions
from symloom.plans import intervals, ordered
from symloom.session import ROWS_PER_TASK_KEY


def rows(seed, n=400):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        # group "hot" holds most rows, one group is null
        group = rnd.choice(["hot"] * 6 + ["a", "b", None])
        out.append((group, rnd.randrange(40), i, rnd.choice([None, rnd.randrange(-5, 6)])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sliced_equals_plain(spark, seed):
    df = spark.createDataFrame(rows(seed), "g string, t int, id int, v int")
    v = F.col("v")
    outputs = {
        "n": ordered.row_number(),
        "s": ordered.running_sum(v),
        "m": ordered.running_min(v),
        "last": ordered.last_value(v),
        "last_strict": ordered.last_value(v, strict=True),
        "next": ordered.next_value(v),
        "next_strict": ordered.next_value(v, strict=True),
        "lag": ordered.lag(v),
        "lead": ordered.lead(v),
    }
    spark.conf.set(ROWS_PER_TASK_KEY, "30")
    try:
        assert ordered.needs_split(df, ["g"])
        sliced = ordered.scan(df, ["g"], ["t", "id"], outputs).collect()
    finally:
        spark.conf.unset(ROWS_PER_TASK_KEY)
    plain = ordered.scan(df, ["g"], ["t", "id"], outputs, split=False).collect()
    assert sorted(map(str, sliced)) == sorted(map(str, plain))
    assert len(plain) == 400


def test_running_values_by_hand(spark):
    df = spark.createDataFrame([("x", 1, 2), ("x", 2, None), ("x", 3, -4)], "g string, t int, v int")
    got = ordered.scan(
        df, ["g"], ["t"],
        {"s": ordered.running_sum(F.col("v")), "p": ordered.lag(F.col("v")), "q": ordered.next_value(F.col("v"), strict=True)},
        split=True,
    ).orderBy("t").collect()
    assert [(r.s, r.p, r.q) for r in got] == [(2, None, -4), (2, 2, -4), (-2, None, None)]


def test_first_row_and_kth_free(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, None)], "k string, o int, v string")
    got = {r.k: r.v for r in ordered.first_row(df, ["k"], ["o"]).collect()}
    assert got == {"a": "x", "b": None}
    want = spark.createDataFrame([("s", i) for i in range(1, 8)], "k string, i long")
    block = spark.createDataFrame([("s", n) for n in (1, 3, 4, 9, 30, 4)], "k string, r long")
    for split in (False, True):
        free = ordered.kth_free(want, block, ["k"], "i", "r", split).orderBy("i").collect()
        assert [r.free for r in free] == [2, 5, 6, 7, 8, 10, 11]


@pytest.mark.parametrize("seed", [3, 4])
def test_intervals_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    ranges = []
    for i in range(120):
        s = rnd.randrange(-300, 1000)
        ranges.append((rnd.choice("aab"), i, s, s + rnd.choice([0, 1, 3, 20, 500, 1300])))
    df = spark.createDataFrame(ranges, "g string, id long, s long, e long")
    got = sorted(map(tuple, intervals.overlapping(df, ["g"], "id", "s", "e").collect()))
    want = sorted(
        (a[0], a[1], b[1]) for a in ranges for b in ranges
        if a[0] == b[0] and a[1] < b[1] and max(a[2], b[2]) <= min(a[3], b[3])
    )
    assert got == want
    points = [(rnd.choice("ab"), rnd.randrange(-350, 2400)) for _ in range(200)]
    pf = spark.createDataFrame(points, "g string, at long")
    got = sorted((r.g, r["at"], r.id) for r in intervals.points_in_ranges(pf, df, ["g"], "at", "s", "e").collect())
    want = sorted((p[0], p[1], r[1]) for p in points for r in ranges if p[0] == r[0] and r[2] <= p[1] <= r[3])
    assert got == want


def test_interval_boundaries_and_empty(spark):
    df = spark.createDataFrame([("g", 1, 0, 5), ("g", 2, 5, 9), ("g", 3, 10, 10)], "g string, id long, s long, e long")
    assert [tuple(r) for r in intervals.overlapping(df, ["g"], "id", "s", "e").collect()] == [("g", 1, 2)]
    assert intervals.overlapping(df.limit(0), ["g"], "id", "s", "e").count() == 0


def greedy_leaders(insns, tries):
    found = set()
    for method in {r[0] for r in insns}:
        rows = sorted(r for r in insns if r[0] == method)
        found.add((method, rows[0][1]))
        found |= {(method, b[1]) for a, b in zip(rows, rows[1:]) if a[2]}
        found |= {(method, t) for r in rows for t in r[3]}
        for _, _, end, _ in (t for t in tries if t[0] == method):
            found |= {(method, r[1]) for r in [r for r in rows if end is not None and r[1] > end][:1]}
    for method, start, _, handlers in tries:
        found.add((method, start))
        found |= {(method, h[1]) for h in handlers}
    return found


@pytest.mark.parametrize("limit", [None, "10"])
def test_leaders_in_one_scan(spark, limit):
    rnd = random.Random(7)
    insns, tries = [], []
    for method in (1, 2, 3):
        for off in sorted(rnd.sample(range(200), 60)):
            insns.append((method, off, rnd.choice([True, False, False, None]), [rnd.randrange(200)] if rnd.random() < 0.1 else []))
        for _ in range(12):
            start = rnd.randrange(180)
            tries.append((method, start, rnd.choice([start, start + rnd.randrange(1, 40), None]), [("E", rnd.randrange(200))]))
    tries.append((9, 1, 5, [("E", 3)]))  # ranges of a method without rows
    left = spark.createDataFrame(insns, "method_key long, off long, terminator boolean, targets array<long>")
    right = spark.createDataFrame(tries, "method_key long, start_off long, end_off long, handlers array<struct<type: string, off: long>>")
    if limit:
        spark.conf.set(ROWS_PER_TASK_KEY, limit)
    try:
        out = positions.leaders(left, right)
        got = [(r.method_key, r.off) for r in out.collect()]
    finally:
        spark.conf.unset(ROWS_PER_TASK_KEY)
    assert len(got) == len(set(got)) and set(got) == greedy_leaders(insns, tries)
    if not limit:
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
