"""Names: distributed forms against giving names one by one."""

import random

import pytest
from pyspark.sql import functions as F

from symloom.functions import names
from symloom.operators import naming
from symloom.plans.bounded import NAMING_ROWS_KEY
from symloom.session import ROWS_PER_TASK_KEY


def greedy_alloc(rows, prefix):
    out = {}
    for scope in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == scope), key=lambda r: r[1])
        used, n = {r[2] for r in mine if not r[3]}, 0
        for r in mine:
            if r[3]:
                n += 1
                while f"{prefix}{n:04d}" in used:
                    n += 1
                out[(scope, r[1])] = f"{prefix}{n:04d}"
    return out


@pytest.mark.parametrize("seed,limit", [(1, None), (2, "10")])
def test_allocate_equals_greedy(spark, seed, limit):
    rnd = random.Random(seed)
    rows = []
    for i in range(200):
        keep = rnd.random() < 0.4
        name = rnd.choice([f"C{rnd.randrange(1, 40):04d}", f"C{rnd.randrange(1, 40)}", "Named", "C00007"]) if keep else "a"
        rows.append((rnd.choice(["p", "p", "p", "q"]), i, name, not keep))
    df = spark.createDataFrame(rows, "scope string, ord int, name string, renamable boolean")
    if limit:
        spark.conf.set(ROWS_PER_TASK_KEY, limit)
        spark.conf.set(NAMING_ROWS_KEY, limit)
    try:
        got = {(r.scope, r.ord): r.alias for r in naming.allocate_names(df, ["scope"], ["ord"], "C").collect()}
    finally:
        spark.conf.unset(ROWS_PER_TASK_KEY)
        spark.conf.unset(NAMING_ROWS_KEY)
    assert got == greedy_alloc(rows, "C")


def test_allocate_works_its_symbols_out_once(spark):
    made = spark.sparkContext.accumulator(0)

    def name_of(k):
        made.add(1)
        return f"C{k:04d}" if k % 3 else "a"

    named = F.udf(name_of, "string")("ord")
    rows = spark.range(60).select(F.lit("p").alias("scope"), F.col("id").alias("ord"), named.alias("name"))
    symbols = rows.distinct().withColumn("renamable", F.length("name") == 1)
    got = {r.ord: r.alias for r in naming.allocate_names(symbols, ["scope"], ["ord"], "C").collect()}
    assert made.value == 60
    free = [f"C{k:04d}" for k in range(1, 200) if k >= 60 or k % 3 == 0]
    assert got == {k: free[k // 3] for k in range(0, 60, 3)}


def greedy_unique(rows):
    out = {}
    for scope in {r[0] for r in rows}:
        used = set()
        for r in sorted((r for r in rows if r[0] == scope), key=lambda r: r[1]):
            name, n = r[2], 2
            while name in used:
                name, n = f"{r[2]}{n}", n + 1
            used.add(name)
            out[(scope, r[1])] = name
    return out


@pytest.mark.parametrize("seed,limit", [(5, None), (6, None), (7, "15")])
def test_unique_equals_greedy(spark, seed, limit):
    rnd = random.Random(seed)
    bases = ["a", "a1", "a2", "a12", "a22", "a3", "a02", "b", "b2", "z", "z9"]
    rows = [(rnd.choice("ppq"), i, rnd.choice(bases[: rnd.choice([3, 11])])) for i in range(150)]
    df = spark.createDataFrame(rows, "scope string, ord int, base string")
    if limit:
        spark.conf.set(ROWS_PER_TASK_KEY, limit)
        spark.conf.set(NAMING_ROWS_KEY, limit)
    try:
        got = {(r.scope, r.ord): r.name for r in naming.unique_names(df, ["scope"], ["ord"], "base").collect()}
    finally:
        spark.conf.unset(ROWS_PER_TASK_KEY)
        spark.conf.unset(NAMING_ROWS_KEY)
    assert got == greedy_unique(rows)


def one_by_one(requests, symbols):
    name = {s: n for s, _, n, _ in symbols}
    scope = {s: g for s, g, _, _ in symbols}
    can = {s: r for s, _, _, r in symbols}
    out = {}
    for seq, sym, new in sorted(requests):
        if not new:
            out[seq] = "invalid"
        elif sym not in name or not can[sym]:
            out[seq] = "unrenamable"
        elif any(name[o] == new for o in name if o != sym and scope[o] == scope[sym]):
            out[seq] = "collision"
        else:
            name[sym] = new
            out[seq] = "applied"
    return out


@pytest.mark.parametrize("seed,limit", [(8, None), (9, None), (10, "20")])
def test_renames_equal_one_by_one(spark, seed, limit):
    rnd = random.Random(seed)
    symbols = [(i, rnd.choice("ppq"), f"n{rnd.randrange(12)}", rnd.random() < 0.9) for i in range(25)]
    requests = [(s, rnd.randrange(27), rnd.choice(["", *[f"n{i}" for i in range(14)]])) for s in range(160)]
    sf = spark.createDataFrame(symbols, "sym long, scope string, effective string, renamable boolean")
    rf = spark.createDataFrame(requests, "seq long, sym long, new_name string")
    if limit:
        spark.conf.set(ROWS_PER_TASK_KEY, limit)
        spark.conf.set(NAMING_ROWS_KEY, limit)
    try:
        got = {r.seq: r.outcome for r in naming.check_renames(rf, sf, ["scope"]).collect()}
    finally:
        spark.conf.unset(ROWS_PER_TASK_KEY)
        spark.conf.unset(NAMING_ROWS_KEY)
    assert got == one_by_one(requests, symbols)


def test_rename_cases(spark):
    symbols = [("A", "p", "A"), ("B", "p", "C0001"), ("C", "p", "C"), ("D", "q", "D")]
    sf = spark.createDataFrame([(*s, s[0] != "C") for s in symbols], "sym string, scope string, effective string, renamable boolean")
    requests = [
        (1, "A", ""), (2, "A", "1x"), (3, "A", "int"), (4, "A", "C"), (5, "D", "A"), (6, "A", "Named"),
        (7, "B", "Named"), (8, "B", "A"), (9, "C", "x"), (10, "A", "a-b"), (11, "gone", "y"), (12, "A", "Named"),
    ]
    rf = spark.createDataFrame(requests, "seq long, sym string, new_name string")
    got = {r.seq: (r.outcome, r.reason) for r in naming.check_renames(rf, sf, ["scope"]).collect()}
    assert got == {
        1: ("invalid", "empty"), 2: ("invalid", "bad_start"), 3: ("invalid", "reserved"), 4: ("collision", None),
        5: ("applied", None), 6: ("applied", None), 7: ("collision", None), 8: ("applied", None),
        9: ("unrenamable", None), 10: ("invalid", "bad_char"), 11: ("unrenamable", None), 12: ("applied", None),
    }


def test_identifier_functions(spark):
    words = ["", "a", "ab", "abc", "a1", "$", "a-", "<init>", "1x", "class", "_", "a b", "x.y"]
    df = spark.createDataFrame([(w,) for w in words], "n string")
    n = F.col("n")
    got = {
        r.n: (r.o, r.s) for r in df.select("n", names.is_obfuscated(n).alias("o"), names.sanitize_identifier(n).alias("s")).collect()
    }
    assert [w for w in words if got[w][0]] == ["a", "ab", "a1", "$", "1x", "_"]
    assert got["1x"][1] == "_1x" and got["class"][1] == "classWord" and got["_"][1] == "_Word" and got[""][1] == "_Word"
    assert got["a b"][1] == "a_b" and got["abc"][1] == "abc"


def test_class_rename_candidates(spark):
    rows = [("a", 0, True, True), ("b", 0x4000, True, True), ("c", 0x2000, True, True), ("d", 0, False, True), ("e", 0, True, False), ("f$", 0, True, True)]
    df = spark.createDataFrame(rows, "n string, flags int, leaf boolean, top boolean")
    ok = naming.renamable_class(F.col("flags"), F.col("n"), F.col("leaf"), F.col("top"), names.is_obfuscated(F.col("n")))
    assert [r.n for r in df.filter(ok).collect()] == ["a"]


def test_comments(spark):
    log = [(1, "x", "  hi \n"), (2, "y", "a"), (3, "y", " "), (4, "x", "hi"), (5, "z", "1"), (6, "z", ""), (7, "z", "two\nlines")]
    df = spark.createDataFrame(log, "seq long, sym string, text string")
    got = {r.sym: (r.text, r.changed, r.listed_at) for r in naming.latest_edits(df).collect()}
    assert got == {"x": ("hi", False, 1), "z": ("two\nlines", True, 7)}
    moved = {r.seq: r.changed for r in naming.edit_changes(df).collect()}
    assert moved == {1: True, 2: True, 3: True, 4: False, 5: True, 6: True, 7: True}


def test_outer_classes(spark):
    classes = ["p.A", "p.A$B", "p.A$B$C", "p.$D", "p.E$", "p.X$Y", "p.q$r.S", "p.M", "p.N", "p.Self"]
    df = spark.createDataFrame([(c, i) for i, c in enumerate(classes)], "cls string, ord int")
    declared = spark.createDataFrame([("p.M", "p.N"), ("p.N", "p.M"), ("p.Self", "p.Self")], "cls string, outer string")
    got = {r.cls: r.outer for r in naming.resolve_outer(df, declared).collect()}
    assert got["p.A$B"] == "p.A" and got["p.A$B$C"] == "p.A$B"
    assert got["p.M"] == "p.N" and got["p.N"] is None
    assert all(got[c] is None for c in ("p.A", "p.$D", "p.E$", "p.X$Y", "p.q$r.S", "p.Self"))


def test_base_archives(spark):
    rows = [("b", n) for n in ("split_config.en.apk", "feature.apk", "x/base.apk", "base-master.apk")] + [("c", "config.x.apk"), ("c", "app.apk")]
    df = spark.createDataFrame(rows, "bundle string, archive string")
    got = {(r.bundle, r.load_order): r.archive for r in naming.base_first(df).collect()}
    assert got[("b", 1)] == "x/base.apk" and got[("b", 2)] == "base-master.apk" and got[("c", 1)] == "app.apk"


def test_imports_of_nested_classes(spark):
    rows = [("u", "own", f, i) for i, f in enumerate(["p.A$B", "q.A$C", "p.A", "p.D$1", "p.D$E$2", "own.F$G", "H$I", "java.lang.J$K"])]
    uses = spark.createDataFrame(rows, "unit string, own_package string, full string, seq int")
    got = {r["full"]: (r.display, r.imported) for r in naming.import_claims(uses).collect()}
    assert got == {
        "p.A$B": ("A.B", True), "q.A$C": ("q.A.C", False), "p.A": ("A", True), "p.D$1": ("D$1", True),
        "p.D$E$2": ("D.E$2", True), "own.F$G": ("F.G", False), "H$I": ("H.I", False), "java.lang.J$K": ("J.K", False),
    }
