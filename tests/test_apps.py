"""Two apps with equal names, the stored index, and workers that know no folder of the driver."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from symloom.operators import graph, naming, positions, search, shapes, xref
from symloom.plans.apps import has_app

SYM = "struct<kind:string,owner:string,name:string,params:array<string>>"


def test_hierarchies_stay_in_their_app(spark):
    rows = [("a", "Dog", "Animal", []), ("a", "Animal", None, []), ("a", "Cat", "Animal", []), ("b", "Dog", "Robot", ["Cute"]), ("b", "Robot", None, []), ("b", "Cat", "Robot", [])]
    classes = spark.createDataFrame([(*r, 0x10 if r[:2] == ("b", "Cat") else 0) for r in rows], "app_id string, cls string, super string, interfaces array<string>, flags int")
    closed = graph.closure(graph.supertype_edges(classes))
    got = {(r["app_id"], r["cls"], r["anc"]): (r["depth"], r["path"]) for r in closed.collect()}
    assert got == {
        ("a", "Dog", "Animal"): (1, [0]), ("a", "Cat", "Animal"): (1, [0]), ("b", "Dog", "Robot"): (1, [0]), ("b", "Dog", "Cute"): (1, [1]), ("b", "Cat", "Robot"): (1, [0]),
    }
    whole = graph.with_object(closed, classes)
    assert whole.filter(F.col("anc") == graph.OBJECT).count() == 6
    pairs = spark.createDataFrame([("a", "Dog", "Animal"), ("b", "Dog", "Animal"), ("b", "Dog", "Cat"), ("a", "Dog", "Cat")], "app_id string, sub string, sup string")
    found = {(r["app_id"], r["sub"], r["sup"]): r["relation"] for r in graph.subtype(pairs, whole, classes).collect()}
    assert found == {("a", "Dog", "Animal"): "yes", ("b", "Dog", "Animal"): "unknown", ("b", "Dog", "Cat"): "no", ("a", "Dog", "Cat"): "no"}
    both = spark.createDataFrame([("a", "Dog", "Cat"), ("b", "Dog", "Cat")], "app_id string, a string, b string")
    assert {r["app_id"]: r["joined"] for r in graph.common_supertype(both, whole).collect()} == {"a": "Animal", "b": "Robot"}
    refs = spark.createDataFrame([("a", 1, "Dog", "run", ["I"]), ("b", 2, "Dog", "run", ["I"])], "app_id string, id int, cls string, name string, params array<string>")
    members = spark.createDataFrame(
        [("a", "Animal", "run", ["I"], 0, "a.run"), ("b", "Robot", "run", ["J"], 0, "b.run")], "app_id string, cls string, name string, params array<string>, ord int, member string"
    )
    hits = xref.resolve_member(refs, members, closed)
    assert hits.columns == [*refs.columns, "owner", "member"]
    assert {r["id"]: (r["cls"], r["owner"], r["member"]) for r in hits.collect()} == {1: ("Dog", "Animal", "a.run"), 2: ("Dog", "Robot", "b.run")}


def test_an_exact_signature_beats_a_name_and_unknown_parameters(spark):
    """Looked up per class and name, not per reference and ancestor."""
    walk = spark.createDataFrame([("C", "B", [0]), ("C", "A", [0, 0]), ("B", "A", [0])], "cls string, anc string, path array<int>")
    members = spark.createDataFrame(
        [("B", "m", None, 0, "B.m?"), ("B", "m", ["J"], 1, "B.mJ"), ("A", "m", ["I"], 0, "A.mI"), ("A", "k", [], 0, "A.k")],
        "cls string, name string, params array<string>, ord int, member string",
    )
    refs = [("C", "m", ["I"]), ("C", "m", ["I"]), ("C", "m", ["J"]), ("C", "m", ["Z"]), ("B", "k", ["I"]), ("A", "m", ["J"]), ("C", "none", [])]
    found = xref.resolve_member(spark.createDataFrame(refs, "cls string, name string, params array<string>"), members, walk)
    got = sorted((r.cls, r.name, *r.params, r.owner, r.member) for r in found.collect())
    assert got == [
        ("A", "m", "J", "A", "A.mI"), ("B", "k", "I", "A", "A.k"), ("C", "m", "I", "A", "A.mI"), ("C", "m", "I", "A", "A.mI"),
        ("C", "m", "J", "B", "B.mJ"), ("C", "m", "Z", "B", "B.m?"), ("C", "none", None, None),
    ]


def test_either_all_tables_have_an_app_or_none(spark):
    one, other = spark.createDataFrame([("a", 1)], "app_id string, x int"), spark.createDataFrame([(1,)], "x int")
    assert has_app(one) and not has_app(other, other)
    with pytest.raises(ValueError, match="app_id"):
        has_app(one, other)


def test_outers_rollups_and_data_classes_by_app(spark):
    classes = spark.createDataFrame(
        [("a", "p.A$B", 1), ("a", "p.A", 0), ("b", "p.A$B", 0), ("b", "x.Y", 1), ("c", "k.L", 0), ("c", "k.M", 1)], "app_id string, cls string, ord int"
    )
    declared = spark.createDataFrame([("b", "p.A$B", "x.Y"), ("c", "k.L", "k.M"), ("c", "k.M", "k.L")], "app_id string, cls string, outer string")
    got = {(r["app_id"], r["cls"]): r["outer"] for r in naming.resolve_outer(classes, declared).collect()}
    assert got == {("a", "p.A$B"): "p.A", ("a", "p.A"): None, ("b", "p.A$B"): "x.Y", ("b", "x.Y"): None, ("c", "k.L"): "k.M", ("c", "k.M"): None}
    tops = spark.createDataFrame([("a", "x", "x"), ("b", "x", "t")], "app_id string, node string, top string")
    errors = spark.createDataFrame([("a", "x", 2), ("b", "x", 5)], "app_id string, cls string, errors int")
    assert {(r["app_id"], r["top"]): r["errors"] for r in shapes.error_rollup(errors, tops).collect()} == {("a", "x"): 2, ("b", "t"): 5}
    oks = spark.createDataFrame([("a", "x", True), ("b", "x", False)], "app_id string, cls string, ok boolean")
    assert {(r["app_id"], r["top"]): r["ok"] for r in shapes.fully_structured(oks, tops).collect()} == {("a", "x"): True, ("b", "t"): False}

    obj, text = "Ljava/lang/Object;", "Ljava/lang/String;"
    body = [("<init>", ["I"], "V"), ("component1", [], "I"), ("equals", [obj], "Z"), ("hashCode", [], "I"), ("toString", [], text), ("copy", ["I"], "Lp/D;")]
    methods = [("a", "p.D", *m, k) for k, m in enumerate(body)] + [("b", "p.D", *m, k) for k, m in enumerate(body[:-1])]
    methods += [("c", "p.D", *(("component10000000000", [], "I") if m[0] == "component1" else m), k) for k, m in enumerate(body)]
    frames = [
        spark.createDataFrame([(x, "p.D", 0x10) for x in "abc"], "app_id string, cls string, flags int"),
        spark.createDataFrame([(x, "p.D", "I", 0, 2) for x in "abc"], "app_id string, cls string, type string, ord int, flags int"),
        spark.createDataFrame(methods, "app_id string, cls string, name string, params array<string>, ret string, ord int"),
    ]
    assert [tuple(r) for r in shapes.data_classes(*frames).collect()] == [("a", "p.D")]
    bare = [f.filter("app_id = 'a'").drop("app_id") for f in frames]
    assert [tuple(r) for r in shapes.data_classes(*bare).collect()] == [("p.D",)]


def test_positions_and_index_by_app(spark):
    units = spark.createDataFrame([("a", "U", "one\ntwo foo\n"), ("b", "U", "foo bar\n\nfoo")], "app_id string, unit string, code string")
    starts = {(r["app_id"], r["unit"], r["line"]): r["start_off"] for r in positions.line_starts(units).collect()}
    assert starts[("a", "U", 2)] == 4 and starts[("b", "U", 3)] == 9
    spans = {(r["app_id"], r["start"]) for r in search.match_spans(units, "foo").collect()}
    assert spans == {("a", 8), ("b", 0), ("b", 9)}
    sym = lambda owner, kind="class", name="n": (kind, owner, name, [])
    rows = [("a", "U", 0, "def", sym("m", "method")), ("a", "U", 8, "ref", sym("Foo")), ("b", "U", 0, "ref", sym("Foo")), ("b", "U", 9, "ref", sym("Bar"))]
    annots = spark.createDataFrame(rows, f"app_id string, unit string, off int, kind string, sym {SYM}")
    index = xref.usage_index(annots, units)
    got = {(r["app_id"], r["target"]["owner"], r["from_unit"], r["off"]): (r["line"], r["from_member"] and r["from_member"]["owner"]) for r in index.collect()}
    assert got == {("a", "Foo", "U", 8): (2, "m"), ("b", "Foo", "U", 0): (1, None), ("b", "Bar", "U", 9): (3, None)}
    clicks = spark.createDataFrame([(1, "a", "U", 2, "foo", None), (2, "b", "U", 3, "foo", None)], "click int, app_id string, unit string, line int, token string, hint string")
    assert {r["click"]: r["sym"]["owner"] for r in xref.symbol_at(annots, units, clicks).collect()} == {1: "Foo", 2: "Bar"}


def test_a_stored_index_is_read_by_bucket(spark, tmp_path):
    rows = [((("class", f"C{k % 500}", "n", ["I"] if k % 2 else None)), f"u{k % 7}", k) for k in range(4000)]
    usages = spark.createDataFrame(rows, f"target {SYM}, from_unit string, off int")
    xref.write_usage_index(usages, "stored_usages", str(tmp_path / "index"), buckets=16)
    try:
        symbol = F.struct(F.lit("class").alias("kind"), F.lit("C8").alias("owner"), F.lit("n").alias("name"), F.lit(None).cast("array<string>").alias("params"))
        found = xref.usages_of(spark, "stored_usages", symbol)
        assert sorted(r["off"] for r in found.collect()) == [k for k in range(4000) if k % 500 == 8]
        # files of other buckets are left out either way; the plan only says so where it keeps the buckets apart
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        plan = xref.usages_of(spark, "stored_usages", symbol)._jdf.queryExecution().toString()
        assert "SelectedBucketsCount: 1 out of 16" in plan and "PushedFilters: [IsNotNull(key), EqualTo(key" in plan
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.sql("DROP TABLE stored_usages")


def test_workers_get_the_package(tmp_path):
    """From another folder, with the repository on the driver's path only."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.warehouse.dir', {str(tmp_path)!r}).getOrCreate())
import __spark_entry__ as entry
rows = entry.queries()['reachable_blocks'](spark, '/root/testdata/sf0.001').count()
print('ROWS', rows)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
    assert int(done.stdout.rsplit("ROWS", 1)[1]) > 0
