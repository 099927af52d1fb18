"""Sources, sinks, streams and user functions on real files."""

import datetime
import decimal
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.functions import masks
from symloom.operators import plugins, shapes
from symloom.session import ROWS_PER_TASK_KEY, ensure_checkpoint_dir
from symloom.sources import containers, disassembly
from symloom.streaming import flows

FILES = {
    "types/Shape.smali": ".class public interface abstract Lp/Shape;\n.super Ljava/lang/Object;\n\n.method public abstract area()D\n.end method\n",
    "types/Box.smali": (
        ".class public final Lp/Box;\n.super Ljava/lang/Object;\n.implements Lp/Shape;\n.source \"Box.java\"\n\n"
        ".field private final w:D\n\n"
        ".method public set(I)V\n    .registers 3\n    const/4 v0, -0x1\n    packed-switch p1, :pswitch_data_9\n    :pswitch_2\n    return-void\n    :pswitch_data_9\n"
        "    .packed-switch 0x0\n        :pswitch_2\n    .end packed-switch\n.end method\n\n"
        ".method public set(J)V\n    .registers 4\n    :try_start_0\n    invoke-virtual {p0, p1, p2}, Lp/Box;->put(J)V\n    :try_end_3\n    .catchall {:try_start_0 .. :try_end_3} :catchall_3\n"
        "    :catchall_3\n    move-exception v0\n    throw v0\n.end method\n"
    ),
    "types/Outer$In.smali": ".class Lp/Outer$In;\n.super Ljava/lang/Object;\n",
    "enums/Kind.smali": ".class public final enum Lp/Kind;\n.super Ljava/lang/Enum;\n\n.field public static final enum A:Lp/Kind;\n",
    "bad/Broken.smali": ".class public Lp/Broken;\n.super Ljava/lang/Object;\n\n.method static x()V\n    # <error rendering method: bad opcode>\n.end method\n",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("smali")
    for name, body in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(body)
    return disassembly.read_disassembly(spark, str(root))


def test_classes_and_fields(tables):
    got = {r.cls: (r.flags, r.super, r.interfaces, r.source_file) for r in tables["class"].collect()}
    assert got["p.Box"] == (0x11, "java.lang.Object", ["p.Shape"], "Box.java")
    assert got["p.Shape"][0] == 0x601 and got["p.Kind"][0] == 0x4011 and got["p.Outer$In"][0] == 0
    assert {(r.cls, r.name, r.type, r.flags) for r in tables["field"].collect()} == {("p.Box", "w", "D", 0x12), ("p.Kind", "A", "Lp/Kind;", 0x4019)}


def test_methods_and_instructions(tables):
    methods = {r.method_key: r for r in tables["method"].collect()}
    assert set(methods) == {"app/p.Shape->area()D", "app/p.Box->set(I)V", "app/p.Box->set(J)V", "app/p.Broken->x()V"}
    assert methods["app/p.Broken->x()V"].error == "bad opcode" and not methods["app/p.Shape->area()D"].has_code
    insns = [(r.method_key, r.off, r.op, r.regs, r.literal, r.target, r.ref) for r in tables["insn"].orderBy("method_key", "off").collect()]
    assert insns == [
        ("app/p.Box->set(I)V", 0, "const/4", [0], -1, None, None),
        ("app/p.Box->set(I)V", 1, "packed-switch", [2], None, 3, None),
        ("app/p.Box->set(I)V", 2, "return-void", [], None, None, None),
        ("app/p.Box->set(J)V", 0, "invoke-virtual", [1, 2, 3], None, None, "Lp/Box;->put(J)V"),
        ("app/p.Box->set(J)V", 1, "move-exception", [0], None, None, None),
        ("app/p.Box->set(J)V", 2, "throw", [0], None, None, None),
    ]
    tries = [(r.start_off, r.end_off, [tuple(h) for h in r.handlers]) for r in tables["try_range"].collect()]
    assert tries == [(0, 0, [(None, 1)])]
    assert [(r.method_key, r.off, r.target) for r in tables["switch"].collect()] == [("app/p.Box->set(I)V", 1, 2)]


def test_archives(spark, tmp_path):
    names = {"bundle.apks": ["base.apk", "split.apk"], "app.apk": ["classes.dex"], "evil.zip": ["a/../../x", "ok"], "m.xapk": ["manifest.json", "a.apk"]}
    for file, entries in names.items():
        with zipfile.ZipFile(tmp_path / file, "w") as z:
            for e in entries:
                z.writestr(e, '{"split_apks": 1}' if e == "manifest.json" else "12345")
    (tmp_path / "raw.bin").write_bytes(b"dex\n035\x00")
    (tmp_path / "torn.zip").write_bytes(b"PK\x03\x04torn")
    files = containers.read_files(spark, str(tmp_path))
    entries = containers.list_entries(files)
    listed = sorted((r.archive.rsplit("/", 1)[-1], r.pos, r.name, r.usize) for r in entries.collect())
    assert ("bundle.apks", 1, "split.apk", 5) in listed and len(listed) == 8
    assert [r.archive.rsplit("/", 1)[-1] for r in entries.filter("error IS NOT NULL").collect()] == ["torn.zip"]
    text = F.when(F.col("name") == "manifest.json", '{"split_apks": 1}')
    routed = {r.path.rsplit("/", 1)[-1]: r.format for r in containers.route_inputs(files, entries.withColumn("text", text)).collect()}
    assert routed == {"bundle.apks": "apks", "app.apk": "zip", "evil.zip": "zip", "m.xapk": "xapk", "raw.bin": "dex", "torn.zip": "zip"}
    guarded = {(r.archive.rsplit("/", 1)[-1], r.name): r.refusal for r in containers.guard_entries(entries).collect()}
    assert guarded[("evil.zip", "ok")] == "unsafe_archive" and guarded[("app.apk", "classes.dex")] is None
    assert guarded[("torn.zip", None)] == "unreadable_archive"


def test_guard_limits(spark):
    rows = [("a", i, n, 10) for i, n in enumerate(["x", "a\\b", "/abs", "C:/d", "p/../q", "..x"])]
    df = spark.createDataFrame(rows, "archive string, pos int, name string, usize long")
    for split in (False, True):
        got = [(r.clean, r.refusal) for r in containers.guard_entries(df, max_total_bytes=55, reject_unsafe=False, split=split).orderBy("pos").collect()]
        assert got == [("x", None), ("a/b", None), (None, "unsafe_name"), (None, "unsafe_name"), (None, "unsafe_name"), ("..x", "archive_too_large")]
    assert {r.refusal for r in containers.guard_entries(df, max_entries=5).collect()} == {"too_many_entries"}


def test_id_map_and_export(spark, tmp_path):
    (tmp_path / "map.txt").write_text("1010000=attr/theme\n\nbad\nzz=x\n7f000001=a=b\n=c\nffffffff=too/big\n")
    got = {r.id: r.name for r in containers.read_id_map(spark, str(tmp_path / "map.txt")).collect()}
    assert got == {0x01010000: "attr/theme", 0x7F000001: "a=b"}
    units = spark.createDataFrame([("p.q.A", "code", None), ("B", None, "boom")], "full string, code string, error string")
    containers.export_units(units, str(tmp_path / "out"), "parquet", "kotlin")
    containers.export_units(units, str(tmp_path / "folders"), "json", by_package=True)
    assert (tmp_path / "folders" / "package=p.q").is_dir()
    rows = {r.path: (r.package, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"p/q/A.kt": ("p.q", "code"), "B.kt": ("", "// could not export 'B': boom\n")}


def write_batches(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{i}")


def stream(spark, folder, schema):
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").parquet(folder)
    )


def test_first_wins_over_batches(spark, tmp_path):
    schema = "cls string, ord int, body string"
    write_batches(spark, f"{tmp_path}/in", [[("A", 0, "a0"), ("B", 1, "b1"), ("A", 2, "a2")], [("B", 3, "b3"), ("C", 4, "c4")], [("C", 5, "c5"), (None, 6, "n6"), (None, 7, "n7")]], schema)
    flows.stream_first_wins(stream(spark, f"{tmp_path}/in", schema), ["cls"], ["ord"], f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    kept = {r.cls: r.body for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()}
    assert set(kept) == {"A", "B", "C", None} and kept["A"] == "a0"
    dropped = spark.read.parquet(f"{tmp_path}/out/dropped").agg(F.sum("dropped")).first()[0]
    assert dropped == 4


def test_first_wins_keeps_state_over_restarts(spark, tmp_path):
    schema = "cls string, ord int, at timestamp, tags array<string>, big decimal(20,3), body string"
    when = datetime.datetime(2020, 1, 2, 3, 4, 5, 678901)
    row = lambda c, o, b: (c, o, when, ["x", None], decimal.Decimal("12345678901234567.125"), b)
    hot = [row("hot", k, f"h{k}") for k in range(500, 100, -1)]
    rounds = [[row("A", 2, "a2"), row("A", None, "a-"), *hot], [row("B", 1, "b1"), row("hot", 1, "late")], [row("A", 0, "late"), row("C", 3, "c3")]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for n, rows in enumerate(rounds):
            spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/in/part{n}")
            for _ in range(2):  # a start without news adds nothing
                found = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
                query = flows.stream_first_wins(found, ["cls"], ["ord"], f"{tmp_path}/out", f"{tmp_path}/ck")
                query.awaitTermination()
            # only what earlier batches left in the state is read: their rows are out of the way
            read = [x for q in query.recentProgress for x in q["stateOperators"]]
            assert not read or read[-1]["numRowsTotal"] == n + 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = spark.read.parquet(f"{tmp_path}/out/rows").collect()
    assert {r["cls"]: r["body"] for r in kept} == {"A": "a-", "hot": "h101", "B": "b1", "C": "c3"}
    assert len(kept) == 4
    assert all((r["at"], r["tags"], str(r["big"])) == (when, ["x", None], "12345678901234567.125") for r in kept)
    assert spark.read.parquet(f"{tmp_path}/out/dropped").agg(F.sum("dropped")).first()[0] == 402


def test_first_wins_asks_no_function_per_key(spark, tmp_path):
    """The state of keys is Spark's own; order columns may be structs."""
    schema = "cls string, at struct<a: int, b: int>, body string"
    write_batches(spark, f"{tmp_path}/in", [[("A", (1, 2), "a12"), ("A", (1, None), "a1-"), ("A", None, "a-")], [("A", None, "late"), ("B", (2, 1), "b")]], schema)
    query = flows.stream_first_wins(stream(spark, f"{tmp_path}/in", schema), ["cls"], ["at"], f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination()
    assert {s["operatorName"] for p in query.recentProgress for s in p["stateOperators"]} == {"dedupe"}
    assert {len(p["sources"]) for p in query.recentProgress} == {1}
    rows = spark.read.parquet(f"{tmp_path}/out/rows")
    assert rows.columns == ["cls", "at", "body", "key_digest", "batch"]
    dropped = spark.read.parquet(f"{tmp_path}/out/dropped").agg(F.sum("dropped")).first()[0]
    assert rows.count() == 2 and dropped == 3
    bodies = {r["cls"]: r["body"] for r in rows.collect()}
    assert bodies["A"] in ("a-", "late") and bodies["B"] == "b"


def test_search_and_scoreboard_over_batches(spark, tmp_path):
    schema = "unit string, code string"
    write_batches(spark, f"{tmp_path}/in", [[("a", "x foo\ny"), ("b", None)], [("c", "Foo\nfoo")]], schema)
    flows.stream_search(stream(spark, f"{tmp_path}/in", schema), "foo", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert {(r.unit, r.line) for r in spark.read.parquet(f"{tmp_path}/out/matches").collect()} == {("a", 1), ("c", 1), ("c", 2)}
    assert tuple(spark.read.parquet(f"{tmp_path}/out/counts").agg(F.sum("scanned"), F.sum("failed")).first()) == (3, 1)
    sig = "struct<no_error:boolean,recompiles:boolean,exec:boolean>"
    schema = f"sample string, category string, ref {sig}, cand {sig}"
    good, bad = (True, True, None), (False, True, None)
    write_batches(spark, f"{tmp_path}/sc", [[("1", "c", good, good)], [("2", "c", good, bad), ("3", "c", good, good)]], schema)
    board = flows.stream_scoreboard(stream(spark, f"{tmp_path}/sc", schema))
    last = {}
    q = board.writeStream.outputMode("update").foreachBatch(
        lambda df, _: last.update({r.verdict: r.n for r in df.collect()})
    ).option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert last == {"PARITY": 2, "REGRESSION": 1}


def test_readers(spark):
    readers = plugins.Readers()
    readers.register_reader("a", lambda f: f.filter("path < 2").withColumn("v", F.lit("a")))
    readers.register_reader("b", lambda f: f.filter("path < 4").withColumn("v", F.lit("b")))
    with pytest.raises(ValueError):
        readers.register_reader("a", lambda f: f)
    got = {r.path: (r.reader, r.v) for r in readers.load(spark.range(6).withColumnRenamed("id", "path")).collect()}
    assert got == {0: ("a", "a"), 1: ("a", "a"), 2: ("b", "b"), 3: ("b", "b")}


def test_guarded_groups(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("big", 1), ("big", 2), ("big", 3)], "k string, v int")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("s", T.LongType())])

    def total(g: pd.DataFrame) -> pd.DataFrame:
        if g["k"].iloc[0] == "b":
            raise RuntimeError("no b")
        return pd.DataFrame({"k": [g["k"].iloc[0]], "s": [g["v"].sum()]})

    got = {r.k: (r.s, r.error) for r in plugins.guarded_apply(df, ["k"], total, schema).collect()}
    assert got == {"a": (1, None), "b": (None, "RuntimeError: no b"), "big": (6, None)}
    # groups are computed whatever their size
    spark.conf.set(ROWS_PER_TASK_KEY, "2")
    try:
        assert {r.k for r in plugins.guarded_apply(df, ["k"], total, schema).filter("error is null").collect()} == {"a", "big"}
        sums = plugins.map_methods(df.filter("k <> 'b'").withColumnRenamed("k", "method_key"), lambda g: total(g.rename(columns={"method_key": "k"})), schema)
        assert {(r.k, r.s) for r in sums.collect()} == {("a", 1), ("big", 6)}
    finally:
        spark.conf.unset(ROWS_PER_TASK_KEY)


def test_long_literals(spark):
    big = "x" * 1_000_000
    units = spark.createDataFrame([("u", f'a = "{big}\\"{big}" + \'{big}\' + 1{"e+" * 5}')], "unit string, code string")
    got = {r["kind"]: r["n"] for r in shapes.token_profile(units).collect()}
    assert got["string"] == 2 and got["number"] == 1
    body = f'.class public Lp/A;\n.super Ljava/lang/Object;\n.method public f()V\n    .registers 2\n    const-string v0, "{big}"\n    return-void\n.end method\n'
    files = spark.createDataFrame([("a", "A.smali", body)], "app_id string, input_file string, text string")
    assert disassembly.parse_disassembly(files)["insn"].count() == 2


def test_long_numbers(spark):
    lines = spark.createDataFrame([("00007f010001=a/c",), ("ffffffffffffffffff=a/d",), ("0=a/e",)], "value string")
    assert {(r["id"], r["name"]) for r in containers.parse_id_map(lines).collect()} == {(0x7F010001, "a/c"), (0, "a/e")}
    text = spark.createDataFrame([("9223372036854775807",), ("9223372036854775808",)], "t string")
    got = [bool(r[0] & masks.KIND_BITS["long"]) for r in text.select(masks.kinds_of_text(F.col("t"))).collect()]
    assert got == [True, False]


def test_checkpoint_folder_of_the_session_is_kept(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
