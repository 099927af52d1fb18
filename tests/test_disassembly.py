"""Disassembly text as people and tools write it, against a plain reader of the same text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from symloom.sources.disassembly import annotation_values, declared_outers, parse_disassembly

TEXT = """
###### a banner with "quotes" and .method words
.class public final Lp/Outer$Inner;   # trailing words
.super Ljava/lang/Object;
\t.implements Lp/One;
.source "Outer \\"quoted\\" # no comment.java"

# annotations
.annotation system Ldalvik/annotation/EnclosingClass;
    value = Lp/Outer;
.end annotation

.annotation system Ldalvik/annotation/InnerClass;
    accessFlags = 0x9
    name = "In # ner"   # a name
.end annotation

.field private static final SEP:C = '#'
.field public final text:Ljava/lang/String; = "a = b # c"   # comment
.field private list:Ljava/util/List;
    .annotation runtime Lp/Marked;
        items = {
            .subannotation Lp/Item;
                name = "one, {two}"
                level = .enum Lp/Level;->HIGH:Lp/Level;
                tags = { "x", "y" }
            .end subannotation,
            .subannotation Lp/Item;
                name = null
                nested = { { 0x1, -2t }, { } }
            .end subannotation
        }
        owner = [Lp/Owner;
        call = Lp/A;->run(I[J)V
        flag = true
        sep = ','
    .end annotation
    .annotation build Lp/Empty;
    .end annotation
.end field
.field plain:I

.method public constructor <init>(JLjava/lang/String;)V
    .locals 2
    .param p1, "when"    # J
    .param p3    # Ljava/lang/String;
        .annotation runtime Lp/NonNull;
        .end annotation
    .end param
    .annotation system Ldalvik/annotation/Throws;
        value = {
            Ljava/io/IOException;
        }
    .end annotation
    .prologue
    .line 10
    .line 0xb
    invoke-direct {p0}, Ljava/lang/Object;-><init>()V
    const/4 v0, 1
    .local v0, "count":I
    const v1, 0xffffffff # all bits
\tconst-string v1, "it's # not, v9 \\" 0x7"
    .end local v0    # "count":I
    const-wide v0, -0x8000000000000000L
    .restart local v0
    const/16 v0, 'a'
    .local v0, null:J, "TT;"
    const/high16 v1, 0x43200000    # 160.0f
    .line 30
    invoke-polymorphic {p0, v0}, Ljava/lang/invoke/MethodHandle;->invoke([Ljava/lang/Object;)Ljava/lang/Object;, (I)V
    return-void
    .line 31
.end method

.annotation runtime Lp/Late;
.end annotation

.method abstract run(I)V
    .param p1, "unused"
.end method

.method static late()V
    .registers 1
    :here
    goto :here  # for ever
.end method
"""


@pytest.fixture(scope="module")
def tables(spark):
    return parse_disassembly(spark.createDataFrame([("a", "f.smali", TEXT.replace("\n", "\r\n"))], "app_id string, input_file string, text string"))


def test_classes_fields_methods(tables):
    (c,) = tables["class"].collect()
    assert (c["cls"], c["flags"], c["super"], c["interfaces"]) == ("p.Outer$Inner", 17, "java.lang.Object", ["p.One"])
    assert c["source_file"] == 'Outer \\"quoted\\" # no comment.java'
    fields = [(r["name"], r["type"], r["flags"], r["const"]) for r in tables["field"].orderBy("ord").collect()]
    assert fields == [("SEP", "C", 26, "'#'"), ("text", "Ljava/lang/String;", 17, '"a = b # c"'), ("list", "Ljava/util/List;", 2, None), ("plain", "I", 0, None)]
    methods = [(r["name"], r["registers"], r["has_code"], r["has_handlers"], r["ret"]) for r in tables["method"].orderBy("ord").collect()]
    assert methods == [("<init>", 6, True, False, "V"), ("run", None, False, False, "V"), ("late", 1, True, False, "V")]


def test_instructions(tables):
    rows = tables["insn"].filter("method_key LIKE '%init>(J%'").orderBy("off").collect()
    got = [(r["op"], r["regs"], r["literal"], r["ref"]) for r in rows]
    assert got == [
        ("invoke-direct", [2], None, "Ljava/lang/Object;-><init>()V"),
        ("const/4", [0], 1, None),
        ("const", [1], -1, None),
        ("const-string", [1], None, '"it\'s # not, v9 \\" 0x7"'),
        ("const-wide", [0], -(1 << 63), None),
        ("const/16", [0], 97, None),
        ("const/high16", [1], 0x43200000, None),
        ("invoke-polymorphic", [2, 0], None, "Ljava/lang/invoke/MethodHandle;->invoke([Ljava/lang/Object;)Ljava/lang/Object;"),
        ("return-void", [], None, None),
    ]
    (goto,) = tables["insn"].filter("op = 'goto'").collect()
    assert (goto["off"], goto["target"]) == (0, 0)


def test_lines_and_variables(tables):
    assert sorted((r["off"], r["line"]) for r in tables["line"].collect()) == [(0, 11), (7, 30), (8, 31)]
    got = sorted((r["reg"], r["start_off"], r["end_off"], r["name"], r["type"], r["signature"], r["is_param"]) for r in tables["local_var"].fillna("-").collect())
    assert got == [
        (0, 2, 4, "count", "I", "-", False),
        (0, 5, 6, "count", "I", "-", False),
        (0, 6, 8, "-", "J", "TT;", False),
        (3, -1, 8, "when", "J", "-", True),
    ]


def test_annotations(tables):
    got = {(r["owner_kind"], r["param"], r["type"]): (r["owner_key"], r["visibility"], r["ord"], {k: tuple(v) for k, v in r["values"].items()}) for r in tables["annotation"].collect()}
    assert got == {
        ("class", None, "Ldalvik/annotation/EnclosingClass;"): ("a/p.Outer$Inner", "system", 0, {"value": ("type", "Lp/Outer;")}),
        ("class", None, "Ldalvik/annotation/InnerClass;"): ("a/p.Outer$Inner", "system", 1, {"accessFlags": ("number", "0x9"), "name": ("string", "In # ner")}),
        ("class", None, "Lp/Late;"): ("a/p.Outer$Inner", "runtime", 2, {}),
        ("field", None, "Lp/Marked;"): (
            "a/p.Outer$Inner->list:Ljava/util/List;", "runtime", 0,
            {
                "items": ("array", "one, {two},Lp/Level;->HIGH:Lp/Level;,x,y,null,0x1,-2t"),
                "owner": ("type", "[Lp/Owner;"), "call": ("method", "Lp/A;->run(I[J)V"), "flag": ("boolean", "true"), "sep": ("char", ","),
            },
        ),
        ("field", None, "Lp/Empty;"): ("a/p.Outer$Inner->list:Ljava/util/List;", "build", 1, {}),
        ("method", None, "Ldalvik/annotation/Throws;"): ("a/p.Outer$Inner-><init>(JLjava/lang/String;)V", "system", 0, {"value": ("array", "Ljava/io/IOException;")}),
        ("param", "p3", "Lp/NonNull;"): ("a/p.Outer$Inner-><init>(JLjava/lang/String;)V", "runtime", 0, {}),
    }
    values = annotation_values(tables["annotation_token"])
    paths = [(r["path"], r["kind"], r["value"]) for r in values.filter("owner_kind = 'field'").orderBy("pos").collect()]
    assert paths == [
        ("items[0].name", "string", "one, {two}"), ("items[0].level", "enum", "Lp/Level;->HIGH:Lp/Level;"),
        ("items[0].tags[0]", "string", "x"), ("items[0].tags[1]", "string", "y"), ("items[1].name", "null", None),
        ("items[1].nested[0][0]", "number", "0x1"), ("items[1].nested[0][1]", "number", "-2t"),
        ("owner", "type", "[Lp/Owner;"), ("call", "method", "Lp/A;->run(I[J)V"), ("flag", "boolean", "true"), ("sep", "char", ","),
    ]
    assert [tuple(r) for r in declared_outers(tables["annotation"]).collect()] == [("a", "p.Outer$Inner", "p.Outer")]


def test_empty_and_broken_texts(spark):
    texts = [None, "", "no class", ".class Lp/B;\n.method static cut()V\n    .registers 1\n    nop", ".class Lp/C;\n.method bad()V\n    # <error rendering method: \"it's # odd\">\n.end method"]
    t = parse_disassembly(spark.createDataFrame([("a", str(k), x) for k, x in enumerate(texts)], "app_id string, input_file string, text string"))
    assert [r["cls"] for r in t["class"].orderBy("input_file").collect()] == [None, None, None, "p.B", "p.C"]
    assert sorted((r["name"], r["error"]) for r in t["method"].fillna("-").collect()) == [("bad", "\"it's # odd\""), ("cut", "-")]
    assert [r["op"] for r in t["insn"].collect()] == ["nop"]
    for name in ("annotation", "line", "local_var"):
        assert t[name].collect() == []
    assert annotation_values(t["annotation_token"]).collect() == []


# ---- random nests of blocks against a plain recursive writer


def random_value(rng, depth):
    """(text, [(path suffix, kind, value)])"""
    pick = rng.randrange(8 if depth < 6 else 5)
    if pick == 0:
        return f'"s{rng.randrange(9)}, }}{{="', [("", "string", None)]
    if pick < 5:
        n = str(rng.randrange(100))
        return n, [("", "number", n)]
    if pick == 5:
        parts = [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
        return "{" + ", ".join(t for t, _ in parts) + "}", [(f"[{k}]{p}", kind, v) for k, (_, own) in enumerate(parts) for p, kind, v in own]
    parts = [(f"e{k}", random_value(rng, depth + 1)) for k in range(rng.randrange(4))]
    body = "".join(f"\n{n} = {t}" for n, (t, _) in parts)
    return f".subannotation Lp/N;{body}\n.end subannotation", [(f".{n}{p}", kind, v) for n, (_, own) in parts for p, kind, v in own]


def test_random_nests(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(60):
        parts = [(f"n{j}", random_value(rng, 0)) for j in range(rng.randrange(5))]
        body = "".join(f"    {n} = {t}\n" for n, (t, _) in parts)
        rows.append(("a", str(k), f".class Lp/C{k};\n.annotation runtime Lp/A;\n{body}.end annotation\n"))
        want[f"a/p.C{k}"] = [(n + p, kind) for n, (_, own) in parts for p, kind, _ in own]
    tokens = parse_disassembly(spark.createDataFrame(rows, "app_id string, input_file string, text string"))["annotation_token"]
    got = {key: [] for key in want}
    for r in annotation_values(tokens).orderBy("pos").collect():
        got[r["owner_key"]].append((r["path"], r["kind"]))
    assert got == want
    assert max(len(re.findall(r"[\[.]", p)) for own in want.values() for p, _ in own) > 4


def test_long_strings_and_many_literals(spark):
    line = "    const-string v0, " + '"' + "\\u0041 # x' " * 20000 + '"  # end\n'
    text = ".class Lp/L;\n.method static m()V\n    .registers 1\n" + line + "    nop # " + "'\"" * 20000 + "\n.end method\n"
    t = parse_disassembly(spark.createDataFrame([("a", "x", text)], "app_id string, input_file string, text string"))
    assert [(r["op"], len(r["ref"] or "")) for r in t["insn"].orderBy("off").collect()] == [("const-string", 2 + 12 * 20000), ("nop", 0)]


def test_one_partition_of_texts_is_parsed_by_many_tasks(spark):
    rows = [("a", str(k), f".class public La/C{k};\n.method run()V\n    .locals 0\n    .line 3\n    return-void\n.end method\n") for k in range(64)]
    files = spark.createDataFrame(rows, "app_id string, input_file string, text string").coalesce(1)
    t = parse_disassembly(files)
    tasks = {r["t"] for r in t["class"].select(F.spark_partition_id().alias("t")).collect()}
    assert len(tasks) > 1 and t["class"].count() == 64
    # the tables of the code read the lines that were numbered once
    assert all(t[name].inputFiles() for name in ("insn", "label", "line", "local_var"))
    assert t["line"].count() == t["insn"].count() == 64
    assert set(t) == {"class", "field", "method", "annotation", "annotation_token", "insn", "label", "try_range", "switch", "line", "local_var"}
