"""From disassembly text to control flow, forwarders and throws clauses."""

import pytest

from symloom.operators import bodies, graph
from symloom.sources.disassembly import parse_disassembly

TEXT = """.class public Lp/A;
.super Ljava/lang/Object;

.method public static loop(I)V
    .registers 3
    const/4 v0, 0x0
    :goto_1
    if-ge v0, p0, :cond_7
    packed-switch p0, :pswitch_data_9
    add-int/lit8 v0, v0, 0x1
    goto :goto_1
    :pswitch_5
    nop
    :cond_7
    return-void
    :pswitch_data_9
    .packed-switch 0x0
        :pswitch_5
        :cond_7
    .end packed-switch
.end method

.method public static io()V
    .registers 2
    new-instance v0, Ljava/io/IOException;
    invoke-direct {v0}, Ljava/io/IOException;-><init>()V
    move-object v1, v0
    throw v1
.end method

.method public static caller()V
    .registers 1
    :try_start_0
    invoke-static {}, Lp/A;->io()V
    :try_end_3
    .catchall {:try_start_0 .. :try_end_3} :catchall_4
    return-void
    :catchall_4
    move-exception v0
    throw v0
.end method

.method public static quiet()V
    .registers 1
    :try_start_0
    invoke-static {}, Lp/A;->io()V
    :try_end_3
    .catch Ljava/lang/Exception; {:try_start_0 .. :try_end_3} :catch_4
    :catch_4
    return-void
.end method

.method static synthetic access$000(IJ)I
    .registers 3
    invoke-static {p0, p1, p2}, Lp/A;->real(IJ)I
    move-result p0
    return p0
.end method

.method static synthetic access$100(IJ)I
    .registers 4
    invoke-static {p0, p1, p2}, Lp/A;->access$000(IJ)I
    move-result v0
    return v0
.end method

.method static synthetic swapped(II)V
    .registers 2
    invoke-static {p1, p0}, Lp/A;->two(II)V
    return-void
.end method
"""


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame([("app", "A", TEXT)], "app_id string, input_file string, text string")
    return {k: df.cache() for k, df in parse_disassembly(files).items()}


def test_control_flow(tables):
    flow = bodies.control_flow(tables["insn"], tables["try_range"], tables["switch"])
    edges = {(r.method_key.split("->")[1], r.src, r.dst, r.exceptional) for r in flow["edge"].collect()}
    loop = {e[1:] for e in edges if e[0] == "loop(I)V"}
    # blocks: 1 const, 2 if, 3 switch, 4 add/goto, 5 nop, 6 return
    assert loop == {(1, 2, False), (2, 3, False), (2, 6, False), (3, 4, False), (3, 5, False), (3, 6, False), (4, 2, False), (5, 6, False)}
    assert {e[1:] for e in edges if e[0] == "caller()V"} == {(1, 2, False), (1, 3, True)}
    # the handler is the next block anyway, so its edge is a normal one
    assert {e[1:] for e in edges if e[0] == "quiet()V"} == {(1, 2, False)}


def test_dominators_of_text(spark, tables):
    flow = bodies.control_flow(tables["insn"], tables["try_range"], tables["switch"])
    entries = flow["block"].filter("block = 1").select("method_key", "block")
    dom = graph.dominators(flow["edge"], entries).filter("method_key = 'app/p.A->loop(I)V'")
    idom = {r.block: r.idom for r in graph.immediate_dominators(dom).collect()}
    assert idom == {2: 1, 3: 2, 4: 3, 5: 3, 6: 2}


def test_throws_of_text(spark, tables):
    closed = spark.createDataFrame([], "cls string, anc string")
    found = bodies.throws_of(tables["insn"], tables["try_range"], tables["method"], closed)
    assert {tuple(r) for r in found.collect()} == {("app/p.A->io()V", "java.io.IOException"), ("app/p.A->caller()V", "java.io.IOException")}


def test_forwarders_of_text(tables):
    fw = graph.forwarders(tables["method"], bodies.forwarder_rows(tables["insn"]))
    ends = {r.method_key.split("->")[1]: r.terminal for r in graph.terminal_targets(fw).collect()}
    assert ends == {"access$000(IJ)I": "app/p.A->real(IJ)I", "access$100(IJ)I": "app/p.A->real(IJ)I"}
