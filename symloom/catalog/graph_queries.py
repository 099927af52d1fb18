"""Hierarchy, calls, control flow and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.catalog.registry import query
from symloom.catalog.table_queries import tops
from symloom.operators import graph
from symloom.plans.ordered import lead, scan

_EDGES_SQL = """up AS (SELECT cls, super AS p, 0 AS i FROM v_class WHERE super IS NOT NULL
      UNION ALL SELECT cls, itf, 1 FROM v_class WHERE itf IS NOT NULL)"""
_CLOSURE_SQL = f"""{_EDGES_SQL},
    clo AS (SELECT cls, p AS anc FROM up UNION SELECT clo.cls, up.p FROM clo JOIN up ON up.cls = clo.anc)"""


def class_edges(v):
    both = F.array("super", "itf")
    return v.v_class.select("cls", F.posexplode(both).alias("idx", "parent")).filter(F.col("parent").isNotNull())


def class_closure(v):
    return graph.closure(class_edges(v))


@query(
    f"""WITH RECURSIVE @v_class, {_EDGES_SQL},
    ways AS (SELECT cls, p AS anc, 1 AS d, CAST(i AS VARCHAR) AS path FROM up
      UNION ALL SELECT w.cls, up.p, d + 1, path || i FROM ways w JOIN up ON up.cls = w.anc)
    SELECT cls, anc, CAST(min(d) AS BIGINT) AS depth, min(path) AS path FROM ways GROUP BY 1, 2"""
)
def supertype_closure(v):
    """All ancestors with distance and the place a depth-first walk meets them."""
    return class_closure(v).select(
        "cls", "anc", F.col("depth").cast("long").alias("depth"), F.array_join("path", "").alias("path")
    )


@query(
    """WITH RECURSIVE @v_class, walk AS (SELECT cls AS node, cls AS cur FROM v_class
      UNION ALL SELECT node, c.super FROM walk JOIN v_class c ON c.cls = walk.cur WHERE c.cls >= 40)
    SELECT node, cur AS top FROM walk WHERE cur < 40"""
)
def top_ancestor(v):
    return tops(v)


_PAIRS_SQL = """prs AS (SELECT target AS a, lead(target) OVER (PARTITION BY unit ORDER BY off, price, qty, shipped, target, member) AS b FROM v_ref),
    q AS (SELECT DISTINCT a, b FROM prs WHERE b IS NOT NULL)"""


def _pairs(v):
    order = ["off", "price", "qty", "shipped", "target", "member"]
    near = scan(v.v_ref, ["unit"], order, {"b": lead(F.col("target"))})
    return near.select(F.col("target").alias("a"), "b").filter("b IS NOT NULL").distinct()


@query(
    f"""WITH RECURSIVE @v_class, @v_ref, {_PAIRS_SQL}, {_CLOSURE_SQL}
    SELECT a, b, CASE WHEN a = b OR EXISTS (SELECT 1 FROM clo WHERE clo.cls = a AND clo.anc = b) THEN 'yes' ELSE 'no' END AS relation FROM q"""
)
def subtype_relation(v):
    """Whether neighbouring targets of a unit are subtypes; all classes are loaded, so no is proved."""
    def text(c):
        return F.col(c).cast("string")

    closed = graph.ancestors(class_edges(v)).select(text("cls").alias("cls"), text("anc").alias("anc"))
    pairs = _pairs(v).select(text("a").alias("sub"), text("b").alias("sup"))
    found = graph.subtype(pairs, closed, v.v_class.select(text("cls").alias("cls"), "flags"))
    return found.select(F.col("sub").cast("long").alias("a"), F.col("sup").cast("long").alias("b"), "relation")


# a part's class and its super in two apps, as arrays, primitives, final and unknown types
_TYPES_SQL = """t AS (SELECT 'app' || (cls % 2) AS app_id, cls, 'p.C' || (cls // 2) AS name, CASE WHEN super IS NOT NULL AND (cls - super) % 2 = 0 THEN 'p.C' || (super // 2) END AS up, flags % 2 = 1 AS final, cls % 7 AS k FROM v_class)"""
_TYPES_CLOSURE = f"""{_TYPES_SQL}, clo AS (SELECT app_id, name, up AS anc FROM t WHERE up IS NOT NULL
      UNION SELECT c.app_id, c.name, t.up FROM clo c JOIN t ON t.app_id = c.app_id AND t.name = c.anc WHERE t.up IS NOT NULL)"""


@query(f"WITH RECURSIVE @v_class, {_TYPES_CLOSURE} SELECT app_id, name AS cls, anc FROM clo")
def ancestors_by_app(v):
    """Two apps that share their class names, each with its own hierarchy."""
    return graph.closure(graph.supertype_edges(_typed(v))).select("app_id", "cls", "anc")


@query(
    f"""WITH RECURSIVE @v_class, {_TYPES_CLOSURE},
    pr AS (SELECT t.*, coalesce(up, 'p.C7') AS o FROM t),
    ask AS (SELECT app_id, k, name, o, CASE k WHEN 0 THEN name || '[]' WHEN 1 THEN 'int[]' WHEN 3 THEN 'x.Missing' WHEN 4 THEN name || '[][]' WHEN 5 THEN 'long' ELSE name END AS sub,
      CASE k WHEN 0 THEN o || '[]' WHEN 1 THEN 'java.lang.Object' WHEN 2 THEN 'java.lang.String' WHEN 4 THEN 'java.lang.Object[]' WHEN 5 THEN 'java.lang.Object' ELSE o END AS sup FROM pr),
    f AS (SELECT app_id, name, bool_or(final) AS final FROM t GROUP BY 1, 2),
    r AS (SELECT ask.*, c.name IS NOT NULL AS below, f.name IS NOT NULL AS o_in, coalesce(f.final, FALSE) AS o_final
      FROM ask LEFT JOIN clo c ON c.app_id = ask.app_id AND c.name = ask.name AND c.anc = ask.o LEFT JOIN f ON f.app_id = ask.app_id AND f.name = ask.o)
    SELECT app_id, sub, sup, CASE k WHEN 0 THEN CASE WHEN name = o OR below THEN 'yes' ELSE 'unknown' END WHEN 1 THEN 'yes' WHEN 2 THEN 'no'
      WHEN 3 THEN CASE WHEN o_final THEN 'no' ELSE 'unknown' END WHEN 4 THEN 'yes' WHEN 5 THEN 'unknown'
      ELSE CASE WHEN name = o OR below THEN 'yes' WHEN o_in THEN 'no' ELSE 'unknown' END END AS relation, count(*) AS n FROM r GROUP BY ALL"""
)
def subtype_branches(v):
    """Arrays of classes and of primitives, a known final type, a missing class and a primitive, in two apps."""
    classes = _typed(v)
    closed = graph.ancestors(graph.supertype_edges(classes).select("app_id", "cls", "parent"))
    k, name, o = F.col("k"), F.col("cls"), F.coalesce("super", F.lit("p.C7"))
    array = lambda c, n=1: F.concat(c, F.lit("[]" * n))
    sub = (
        F.when(k == 0, array(name)).when(k == 1, "int[]").when(k == 3, "x.Missing").when(k == 4, array(name, 2)).when(k == 5, "long").otherwise(name)
    )
    sup = F.when(k == 0, array(o)).when(k.isin(1, 5), graph.OBJECT).when(k == 2, "java.lang.String").when(k == 4, array(F.lit(graph.OBJECT))).otherwise(o)
    found = graph.subtype(classes.select("app_id", sub.alias("sub"), sup.alias("sup")), closed, classes.select("app_id", "cls", "flags"))
    return found.groupBy("app_id", "sub", "sup", "relation").agg(F.count(F.lit(1)).alias("n"))


def _typed(v):
    c, up = F.col("cls"), F.col("super")
    named = lambda x: F.concat(F.lit("p.C"), F.floor(x / 2).cast("string"))
    return v.v_class.select(
        F.concat(F.lit("app"), (c % 2).cast("string")).alias("app_id"), (c % 7).alias("k"), named(c).alias("cls"),
        F.when((c - up) % 2 == 0, named(up)).alias("super"), F.array().cast("array<string>").alias("interfaces"),
        F.when(F.col("flags") % 2 == 1, 0x10).otherwise(0).alias("flags"),
    )


@query(
    f"""WITH RECURSIVE @v_class, @v_ref, {_PAIRS_SQL}, {_EDGES_SQL},
    ways AS (SELECT cls, cls AS anc, 0 AS d, '' AS path FROM v_class
      UNION ALL SELECT w.cls, up.p, d + 1, path || i FROM ways w JOIN up ON up.cls = w.anc),
    clo AS (SELECT cls, anc, min(d) AS d, min(path) AS path FROM ways GROUP BY 1, 2),
    m AS (SELECT a, b, x.anc, row_number() OVER (PARTITION BY a, b ORDER BY position('1' IN x.path) > 0, x.d, x.path) AS r
      FROM q JOIN clo x ON x.cls = a JOIN clo y ON y.cls = b AND y.anc = x.anc)
    SELECT a, b, anc AS joined FROM m WHERE r = 1"""
)
def common_supertype(v):
    return graph.common_supertype(_pairs(v), class_closure(v), root=0).select("a", "b", "joined")


@query(
    """WITH RECURSIVE @v_class, @v_ref, s AS (SELECT DISTINCT unit, target FROM v_ref),
    anc AS (SELECT cls, cls AS a, 0 AS d FROM v_class UNION ALL SELECT anc.cls, c.super, d + 1 FROM anc JOIN v_class c ON c.cls = anc.a WHERE c.super IS NOT NULL),
    lvl AS (SELECT cls, max(d) AS level FROM anc GROUP BY 1),
    sz AS (SELECT unit, count(*) AS n FROM s GROUP BY 1),
    h AS (SELECT s.unit, a, count(*) AS n FROM s JOIN anc ON anc.cls = s.target GROUP BY 1, 2)
    SELECT h.unit, arg_max(h.a, lvl.level) AS ancestor FROM h JOIN sz ON sz.unit = h.unit AND sz.n = h.n JOIN lvl ON lvl.cls = h.a GROUP BY 1"""
)
def deepest_common(v):
    """Deepest class above all classes a unit refers to, on the super tree."""
    closed = graph.ancestors(v.v_class.select("cls", F.col("super").alias("parent")).filter("parent IS NOT NULL"))
    level = closed.groupBy(F.col("cls").alias("anc")).agg(F.max("depth").alias("level"))
    sets = v.v_ref.select(F.col("unit").alias("set"), F.col("target").alias("node"))
    return graph.deepest_common(sets, closed, level).select(F.col("set").alias("unit"), "ancestor")


_FORWARD_SQL = """fw AS (SELECT o_orderkey AS m, CASE WHEN o_orderkey % 500 = 7 THEN o_orderkey + 500 WHEN o_orderkey % 2 = 1 THEN o_orderkey // 2
      ELSE o_custkey * 11 END AS t FROM orders WHERE o_orderpriority <> '5-LOW')"""


@query(
    f"""WITH RECURSIVE {_FORWARD_SQL}, chain AS (SELECT m, t FROM fw
      UNION SELECT c.m, fw.t FROM chain c JOIN fw ON fw.m = c.t),
    ends AS (SELECT m, t FROM chain c WHERE NOT EXISTS (SELECT 1 FROM fw WHERE fw.m = c.t))
    SELECT fw.m AS method_key, e.t AS terminal FROM fw LEFT JOIN ends e ON e.m = fw.m"""
)
def terminal_targets(v):
    """Orders that forward to one other order; some chains are long, some are cycles."""
    return graph.terminal_targets(_forwards(v))


def _forwards(v):
    o = F.col("o_orderkey")
    target = (
        F.when(o % 500 == 7, o + 500).when(o % 2 == 1, F.floor(o / 2).cast("long")).otherwise(F.col("o_custkey") * 11)
    )
    return v.table("orders").filter("o_orderpriority <> '5-LOW'").select(o.alias("method_key"), target.alias("target"))


@query(
    f"""WITH RECURSIVE @v_call, {_FORWARD_SQL}, chain AS (SELECT m, t FROM fw UNION SELECT c.m, fw.t FROM chain c JOIN fw ON fw.m = c.t),
    ends AS (SELECT m, t FROM chain c WHERE NOT EXISTS (SELECT 1 FROM fw WHERE fw.m = c.t))
    SELECT caller, coalesce(e.t, callee) AS callee, count(*) AS n FROM v_call LEFT JOIN ends e ON e.m = callee GROUP BY 1, 2"""
)
def redirect_calls(v):
    """Calls of forwarding orders pointed at where the forwarding ends; into a cycle they stay."""
    calls = graph.redirect_calls(v.v_call, graph.terminal_targets(_forwards(v)))
    return calls.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT o_orderkey AS method_key, o_custkey AS target FROM orders
    WHERE o_orderpriority NOT IN ('5-LOW', '1-URGENT') AND o_orderstatus <> 'P' AND o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0"""
)
def forwarders(v):
    """Orders spelled as method bodies, some of which only pass their arguments on."""
    orders = v.table("orders")
    o, status, urgent = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    params = F.array(F.lit("I"), F.lit("J"))
    ret = F.when(o % 2 == 0, "V").otherwise("I")
    methods = orders.select(
        o.alias("method_key"), params.alias("params"), ret.alias("ret"),
        F.when(urgent == "5-LOW", 0x8).when(urgent == "1-URGENT", 0x1040).otherwise(0x48).alias("flags"),
        F.lit(5).alias("registers"), (status == "P").alias("has_handlers"),
    )
    call = F.struct(
        F.lit(0).alias("off"), F.lit("invoke-static").alias("op"),
        F.when(o % 5 == 0, F.array(F.lit(2), F.lit(4), F.lit(3))).otherwise(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("regs"),
    )
    empty = F.array().cast("array<int>")

    def row(off, op, regs):
        return F.struct(F.lit(off).alias("off"), F.lit(op).alias("op"), regs.alias("regs"))

    one = F.array(F.lit(0))
    nop, extra = row(1, "nop", empty), row(2, "const", one)
    body = F.concat(
        F.array(call, nop), F.when(o % 4 == 0, F.array(extra)).otherwise(F.array().cast("array<struct<off:int,op:string,regs:array<int>>>")),
        F.when(o % 2 == 0, F.array(row(9, "return-void", empty))).otherwise(
            F.array(row(8, "move-result", one), row(9, "return", one))
        ),
    )
    insns = orders.select(o.alias("method_key"), F.col("o_custkey").alias("ref_key"), params.alias("ref_params"), ret.alias("ref_ret"), F.explode(body).alias("i")).select(
        "method_key", "i.off", "i.op", "i.regs", "ref_key", "ref_params", "ref_ret"
    )
    return graph.forwarders(methods, insns)


_THROWS_SQL = """direct AS (SELECT DISTINCT o_orderkey AS m, 'E' || substr(o_orderpriority, 1, 1) AS exc FROM orders WHERE o_totalprice > 400000),
    stop AS (SELECT o_orderkey AS m, 'E' || (o_custkey % 5 + 1) AS exc FROM orders
      UNION SELECT o_orderkey, 'E2' FROM orders WHERE o_custkey % 5 = 0
      UNION SELECT o_orderkey, 'E3' FROM orders WHERE o_custkey % 5 = 0
      UNION SELECT o_orderkey, e FROM orders, (VALUES ('E1'), ('E2'), ('E3'), ('E4'), ('E5')) t(e) WHERE o_custkey % 7 = 0),
    thrown AS (SELECT m, exc FROM direct d WHERE NOT EXISTS (SELECT 1 FROM stop s WHERE s.m = d.m AND s.exc = d.exc)
      UNION SELECT c.caller, t.exc FROM thrown t JOIN v_call c ON c.callee = t.m
      WHERE NOT EXISTS (SELECT 1 FROM stop s WHERE s.m = c.caller AND s.exc = t.exc))"""


def thrown(v):
    """Dear orders throw their priority; customers decide what an order catches; E2, E3 are below E1."""
    o = v.table("orders")
    name = F.concat(F.lit("E"), F.substring("o_orderpriority", 1, 1))
    direct = o.filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("method"), name.alias("exc"))
    cust = F.col("o_custkey")
    typed = o.select(F.col("o_orderkey").alias("method"), F.concat(F.lit("E"), (cust % 5 + 1).cast("string")).alias("exc"))
    every = o.filter(cust % 7 == 0).select(F.col("o_orderkey").alias("method"), F.lit(graph.CATCH_EVERYTHING[0]).alias("exc"))
    closed = v.spark.createDataFrame([("E2", "E1"), ("E3", "E1"), ("E1", "java.lang.Exception")], "cls string, anc string")
    checked = graph.checked_only(direct, closed)
    return graph.propagate_throws(checked, v.v_call, typed.unionByName(every), closed)


@query(f"WITH RECURSIVE @v_call, {_THROWS_SQL} SELECT m AS method, exc FROM thrown")
def propagate_throws(v):
    return thrown(v)


@query(
    f"WITH RECURSIVE @v_call, {_THROWS_SQL} SELECT m AS method, string_agg(exc, ',' ORDER BY exc) AS throws FROM thrown GROUP BY m"
)
def throws_clause(v):
    return graph.throws_clause(thrown(v)).select("method", F.array_join("throws", ",").alias("throws"))


# --- control flow ----------------------------------------------------------------------------

_REACH_SQL = """reach AS (SELECT method_key, block FROM v_entry_block
      UNION SELECT e.method_key, e.dst FROM reach r JOIN v_edge e ON e.method_key = r.method_key AND e.src = r.block)"""
_DOM_SQL = f"""{_REACH_SQL},
    avoid AS (SELECT n.method_key, n.block AS d, r.block FROM reach n JOIN v_entry_block r ON r.method_key = n.method_key AND r.block <> n.block
      UNION SELECT a.method_key, a.d, e.dst FROM avoid a JOIN v_edge e ON e.method_key = a.method_key AND e.src = a.block AND e.dst <> a.d),
    dom AS (SELECT n.method_key, n.block, d.block AS dom FROM reach n JOIN reach d ON d.method_key = n.method_key
      WHERE NOT EXISTS (SELECT 1 FROM avoid a WHERE a.method_key = n.method_key AND a.d = d.block AND a.block = n.block)),
    idom AS (SELECT s.method_key, s.block, arg_max(s.dom, c.n) AS idom FROM dom s
      JOIN (SELECT method_key, block, count(*) AS n FROM dom GROUP BY 1, 2) c ON c.method_key = s.method_key AND c.block = s.dom
      WHERE s.dom <> s.block GROUP BY 1, 2)"""


@query("WITH @v_flow, @v_edge SELECT method_key, src, dst FROM v_edge WHERE NOT exceptional")
def clean_edges(v):
    return graph.clean_edges(v.v_edge).select("method_key", "src", "dst")


@query(
    """WITH RECURSIVE @v_edge, @v_entry_block, x AS (SELECT * FROM v_edge WHERE NOT exceptional),
    reach AS (SELECT method_key, block FROM v_entry_block
      UNION SELECT e.method_key, e.dst FROM reach r JOIN x e ON e.method_key = r.method_key AND e.src = r.block)
    SELECT * FROM reach"""
)
def reachable_blocks(v):
    """Blocks reached without exceptional edges."""
    return graph.reachable(graph.clean_edges(v.v_edge), v.v_entry_block)


@query(f"WITH RECURSIVE @v_edge, @v_entry_block, {_DOM_SQL} SELECT method_key, block, dom FROM dom")
def dominators(v):
    return graph.dominators(v.v_edge, v.v_entry_block)


@query(f"WITH RECURSIVE @v_edge, @v_entry_block, {_DOM_SQL} SELECT method_key, block, idom FROM idom")
def immediate_dominators(v):
    return graph.immediate_dominators(graph.dominators(v.v_edge, v.v_entry_block))


@query(
    f"""WITH RECURSIVE @v_edge, @v_entry_block, {_DOM_SQL}
    SELECT DISTINCT e.method_key, d.dom AS block, e.dst AS frontier FROM v_edge e JOIN dom d ON d.method_key = e.method_key AND d.block = e.src
    WHERE NOT EXISTS (SELECT 1 FROM dom x WHERE x.method_key = e.method_key AND x.block = e.dst AND x.dom = d.dom AND x.dom <> x.block)"""
)
def dominance_frontier(v):
    return graph.dominance_frontier(v.v_edge, graph.dominators(v.v_edge, v.v_entry_block))


_EXIT_SQL = """ex AS (SELECT method_key, op AS block FROM v_flow WHERE next_op IS NULL)"""
_PDOM_SQL = (
    _EXIT_SQL + ",\n" + _DOM_SQL.replace("v_entry_block", "ex")
    .replace("e.dst", "e.SRC").replace("e.src", "e.dst").replace("e.SRC", "e.src")
)


@query(f"WITH RECURSIVE @v_edge, {_PDOM_SQL} SELECT method_key, block, dom FROM dom")
def post_dominators(v):
    """Blocks on every way from a block to the last step of its method."""
    exits = v.v_flow.filter("next_op IS NULL").select("method_key", F.col("op").alias("block"))
    return graph.dominators(v.v_edge, exits, reverse=True)


_BACK_SQL = f"""{_DOM_SQL}, back AS (SELECT e.method_key, e.src, e.dst FROM v_edge e JOIN dom d
      ON d.method_key = e.method_key AND d.block = e.src AND d.dom = e.dst)"""


@query(
    f"""WITH RECURSIVE @v_edge, @v_entry_block, {_BACK_SQL},
    body AS (SELECT DISTINCT method_key, dst AS header, src AS block FROM back WHERE src <> dst
      UNION SELECT b.method_key, b.header, e.src FROM body b JOIN v_edge e ON e.method_key = b.method_key AND e.dst = b.block AND e.src <> b.header)
    SELECT method_key, header, block FROM body UNION SELECT method_key, dst, dst FROM back"""
)
def natural_loops(v):
    return graph.natural_loops(v.v_edge, graph.dominators(v.v_edge, v.v_entry_block))


@query(
    f"""WITH RECURSIVE @v_edge, @v_entry_block, {_BACK_SQL},
    fwd AS (SELECT method_key, src, dst FROM v_edge EXCEPT SELECT method_key, src, dst FROM back),
    ways AS (SELECT method_key, src, dst FROM fwd UNION SELECT w.method_key, w.src, f.dst FROM ways w JOIN fwd f ON f.method_key = w.method_key AND f.src = w.dst)
    SELECT m.method_key, NOT EXISTS (SELECT 1 FROM ways w WHERE w.method_key = m.method_key AND w.src = w.dst) AS reducible
    FROM (SELECT DISTINCT method_key FROM v_edge) m"""
)
def reducible_methods(v):
    return graph.reducible(v.v_edge, graph.dominators(v.v_edge, v.v_entry_block))


@query(
    """WITH RECURSIVE @v_flow, @v_edge, a AS (SELECT method_key, op AS block, idx, k % 8 AS reg, k % 2 = 1 AS uses FROM v_flow),
    gen AS (SELECT method_key, block, reg FROM a GROUP BY 1, 2, 3 HAVING min(idx) FILTER (WHERE uses) IS NOT NULL
      AND (min(idx) FILTER (WHERE NOT uses) IS NULL OR min(idx) FILTER (WHERE uses) <= min(idx) FILTER (WHERE NOT uses))),
    kill AS (SELECT DISTINCT method_key, block, reg FROM a WHERE NOT uses),
    live AS (SELECT method_key, block, reg FROM gen UNION SELECT e.method_key, e.src, l.reg FROM live l JOIN v_edge e
      ON e.method_key = l.method_key AND e.dst = l.block
      WHERE NOT EXISTS (SELECT 1 FROM kill k WHERE k.method_key = e.method_key AND k.block = e.src AND k.reg = l.reg))
    SELECT * FROM live"""
)
def liveness(v):
    """Odd steps use a register, even ones define it."""
    rows = v.v_flow.select("method_key", F.col("op").alias("block"), "idx", "k", (F.col("k") % 8).alias("reg"))
    uses, defs = rows.filter("k % 2 = 1"), rows.filter("k % 2 = 0")
    return graph.liveness(v.v_edge, uses, defs)


@query(
    """WITH @v_flow, @v_edge, b AS (SELECT method_key, op AS block, min(idx) AS ord, bool_or(k = 99) AS h FROM v_flow GROUP BY 1, 2),
    e AS (SELECT DISTINCT e.method_key, e.src, e.dst, y.ord <= x.ord AS back FROM v_edge e JOIN b x ON x.method_key = e.method_key AND x.block = e.src
      JOIN b y ON y.method_key = e.method_key AND y.block = e.dst),
    f AS (SELECT method_key, src, count(*) AS n, bool_or(back) AS back FROM e GROUP BY 1, 2)
    SELECT m.method_key, NOT h AND coalesce(wide, 0) <= 1 AND NOT coalesce(back, FALSE) AS ok FROM (SELECT method_key, bool_or(h) AS h FROM b GROUP BY 1) m
    LEFT JOIN (SELECT method_key, max(n) AS wide, bool_or(back) AS back FROM f GROUP BY 1) g ON g.method_key = m.method_key"""
)
def renderable_methods(v):
    blocks = v.v_flow.groupBy("method_key", F.col("op").alias("block")).agg(
        F.min("idx").alias("ord"), F.bool_or(F.col("k") == 99).alias("is_handler")
    )
    return graph.renderable(blocks, v.v_edge)


@query(
    "WITH @v_range SELECT id AS node, min(id) OVER (PARTITION BY grp) AS component FROM v_range"
)
def components(v):
    """Orders linked to the next order of the same customer."""
    linked = scan(v.v_range, ["grp"], ["s", "id"], {"next": lead(F.col("id"))})
    return graph.components(linked.select(F.col("id").alias("a"), F.coalesce("next", "id").alias("b")))


@query(
    """WITH RECURSIVE @v_class, kept AS (SELECT cls FROM v_class WHERE flags % 3 = 0
      UNION SELECT c.super FROM kept JOIN v_class c ON c.cls = kept.cls WHERE c.super IS NOT NULL)
    SELECT cls AS node FROM kept"""
)
def sweep_unused(v):
    """Classes that stay when unused removable ones are dropped; a class uses its super."""
    nodes = v.v_class.select(F.col("cls").alias("node"), (F.col("flags") % 3 != 0).alias("removable"))
    uses = v.v_class.filter("super IS NOT NULL").select(F.col("cls").alias("consumer"), F.col("super").alias("used"))
    return graph.sweep_unused(nodes, uses).select("node")
