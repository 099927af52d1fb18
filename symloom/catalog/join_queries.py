"""Call resolution, inherited members, names, renames and resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.catalog.graph_queries import class_closure
from symloom.catalog.registry import query
from symloom.operators import naming, resources, xref
from symloom.operators.positions import line_starts, pieces
from symloom.plans.ordered import running_sum, scan

_METHODS_SQL = """meth AS (SELECT c_custkey % 997 AS cls, c_mktsegment AS name, c_nationkey % 3 AS p, c_nationkey % 2 AS r, c_custkey AS key FROM customer)"""
_CALLS_SQL = """calls AS (SELECT o_orderkey AS id, o_custkey % 997 AS cls, c_mktsegment AS name, o_orderkey % 3 AS p, o_orderkey % 2 AS r FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _methods(v):
    def params(c):
        return F.array_repeat(F.lit("I"), (c % 3).cast("int"))

    n = F.col("c_nationkey")
    return v.table("customer").select(
        (F.col("c_custkey") % 997).alias("cls"), F.col("c_mktsegment").alias("name"), params(n).alias("params"),
        F.when(n % 2 == 0, "V").otherwise("I").alias("ret"), F.col("c_custkey").alias("method_key"),
        F.col("c_custkey").alias("ord"),
    )


def _calls(v):
    o = F.col("o_orderkey")
    both = v.table("orders").join(v.table("customer"), F.col("c_custkey") == F.col("o_custkey"))
    return both.select(
        o.alias("id"), (F.col("o_custkey") % 997).alias("cls"), F.col("c_mktsegment").alias("name"),
        F.array_repeat(F.lit("I"), (o % 3).cast("int")).alias("params"),
        F.when(o % 2 == 0, "V").otherwise("I").alias("ret"),
    )


@query(
    f"""WITH {_METHODS_SQL}, {_CALLS_SQL}
    SELECT c.id, (SELECT min(key) FROM meth m WHERE m.cls = c.cls AND m.name = c.name AND m.p = c.p) AS method_key,
    (SELECT min(key) FROM meth m WHERE m.cls = c.cls AND m.name = c.name AND m.p = c.p AND m.r = c.r) AS strict_key FROM calls c"""
)
def resolve_calls(v):
    methods, calls = _methods(v), _calls(v)
    loose = xref.resolve_calls(calls, methods).select("id", "method_key")
    strict = xref.resolve_calls(calls, methods, strict=True).select("id", F.col("method_key").alias("strict_key"))
    return loose.join(strict, "id")


@query(
    """WITH RECURSIVE @v_class, @v_ref, up AS (SELECT cls, super AS p, 0 AS i FROM v_class WHERE super IS NOT NULL
      UNION ALL SELECT cls, itf, 1 FROM v_class WHERE itf IS NOT NULL),
    ways AS (SELECT cls, cls AS anc, '' AS path FROM v_class UNION ALL SELECT w.cls, up.p, path || i FROM ways w JOIN up ON up.cls = w.anc),
    clo AS (SELECT cls, anc, min(path) AS path FROM ways GROUP BY 1, 2),
    mem AS (SELECT cls, 'm' || cls % 11 AS name, cls % 2 AS p FROM v_class),
    r AS (SELECT DISTINCT target AS cls, off + qty % 5 AS n, member % 2 AS p FROM v_ref),
    h AS (SELECT r.cls, r.n, r.p, m.cls AS owner, row_number() OVER (PARTITION BY r.cls, r.n, r.p ORDER BY m.p <> r.p, clo.path, m.cls) AS k
      FROM r JOIN clo ON clo.cls = r.cls JOIN mem m ON m.cls = clo.anc AND m.name = 'm' || r.n)
    SELECT r.cls, r.n, r.p, h.owner FROM r LEFT JOIN h ON h.cls = r.cls AND h.n = r.n AND h.p = r.p AND h.k = 1"""
)
def resolve_member(v):
    """One member per class, looked up from all classes through the hierarchy."""
    def params(c):
        return F.when(c == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("I")))

    c = F.col("cls")
    members = v.v_class.select(
        "cls", F.concat(F.lit("m"), (c % 11).cast("string")).alias("name"), params(c % 2).alias("params"),
        F.lit(0).alias("ord"), c.alias("member"),
    )
    asked = v.v_ref.select(F.col("target").alias("cls"), (F.col("off") + F.col("qty") % 5).alias("n"), (F.col("member") % 2).alias("p")).distinct()
    refs = asked.select(
        "n", "p", "cls", F.concat(F.lit("m"), F.col("n").cast("string")).alias("name"),
        params(F.col("p")).alias("params"),
    )
    found = xref.resolve_member(refs, members, class_closure(v).select("cls", "anc", "path"))
    return found.select("cls", "n", "p", "owner")


_USER_SQL = """usr AS (SELECT sym, arg_max(trim(text), seq) AS text FROM v_edit GROUP BY sym HAVING arg_max(trim(text), seq) <> '')"""


@query(
    f"""WITH @v_class, @v_edit, {_USER_SQL},
    auto AS (SELECT cls, 'C' || lpad(CAST(row_number() OVER (PARTITION BY pkg ORDER BY ord) AS VARCHAR), 4, '0') AS alias FROM v_class WHERE flags % 3 <> 0)
    SELECT c.cls AS sym, coalesce(u.text, a.alias, c.name) AS effective FROM v_class c LEFT JOIN usr u ON u.sym = c.cls LEFT JOIN auto a ON a.cls = c.cls"""
)
def effective_names(v):
    """User names from the edit log, then generated names, then the names as given."""
    symbols = v.v_class.select(F.col("cls").alias("sym"), "pkg", "ord", "name", (F.col("flags") % 3 != 0).alias("renamable"))
    auto = naming.allocate_names(symbols, ["pkg"], ["ord"], "C").select("sym", "alias")
    user = naming.latest_edits(v.v_edit).select("sym", "text")
    return naming.effective_names(symbols.select("sym", "name"), user, auto).select("sym", "effective")


@query(
    f"""WITH @v_class, @v_edit, {_USER_SQL}, auto AS (SELECT cls AS sym, 'auto' || cls AS text FROM v_class)
    SELECT sym, text FROM usr UNION ALL SELECT sym, text FROM auto WHERE sym NOT IN (SELECT sym FROM usr)"""
)
def override_union(v):
    auto = v.v_class.select(F.col("cls").alias("sym"), F.concat(F.lit("auto"), F.col("cls").cast("string")).alias("text"))
    user = naming.latest_edits(v.v_edit).select("sym", "text")
    return naming.override_union(auto, user, ["sym"])


@query(
    """SELECT d.doc_id AS sym, CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || quality || ', toxic ' || toxic END AS comment
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
)
def attach_comments(v):
    notes = v.table("labels").select(
        F.col("doc_id").alias("sym"),
        F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(", toxic "), F.col("toxic").cast("string")).alias("text"),
    )
    return naming.attach_comments(v.table("documents").select(F.col("doc_id").alias("sym")), notes)




@query(
    """WITH @v_class, n AS (SELECT cls, CASE WHEN cls < 7 THEN 'p.R' || cls WHEN cls % 9 = 0 THEN 'p.X$N' || cls WHEN cls % 9 = 1 THEN 'p.$N' || cls
      WHEN cls % 9 = 2 THEN 'p.N' || cls || '$' ELSE 'p.R' || (cls % 7) || '$N' || cls END AS name, cls AS ord, super FROM v_class),
    d AS (SELECT a.name AS cls, CASE WHEN a.ord % 9 = 3 THEN a.name ELSE b.name END AS o FROM n a JOIN n b ON b.ord = a.super WHERE a.ord % 9 IN (3, 4) AND a.ord > 6)
    SELECT n.name AS cls, CASE WHEN d.o IS NOT NULL THEN nullif(d.o, n.name) WHEN ord >= 7 AND ord % 9 > 2 THEN 'p.R' || (ord % 7) END AS owner
    FROM n LEFT JOIN d ON d.cls = n.name"""
)
def resolve_outer(v):
    """Nested names, some with a declared owner, some that only look nested, some declared in themselves."""
    c = F.col("cls")
    text = c.cast("string")
    name = (
        F.when(c < 7, F.concat(F.lit("p.R"), text))
        .when(c % 9 == 0, F.concat(F.lit("p.X$N"), text))
        .when(c % 9 == 1, F.concat(F.lit("p.$N"), text))
        .when(c % 9 == 2, F.concat(F.lit("p.N"), text, F.lit("$")))
        .otherwise(F.concat(F.lit("p.R"), (c % 7).cast("string"), F.lit("$N"), text))
    )
    named = v.v_class.select(name.alias("cls"), c.alias("ord"), "super")
    parents = named.select(F.col("ord").alias("super"), F.col("cls").alias("__p"))
    own = F.when(F.col("ord") % 9 == 3, F.col("cls")).otherwise(F.col("__p"))
    declared = named.filter((F.col("ord") % 9).isin(3, 4) & (F.col("ord") > 6)).join(parents, "super").select("cls", own.alias("outer"))
    return naming.resolve_outer(named.select("cls", "ord"), declared).withColumnRenamed("outer", "owner")


_REQUEST_SQL = """req AS (SELECT event_id AS seq, event_id % (SELECT count(*) FROM part) AS sym, CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 17 = 1 THEN '1x' WHEN event_id % 17 = 2 THEN 'int'
      WHEN event_id % 17 = 3 THEN 'a-b' WHEN event_id % 3 = 0 THEN event_type || CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) % 4
      ELSE event_type || user_id END AS new_name FROM events)"""


@query(
    f"""WITH RECURSIVE @v_class, {_REQUEST_SQL},
    sym0 AS (SELECT cls AS sym, pkg, name, flags % 5 <> 0 AS renamable FROM v_class),
    j AS (SELECT r.seq, r.sym, r.new_name, s.pkg, s.name AS eff, CASE WHEN new_name = '' THEN 'empty' WHEN NOT regexp_matches(new_name, '^[A-Za-z_]') THEN 'bad_start'
      WHEN NOT regexp_full_match(new_name, '[A-Za-z0-9_]+') THEN 'bad_char' WHEN new_name = 'int' THEN 'reserved' END AS reason, coalesce(s.renamable, FALSE) AS renamable
      FROM req r LEFT JOIN sym0 s ON s.sym = r.sym),
    live AS (SELECT *, row_number() OVER (PARTITION BY pkg ORDER BY seq) AS i FROM j WHERE reason IS NULL AND renamable),
    start AS (SELECT pkg, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BOOLEAN) AS hit, map_from_entries(list({{'k': sym, 'v': name}})) AS names FROM sym0 GROUP BY pkg),
    walk AS (SELECT * FROM start
      UNION ALL SELECT pkg, i, seq, hit, CASE WHEN hit THEN names ELSE map_concat(names, map([sym], [new_name])) END FROM (
        SELECT l.pkg, l.i, l.seq, l.sym, l.new_name, names, len(list_filter(map_entries(names), lambda e: e.value = l.new_name AND e.key <> l.sym)) > 0 AS hit
        FROM walk w JOIN live l ON l.pkg = w.pkg AND l.i = w.i + 1))
    SELECT seq, sym, new_name, reason, CASE WHEN reason IS NOT NULL THEN 'invalid' WHEN NOT renamable THEN 'unrenamable'
      WHEN (SELECT hit FROM walk w WHERE w.seq = j.seq) THEN 'collision' ELSE 'applied' END AS outcome FROM j"""
)
def check_renames(v):
    """Events as rename requests over all classes; many ask for the same names."""
    parts = v.table("part").agg(F.count(F.lit(1)).alias("parts"))
    e, kind = F.col("event_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    wanted = (
        F.when(e % 17 == 0, "").when(e % 17 == 1, "1x").when(e % 17 == 2, "int").when(e % 17 == 3, "a-b")
        .when(e % 3 == 0, F.concat(kind, (k % 4).cast("string")))
        .otherwise(F.concat(kind, F.col("user_id").cast("string")))
    )
    requests = v.table("events").select(
        e.alias("seq"), (e % parts.scalar()).alias("sym"), wanted.alias("new_name")
    )
    symbols = v.v_class.select(
        F.col("cls").alias("sym"), "pkg", F.col("name").alias("effective"), (F.col("flags") % 5 != 0).alias("renamable")
    )
    return naming.check_renames(requests, symbols, ["pkg"])


@query(
    """WITH @v_call SELECT o_orderkey AS key, 'unreferenced' AS what FROM orders WHERE o_orderkey NOT IN (SELECT callee FROM v_call)
    UNION ALL SELECT callee, 'unresolved' FROM v_call WHERE callee NOT IN (SELECT o_orderkey FROM orders)"""
)
def unreferenced_and_unresolved(v):
    symbols = v.table("orders").select(F.col("o_orderkey").alias("key"))
    refs = v.v_call.select(F.col("callee").alias("key"))
    return xref.unreferenced(symbols, refs, "key").withColumn("what", F.lit("unreferenced")).unionByName(
        xref.unresolved(refs, symbols, "key").withColumn("what", F.lit("unresolved"))
    )


@query(
    """WITH @v_doc, w AS (SELECT unit, line, words, unnest(range(1, len(words) + 1)) AS i FROM (
        SELECT unit, generate_subscripts(string_split(code, chr(10)), 1) AS line, string_split(unnest(string_split(code, chr(10))), ' ') AS words FROM v_doc)),
    t AS (SELECT unit, line, words[i] AS tok, i, CAST(coalesce(list_sum([length(x) + 1 for x in list_slice(words, 1, i - 1)]), 0) AS BIGINT) AS col FROM w),
    f AS (SELECT unit, line, regexp_extract(tok, '^[A-Za-z]+', 0) AS word, tok, min(col) AS col FROM t GROUP BY 1, 2, 3, 4)
    SELECT unit, line, word, min(col) AS col FROM f WHERE regexp_matches(tok, '^(the|est)([^\\p{L}\\p{Nd}_$]|$)') AND word IN ('the', 'est') GROUP BY 1, 2, 3"""
)
def symbol_at(v):
    """Clicks on the words 'the' and 'est' of every line that has them, over all words as symbols."""
    units = v.v_doc.select("unit", "code")
    lines = line_starts(units)
    texts = units.select("unit", F.posexplode(F.split("code", "\n")).alias("i", "text")).select(
        "unit", (F.col("i") + 1).alias("line"), "text"
    )
    sym = F.struct(
        F.lit("method").alias("kind"), F.col("line").cast("string").alias("owner"), F.col("tok").alias("name"),
        F.array().cast("array<string>").alias("params"),
    )
    marks = pieces(units, " ").select("unit", "off", F.lit("ref").alias("kind"), sym.alias("sym"))
    clicks = texts.select("unit", "line", F.explode(F.array(F.lit("the"), F.lit("est"))).alias("token")).select(
        F.struct("unit", "line", "token").alias("click"), "unit", "line", "token", F.lit("method").alias("hint")
    )
    found = xref.symbol_at(marks, units, clicks).filter(F.col("sym").isNotNull())
    return found.select(F.col("click.unit").alias("unit"), F.col("click.line").cast("long").alias("line"), F.col("click.token").alias("word"), "off").join(
        lines, ["unit", "line"]
    ).select("unit", "line", "word", (F.col("off") - F.col("start_off")).alias("col"))


# --- resources -------------------------------------------------------------------------------


def _framework(v):
    """Parts as the framework's id map, every id twice; some ids are below the app's range."""
    k = F.col("p_partkey")
    return v.table("part").select(
        (F.lit(16842752) + k - k % 2).cast("int").alias("id"),
        F.concat(F.lit("attr/"), F.replace("p_name", F.lit(" "), F.lit("_")), k.cast("string")).alias("name"),
        k.alias("ord"),
    )


_NAMES_SQL = """fw AS (SELECT CAST(16842752 + p_partkey - p_partkey % 2 AS INTEGER) AS id,
      'android:' || arg_max('attr/' || replace(p_name, ' ', '_') || p_partkey, p_partkey) AS symbol FROM part GROUP BY 1),
    app AS (SELECT app_id, id, arg_min(type || '/' || name, ord) AS symbol FROM v_res GROUP BY 1, 2),
    sym AS (SELECT app_id, id, symbol FROM app UNION ALL
      SELECT a.app_id, fw.id, fw.symbol FROM fw CROSS JOIN (VALUES ('app0'), ('app1'), ('app2')) a(app_id)
      WHERE NOT EXISTS (SELECT 1 FROM app o WHERE o.app_id = a.app_id AND o.id = fw.id))"""


@query(
    f"""WITH @v_res, {_NAMES_SQL}, r AS (SELECT 'app' || (l_orderkey % 3) AS app_id, l_orderkey AS unit, l_linenumber AS off, CAST(CASE l_linenumber % 4 WHEN 0 THEN 0
      WHEN 1 THEN 16842752 + l_partkey WHEN 2 THEN 2130706432 + l_suppkey % 25 * 65536 + l_partkey % 60 ELSE 16842752 + l_partkey * 3 END AS INTEGER) AS id FROM lineitem)
    SELECT r.app_id, r.unit, r.id, CASE WHEN symbol LIKE 'id/%' THEN '@+' || symbol WHEN symbol IS NOT NULL THEN '@' || symbol WHEN r.id = 0 THEN '@null'
      ELSE '@0x' || printf('%x', r.id) END AS ref, count(*) AS n FROM r LEFT JOIN sym ON sym.id = r.id AND sym.app_id = r.app_id GROUP BY 1, 2, 3, 4"""
)
def resolve_refs(v):
    line, p = F.col("l_linenumber") % 4, F.col("l_partkey")
    id_ = (
        F.when(line == 0, F.lit(0).cast("long")).when(line == 1, 16842752 + p)
        .when(line == 2, 2130706432 + F.col("l_suppkey") % 25 * 65536 + p % 60).otherwise(16842752 + p * 3)
    )
    refs = v.table("lineitem").select(
        F.concat(F.lit("app"), (F.col("l_orderkey") % 3).cast("string")).alias("app_id"),
        F.col("l_orderkey").alias("unit"), id_.cast("int").alias("id"),
    )
    found = resources.resolve_refs(refs, v.v_res, _framework(v))
    return found.groupBy("app_id", "unit", "id", "ref").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH @v_res, {_NAMES_SQL}, b AS (SELECT 'app' || (p_partkey % 3) AS app_id, CAST(2130706432 + p_partkey AS INTEGER) AS id, p_partkey, p_size, p_name FROM part),
    i AS (SELECT app_id, id, p_partkey, 0 AS pos, CAST(16842752 + p_partkey AS INTEGER) AS n, CAST(p_size AS VARCHAR) AS val FROM b WHERE p_size % 7 <> 0
      UNION ALL SELECT app_id, id, p_partkey, 1, CAST(5 + p_partkey AS INTEGER), CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END FROM b WHERE p_size % 7 <> 0
      UNION ALL SELECT b.app_id, b.id, p_partkey, 2, CAST(2130706432 + p_size % 25 * 65536 + p_partkey % 60 AS INTEGER),
        coalesce('?' || s.symbol, '?0x' || printf('%x', 16842752 + 2 * p_partkey)) FROM b LEFT JOIN sym s ON s.id = 16842752 + 2 * p_partkey AND s.app_id = b.app_id WHERE p_size % 7 <> 0),
    t AS (SELECT i.id, i.p_partkey, pos, CASE WHEN s.symbol IS NOT NULL THEN replace(s.symbol, '/', '.') || '=' || val ELSE val END AS txt
      FROM i LEFT JOIN sym s ON s.id = i.n AND s.app_id = i.app_id)
    SELECT b.app_id, b.id, 'c' || (b.p_partkey % 3) AS config, '[' || coalesce((SELECT string_agg(txt, ', ' ORDER BY pos) FROM t WHERE t.p_partkey = b.p_partkey), '') || ']' AS text FROM b"""
)
def render_bags(v):
    k, size = F.col("p_partkey"), F.col("p_size")

    def item(name, vtype, data):
        return F.struct(name.cast("int").alias("name_ref"), F.lit(vtype).alias("vtype"), data.cast("int").alias("vdata"))

    items = F.array(
        item(16842752 + k, 0x10, size),
        item(5 + k, 0x12, F.when(size % 2 == 0, 1).otherwise(0)),
        item(2130706432 + size % 25 * 65536 + k % 60, 0x02, 16842752 + 2 * k),
    )
    empty = F.array().cast(resources.BAG_ITEM)
    bags = v.table("part").select(
        F.concat(F.lit("app"), (k % 3).cast("string")).alias("app_id"),
        (F.lit(2130706432) + k).cast("int").alias("id"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("config"),
        k.alias("ord"), F.when(size % 7 == 0, empty).otherwise(items).alias("bag"),
    )
    return resources.render_bags(bags, resources.symbolic_names(v.v_res, _framework(v)))


@query("WITH @v_res SELECT app_id, type, count(*) AS n FROM v_res GROUP BY app_id, type ORDER BY app_id, type")
def resource_types(v):
    return resources.resource_types(v.v_res)


@query(
    """SELECT c_custkey AS key, CAST(2130706432 + c_nationkey * 65536 + c_custkey % 50 AS BIGINT) AS wide,
    127 AS package, CAST(c_nationkey AS INTEGER) AS type, CAST(c_custkey % 50 AS INTEGER) AS entry,
    CAST(CASE WHEN c_custkey % 3 = 0 THEN 4278190080 + c_custkey - 4294967296 ELSE 16777216 + c_custkey END AS INTEGER) AS other FROM customer"""
)
def resource_ids(v):
    k = F.col("c_custkey")
    id_ = resources.resource_id(F.lit(127), F.col("c_nationkey"), k % 50)
    rows = v.table("customer").select(
        k.alias("key"), id_.alias("id"),
        resources.resource_id(F.when(k % 3 == 0, 255).otherwise(1), F.lit(0), k).alias("other"),
    )
    return rows.withColumn("s", resources.split_id(F.col("id"))).select(
        "key", F.col("id").cast("long").alias("wide"), "s.package", "s.type", "s.entry", "other"
    )


@query(
    """SELECT c_custkey AS app_id, CAST(2130706432 + t * 65536 + e AS INTEGER) AS id, c_mktsegment AS package,
    CASE WHEN t = 1 THEN 'string' ELSE 'type2' END AS type,
    CASE WHEN e = 0 THEN 'n' || c_custkey ELSE 'res_0x' || printf('%x', 2130706432 + t * 65536 + e) END AS name,
    'c' || e AS config, 16 AS vtype, CAST(c_nationkey + t * 10 + e AS INTEGER) AS vdata
    FROM customer, (VALUES (1), (2)) tt(t), (VALUES (0), (1)) ee(e)"""
)
def flatten_resources(v):
    k = F.col("c_custkey")

    def entry(t, e):
        name = F.concat(F.lit("n"), k.cast("string")) if e == 0 else F.lit(None).cast("string")
        return F.struct(
            F.lit(e).alias("entry"), name.alias("name"), F.lit(f"c{e}").alias("config"), F.lit(16).alias("vtype"),
            (F.col("c_nationkey") + t * 10 + e).alias("vdata"),
        )

    def kind(t, name):
        return F.struct(F.lit(t).alias("type_id"), name.alias("name"), F.array(entry(t, 0), entry(t, 1)).alias("entries"))

    packages = v.table("customer").select(
        k.alias("app_id"), F.lit(127).alias("package_id"), F.col("c_mktsegment").alias("package"),
        F.array(kind(1, F.lit("string")), kind(2, F.lit(None).cast("string"))).alias("types"),
    )
    return resources.flatten_resources(packages)
