"""Usage index, class tables, names, searches and roll-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from symloom.catalog.registry import query
from symloom.catalog.views import floordiv
from symloom.functions import masks
from symloom.functions.names import is_obfuscated
from symloom.functions.signatures import class_kind
from symloom.operators import graph, naming, search, shapes, xref
from symloom.session import scratch_folder


@query(
    """WITH @v_class, @v_ref, w AS (SELECT "full", min(cls) AS cls FROM v_class GROUP BY 1),
    u AS (SELECT c."full", r.unit FROM v_ref r JOIN v_class c ON r.target = c.cls)
    SELECT w.cls, u."full", count(*) AS n, count(DISTINCT unit) AS files FROM u JOIN w ON u."full" = w."full"
    GROUP BY 1, 2 ORDER BY n DESC, w.cls LIMIT 20"""
)
def most_used_classes(v):
    """First-wins classes, their uses, and the twenty used most."""
    winners = naming.first_wins(v.v_class.select("full", "cls", "ord"), ["full"], ["ord"])
    spelled = v.v_class.select(F.col("cls").alias("target"), "full")
    # uses are counted per target before names are looked up: the join sees one row per pair
    per_pair = v.v_ref.groupBy("target", "unit").agg(F.count(F.lit(1)).alias("k"))
    per_file = per_pair.join(spelled, "target").groupBy("full", "unit").agg(F.sum("k").alias("k"))
    counted = per_file.groupBy("full").agg(F.sum("k").alias("n"), F.count("unit").alias("files"))
    return (
        counted.join(winners.select("full", "cls"), "full")
        .orderBy(F.desc("n"), "cls").limit(20).select("cls", "full", "n", "files")
    )


@query("WITH @v_ref SELECT target, count(*) AS n, count(DISTINCT unit) AS files FROM v_ref GROUP BY 1")
def usage_counts(v):
    return xref.usage_counts(v.v_ref, "target", "unit")


@query(
    """WITH @v_ref SELECT target, unit, off, price, row_number() OVER (PARTITION BY target
    ORDER BY unit, off, price, qty, shipped, member) AS rank FROM v_ref"""
)
def ranked_usages(v):
    order = ["unit", "off", "price", "qty", "shipped", "member"]
    return xref.ranked_usages(v.v_ref, "target", order).select("target", "unit", "off", "price", "rank")


ANNOTS_SQL = """SELECT method AS unit, idx * 7 AS off, k,
    CASE op WHEN 'signup' THEN 'def' WHEN 'error' THEN 'end' WHEN 'view' THEN 'var' ELSE 'ref' END AS kind,
    CASE k % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'field' ELSE 'package' END AS sk, k AS owner FROM v_step"""
# an explicit stack, one step per annotation
STACK_SQL = f"""a AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY off) AS i FROM ({ANNOTS_SQL})),
    walk AS (SELECT unit, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS stack FROM a GROUP BY unit
      UNION ALL SELECT a.unit, a.i, CASE WHEN kind = 'def' AND sk IN ('class', 'method') THEN list_append(stack, sk || ':' || a.owner)
        WHEN kind = 'end' AND len(stack) > 0 THEN list_slice(stack, 1, len(stack) - 1) ELSE stack END
      FROM walk JOIN a ON a.unit = walk.unit AND a.i = walk.i + 1)"""


def annotated(steps):
    """Steps with their number, operation and a symbol number as annotations of their unit."""
    k, op = F.col("k"), F.col("op")
    kind = F.when(op == "signup", "def").when(op == "error", "end").when(op == "view", "var").otherwise("ref")
    sk = F.when(k % 4 == 0, "class").when(k % 4 == 1, "method").when(k % 4 == 2, "field").otherwise("package")
    sym = F.struct(
        sk.alias("kind"), k.cast("string").alias("owner"), F.lit("n").alias("name"),
        F.array().cast("array<string>").alias("params"),
    )
    app = ["app_id"] if "app_id" in steps.columns else []
    return steps.select(*app, "unit", (F.col("idx") * 7).alias("off"), kind.alias("kind"), sym.alias("sym"))


def annots(v):
    return annotated(v.v_step.withColumnRenamed("method", "unit"))


# annotations of every document, in two apps whose units have equal numbers
_USES_SQL = """n AS (SELECT count(*) AS docs FROM documents),
    e AS (SELECT event_id % docs AS d, ts, event_id, event_type AS op, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events, n),
    a AS (SELECT d, row_number() OVER (PARTITION BY d ORDER BY ts, event_id) AS i, 7 * row_number() OVER (PARTITION BY d ORDER BY ts, event_id) AS off, k AS owner,
      CASE op WHEN 'signup' THEN 'def' WHEN 'error' THEN 'end' WHEN 'view' THEN 'var' ELSE 'ref' END AS kind,
      CASE k % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'field' ELSE 'package' END AS sk FROM e),
    walk AS (SELECT d, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS stack FROM a GROUP BY d
      UNION ALL SELECT a.d, a.i, CASE WHEN kind = 'def' AND sk IN ('class', 'method') THEN list_append(stack, sk || ':' || a.owner)
        WHEN kind = 'end' AND len(stack) > 0 THEN list_slice(stack, 1, len(stack) - 1) ELSE stack END
      FROM walk JOIN a ON a.d = walk.d AND a.i = walk.i + 1),
    u AS (SELECT 'app' || (a.d % 2) AS app_id, a.sk || ':' || a.owner AS target, a.d // 2 AS from_unit, a.off,
      CASE WHEN list_last(w.stack) LIKE 'method:%' THEN list_last(w.stack) END AS from_member,
      1 + length(substr(text, 1, a.off)) - length(replace(substr(text, 1, a.off), chr(10), '')) AS line
      FROM a JOIN walk w ON a.d = w.d AND a.i = w.i JOIN documents ON doc_id = a.d WHERE a.kind = 'ref' AND a.sk <> 'package')"""


def app_of(doc):
    return [F.concat(F.lit("app"), (doc % 2).cast("string")).alias("app_id"), floordiv(doc, 2).alias("unit")]


def index_of_documents(v):
    """Every document is the code of a unit, its share of the events are the annotations."""
    docs = v.table("documents")
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    events = v.table("events").withColumn("d", F.col("event_id") % n)
    w = Window.partitionBy("d").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = annotated(events.select(
        *app_of(F.col("d")), F.row_number().over(w).cast("long").alias("idx"), F.col("event_type").alias("op"), k.alias("k")
    ))
    return xref.usage_index(rows, docs.select(*app_of(F.col("doc_id")), F.col("text").alias("code")))


@query(f"WITH RECURSIVE {_USES_SQL} SELECT * FROM u")
def usage_index(v):
    return index_of_documents(v).select(
        "app_id", F.concat_ws(":", "target.kind", "target.owner").alias("target"), "from_unit", "off",
        F.when(F.col("from_member").isNotNull(), F.concat_ws(":", "from_member.kind", "from_member.owner")).alias("from_member"),
        F.col("line").cast("long").alias("line"),
    )


@query(f"WITH RECURSIVE {_USES_SQL} SELECT app_id, from_unit, off, line FROM u WHERE target = 'class:8'")
def usage_lookup(v):
    """The index stored by target, and one symbol looked up in its bucket."""
    table = f"usage_{uuid.uuid4().hex}"
    xref.write_usage_index(index_of_documents(v), table, scratch_folder(v.spark, "usage"), buckets=64)
    symbol = F.struct(F.lit("class").alias("kind"), F.lit("8").alias("owner"), F.lit("n").alias("name"), F.array().cast("array<string>").alias("params"))
    return xref.usages_of(v.spark, table, symbol).select("app_id", "from_unit", "off", F.col("line").cast("long").alias("line"))


@query('WITH @v_class SELECT "full", min(cls) AS cls FROM v_class GROUP BY 1')
def first_wins_classes(v):
    return naming.first_wins(v.v_class.select("full", "cls", "ord"), ["full"], ["ord"]).select("full", "cls")


@query("WITH @v_doc SELECT md5(code) AS code, min(unit) AS unit, arg_min(cat, unit) AS cat FROM v_doc GROUP BY code")
def first_wins_texts(v):
    """Texts are compared by digest, so no text is shuffled."""
    digests = v.v_doc.select(F.sha2("code", 256).alias("digest"), F.md5("code").alias("code"), "unit", "cat")
    return naming.first_wins(digests, ["digest"], ["unit"]).drop("digest")


@query(
    """WITH @v_class, @v_doc SELECT pkg AS grp, count(*) - count(DISTINCT "full") AS duplicates FROM v_class GROUP BY 1
    UNION ALL SELECT cat, count(*) - count(DISTINCT code) FROM v_doc GROUP BY 1"""
)
def duplicate_count(v):
    classes = naming.duplicate_count(v.v_class, ["pkg"], "full").withColumnRenamed("pkg", "grp")
    texts = naming.duplicate_count(v.v_doc.withColumn("h", F.sha2("code", 256)), ["cat"], "h")
    return classes.unionByName(texts.withColumnRenamed("cat", "grp"))


_ARCHIVES_SQL = """SELECT source AS bundle, CASE WHEN doc_id % 11 = 0 THEN 'x/Base-' || doc_id || '.apk'
    WHEN doc_id % 11 = 1 THEN 'split_config.' || doc_id || '.apk' WHEN doc_id % 11 = 2 THEN 'y/config.' || lang || doc_id || '.apk'
    ELSE 'feature' || doc_id || '.apk' END AS archive FROM documents"""
_PRIORITY_SQL = """CASE WHEN leaf = 'base.apk' THEN 0 WHEN leaf = 'base-master.apk' THEN 1 WHEN leaf LIKE 'base-%' OR leaf LIKE 'base.%'
    OR leaf = 'base' THEN 2 WHEN leaf NOT LIKE '%split%' AND leaf NOT LIKE '%config.%' AND leaf NOT LIKE '%.config%' THEN 3 ELSE 4 END"""


def _archives(v):
    d = F.col("doc_id")
    text = d.cast("string")
    name = (
        F.when(d % 11 == 0, F.concat(F.lit("x/Base-"), text, F.lit(".apk")))
        .when(d % 11 == 1, F.concat(F.lit("split_config."), text, F.lit(".apk")))
        .when(d % 11 == 2, F.concat(F.lit("y/config."), "lang", text, F.lit(".apk")))
        .otherwise(F.concat(F.lit("feature"), text, F.lit(".apk")))
    )
    return v.table("documents").select(F.col("source").alias("bundle"), name.alias("archive"))


@query(
    f"""WITH a AS ({_ARCHIVES_SQL}), l AS (SELECT *, lower(list_last(string_split(archive, '/'))) AS leaf FROM a),
    p AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY {_PRIORITY_SQL}, archive) AS r FROM l)
    SELECT bundle, archive, row_number() OVER (PARTITION BY bundle ORDER BY r <> 1, archive) AS load_order FROM p"""
)
def base_first(v):
    return naming.base_first(_archives(v))


@query(
    f"""WITH a AS ({_ARCHIVES_SQL}), l AS (SELECT *, lower(list_last(string_split(archive, '/'))) AS leaf FROM a),
    p AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY {_PRIORITY_SQL}, archive) AS r FROM l)
    SELECT bundle, archive AS base FROM p WHERE r = 1"""
)
def pick_base(v):
    return naming.pick_base(_archives(v))


@query(
    """WITH @v_class, s AS (SELECT cls, pkg, ord, flags % 3 <> 0 AND cls % 5 <> 0 AS renamable,
      CASE WHEN cls % 5 = 0 THEN 'C' || lpad(CAST(cls // 5 % 9 + 1 AS VARCHAR), CAST(CASE WHEN cls % 2 = 0 THEN 4 ELSE 5 END AS INTEGER), '0') ELSE name END AS name FROM v_class),
    free AS (SELECT pkg, n, row_number() OVER (PARTITION BY pkg ORDER BY n) AS k FROM (
      SELECT p.pkg, n FROM (SELECT pkg, count(*) AS c FROM s GROUP BY pkg) p, LATERAL (SELECT unnest(range(1, 2 * p.c + 2)) AS n)
      ) x WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.pkg = x.pkg AND NOT s.renamable AND s.name = 'C' || lpad(CAST(x.n AS VARCHAR), 4, '0')))
    SELECT r.cls, 'C' || lpad(CAST(n AS VARCHAR), 4, '0') AS alias FROM
    (SELECT cls, pkg, row_number() OVER (PARTITION BY pkg ORDER BY ord) AS k FROM s WHERE renamable) r
    JOIN free f ON r.pkg = f.pkg AND r.k = f.k"""
)
def allocate_names(v):
    c = F.col("cls")
    number = (F.floor(c / 5) % 9 + 1).cast("string")
    made = F.concat(F.lit("C"), F.when(c % 2 == 0, F.lpad(number, 4, "0")).otherwise(F.lpad(number, 5, "0")))
    symbols = v.v_class.select(
        "cls", "pkg", "ord", ((F.col("flags") % 3 != 0) & (c % 5 != 0)).alias("renamable"),
        F.when(c % 5 == 0, made).otherwise(F.col("name")).alias("name"),
    )
    return naming.allocate_names(symbols, ["pkg"], ["ord"], "C").select("cls", "alias")


@query(
    """WITH @v_class, @v_doc, w AS (SELECT DISTINCT cat, unnest(regexp_extract_all(code, '[^ \\n]+')) AS name FROM v_doc),
    t AS (SELECT cat, name, row_number() OVER (PARTITION BY cat ORDER BY name) AS k FROM w
      WHERE length(name) <= 2 AND regexp_full_match(name, '[\\p{L}\\p{Nd}_$]+'))
    SELECT cat, name, 'm' || lpad(CAST(k AS VARCHAR), 4, '0') AS alias FROM t"""
)
def deobfuscate_words(v):
    """Short words of each language as obfuscated method names of one class."""
    words = v.v_doc.select("cat", F.explode(F.split(F.replace("code", F.lit("\n"), F.lit(" ")), " ")).alias("name")).distinct().filter("name <> ''")
    return naming.allocate_names(words.withColumn("renamable", is_obfuscated(F.col("name"))), ["cat"], ["name"], "m").select(
        "cat", "name", "alias"
    )


@query(
    """WITH RECURSIVE @v_class, s AS (SELECT pkg, cls, name || CASE cls % 4 WHEN 1 THEN '2' WHEN 2 THEN '3' ELSE '' END AS base,
      row_number() OVER (PARTITION BY pkg ORDER BY cls) AS i FROM v_class),
    walk AS (SELECT pkg, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS cls, CAST(NULL AS VARCHAR) AS name, CAST([] AS VARCHAR[]) AS used FROM s GROUP BY pkg
      UNION ALL SELECT pkg, i, cls, pick, list_append(used, pick) FROM (
        SELECT s.pkg, s.i, s.cls, used, CASE WHEN NOT list_contains(used, base) THEN base ELSE
          base || list_filter(range(2, len(used) + 3), lambda n: NOT list_contains(used, base || n))[1] END AS pick
        FROM walk JOIN s ON s.pkg = walk.pkg AND s.i = walk.i + 1))
    SELECT cls, name FROM walk WHERE i > 0"""
)
def unique_names(v):
    k = F.col("cls") % 4
    symbols = v.v_class.select(
        "cls", "pkg", "ord", F.concat("name", F.when(k == 1, "2").when(k == 2, "3").otherwise("")).alias("base")
    )
    return naming.unique_names(symbols, ["pkg"], ["ord"], "base").select("cls", "name")


_USES_SQL = """SELECT r.unit, off * 10000000000 + price AS seq, 'economy.brand' || (r.unit % 25) AS own,
    CASE target % 10 WHEN 0 THEN name WHEN 1 THEN 'java.lang.' || name
    WHEN 2 THEN "full" || '$Inner' WHEN 3 THEN "full" || '$1' WHEN 4 THEN "full" || '$Inner$Deep$2' ELSE "full" END AS f FROM v_ref r JOIN v_class c ON r.target = c.cls"""


@query(
    f"""WITH @v_ref, @v_class, u AS ({_USES_SQL}),
    n AS (SELECT *, regexp_replace(f, '\\$[^0-9].*$', '') AS top, regexp_replace(f, '\\$([^0-9])', '.\\1', 'g') AS norm FROM u),
    o AS (SELECT unit, own, f, top, norm, min(seq) AS seq, list_last(string_split(top, '.')) AS simple,
      CASE WHEN position('.' IN top) > 0 THEN substr(top, 1, length(top) - position('.' IN reverse(top))) ELSE '' END AS pkg FROM n GROUP BY 1, 2, 3, 4, 5),
    w AS (SELECT *, first_value(top) OVER (PARTITION BY unit, simple, pkg = '' ORDER BY seq, top) AS owner FROM o)
    SELECT unit, f AS "full", CASE WHEN pkg <> '' AND top = owner THEN substr(norm, length(pkg) + 2) ELSE norm END AS display,
    pkg <> '' AND top = owner AND pkg <> 'java.lang' AND pkg <> own AS imported FROM w"""
)
def import_claims(v):
    t = F.col("target") % 10
    named = (
        F.when(t == 0, F.col("name")).when(t == 1, F.concat(F.lit("java.lang."), "name"))
        .when(t == 2, F.concat("full", F.lit("$Inner"))).when(t == 3, F.concat("full", F.lit("$1")))
        .when(t == 4, F.concat("full", F.lit("$Inner$Deep$2"))).otherwise(F.col("full"))
    )
    uses = v.v_ref.join(v.v_class.select(F.col("cls").alias("target"), "name", "full"), "target").select(
        "unit", (F.col("off").cast("long") * 10000000000 + F.col("price")).alias("seq"),
        F.concat(F.lit("economy.brand"), (F.col("unit") % 25).cast("string")).alias("own_package"), named.alias("full"),
    )
    return naming.import_claims(uses)


@query(
    """WITH @v_edit, t AS (SELECT sym, seq, trim(text) AS text FROM v_edit),
    l AS (SELECT *, lag(text) OVER (PARTITION BY sym ORDER BY seq) AS before,
      row_number() OVER (PARTITION BY sym ORDER BY seq DESC) AS r,
      max(CASE WHEN text = '' THEN seq END) OVER (PARTITION BY sym) AS deleted FROM t),
    f AS (SELECT sym, min(seq) AS listed_at FROM l WHERE deleted IS NULL OR seq > deleted GROUP BY sym)
    SELECT l.sym, text, coalesce(before, '') <> text AS changed, listed_at FROM l JOIN f ON l.sym = f.sym WHERE r = 1 AND text <> ''"""
)
def latest_edits(v):
    return naming.latest_edits(v.v_edit)


@query(
    """WITH @v_edit, t AS (SELECT sym, seq, trim(text) AS text FROM v_edit)
    SELECT sym, seq, text <> coalesce(lag(text) OVER (PARTITION BY sym ORDER BY seq), '') AS changed FROM t"""
)
def edit_changes(v):
    return naming.edit_changes(v.v_edit)


_MEMBERS_SQL = """c AS (SELECT 'app' || (cls % 3) AS app_id, 'n.K' || cls AS cls, CASE WHEN cls % 4 = 0 THEN 'n.K' || super END AS owner, flags, ord FROM v_class),
    f AS (SELECT 'app' || (target % 3) AS app_id, 'n.K' || target AS cls, 'f' || member AS name, CASE WHEN off % 2 = 0 THEN '[Lx/y$Z;' ELSE 'J' END AS t,
      CAST(price % 65536 AS INTEGER) AS flags, off AS ord FROM v_ref WHERE kind = 'A'),
    m AS (SELECT 'app' || (target % 3) AS app_id, 'n.K' || target AS cls, CASE off WHEN 1 THEN '<init>' WHEN 2 THEN '<clinit>' ELSE 'm' || off END AS name, off,
      CAST(price % 65536 AS INTEGER) AS flags, off AS ord FROM v_ref WHERE kind <> 'A')"""


def _mods_sql(**extra: int) -> str:
    words = {"public": 1, "private": 2, "protected": 4, "static": 8, "final": 16, "abstract": 1024, **extra}
    return "concat_ws(' ', " + ", ".join(f"CASE WHEN flags & {b} <> 0 THEN '{w}' END" for w, b in words.items()) + ")"


_FIELD_MODS = _mods_sql(volatile=64, transient=128)
_METHOD_MODS = _mods_sql(synchronized=32, native=256)
_CLASS_MODS = _mods_sql()


@query(
    f"""WITH @v_class, @v_ref, {_MEMBERS_SQL},
    p AS (SELECT *, CASE off % 3 WHEN 0 THEN '' WHEN 1 THEN 'int, String[]' ELSE 'C' END AS ps FROM m)
    SELECT app_id, cls, CAST(0 AS BIGINT) AS section, CAST(ord AS BIGINT) AS ord, 'field' AS kind, name,
      name || ': ' || CASE WHEN t = 'J' THEN 'long' ELSE 'Z[]' END AS signature, {_FIELD_MODS} AS modifiers FROM f WHERE flags & 4096 = 0
    UNION ALL SELECT app_id, cls, 1, ord, CASE name WHEN '<init>' THEN 'constructor' WHEN '<clinit>' THEN 'static_initializer' ELSE 'method' END,
      CASE name WHEN '<init>' THEN substr(cls, 3) WHEN '<clinit>' THEN 'static' ELSE name END,
      CASE name WHEN '<init>' THEN substr(cls, 3) || '(' || ps || ')' WHEN '<clinit>' THEN 'static {{ … }}' ELSE name || '(' || ps || '): void' END,
      {_METHOD_MODS} FROM p WHERE flags & 4096 = 0 AND flags & 64 = 0
    UNION ALL SELECT app_id, owner, 2, ord, 'nested_class', substr(cls, 3), substr(cls, 3), {_CLASS_MODS} FROM c
      WHERE owner IS NOT NULL AND flags & 4096 = 0"""
)
def list_members(v):
    def named(column):
        return F.concat(F.lit("n.K"), F.col(column).cast("string"))

    def app(column):
        return F.concat(F.lit("app"), (F.col(column) % 3).cast("string")).alias("app_id")

    c = v.v_class.select(
        app("cls"), named("cls").alias("cls"), F.when(F.col("cls") % 4 == 0, named("super")).alias("outer"), "flags", "ord"
    )
    off = F.col("off")
    bits = (F.col("price") % 65536).cast("int").alias("flags")
    owner = named("target").alias("cls")
    f = v.v_ref.filter("kind = 'A'").select(
        app("target"), owner, F.concat(F.lit("f"), F.col("member").cast("string")).alias("name"),
        F.when(off % 2 == 0, "[Lx/y$Z;").otherwise("J").alias("type"), bits, off.alias("ord"),
    )
    params = (
        F.when(off % 3 == 0, F.array().cast("array<string>"))
        .when(off % 3 == 1, F.array(F.lit("I"), F.lit("[Ljava/lang/String;")))
        .otherwise(F.array(F.lit("La/b$C;")))
    )
    m = v.v_ref.filter("kind <> 'A'").select(
        app("target"), owner,
        F.when(off == 1, "<init>").when(off == 2, "<clinit>").otherwise(F.concat(F.lit("m"), off.cast("string"))).alias("name"),
        params.alias("params"), F.lit("V").alias("ret"), bits, off.alias("ord"),
    )
    rows = shapes.list_members(c, f, m)
    return rows.withColumns({"section": F.col("section").cast("long"), "ord": F.col("ord").cast("long")})


_TOPS_SQL = """up AS (SELECT cls AS node, cls AS cur FROM v_class
      UNION ALL SELECT node, c.super FROM up JOIN v_class c ON c.cls = up.cur WHERE c.cls >= 40 AND c.super IS NOT NULL),
    tops AS (SELECT node, cur AS top FROM up JOIN v_class c ON c.cls = up.cur WHERE c.cls < 40)"""


def tops(v):
    """Classes below 40 are top level, all others nested in their super."""
    outer = v.v_class.select(F.col("cls").alias("node"), F.when(F.col("cls") >= 40, F.col("super")).alias("parent"))
    return graph.top_ancestor(outer)


@query(
    f"""WITH RECURSIVE @v_class, {_TOPS_SQL}
    SELECT top, CAST(sum(CASE WHEN flags % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors
    FROM tops JOIN v_class c ON c.cls = tops.node GROUP BY top"""
)
def error_rollup(v):
    errors = v.v_class.select("cls", (F.col("flags") % 7 == 0).cast("long").alias("errors"))
    return shapes.error_rollup(errors, tops(v))


@query(
    f"""WITH RECURSIVE @v_class, {_TOPS_SQL}
    SELECT top, bool_and(flags % 11 <> 0) AS ok FROM tops JOIN v_class c ON c.cls = tops.node GROUP BY top"""
)
def fully_structured(v):
    methods = v.v_class.select("cls", (F.col("flags") % 11 != 0).alias("ok"))
    return shapes.fully_structured(methods, tops(v))


@query(
    """WITH @v_class, v AS (SELECT 'app' || (cls % 3) AS app_id, pkg, name, "full" FROM v_class),
    p AS (SELECT DISTINCT app_id, pkg FROM v),
    a AS (SELECT DISTINCT app_id, array_to_string(list_slice(string_split(pkg, '.'), 1, d), '.') AS id
      FROM (SELECT app_id, pkg, unnest(range(1, len(string_split(pkg, '.')) + 1)) AS d FROM p)),
    k AS (SELECT app_id, CASE WHEN position('.' IN id) > 0 THEN split_part(id, '.', 1) ELSE '' END AS parent, id FROM a),
    kids AS (SELECT app_id, parent FROM k UNION ALL SELECT app_id, pkg FROM v)
    SELECT app_id, parent, 'package' AS kind, list_last(string_split(id, '.')) AS label, id, CAST(0 AS BIGINT) AS kind_rank,
      (SELECT count(*) FROM kids WHERE kids.parent = k.id AND kids.app_id = k.app_id) AS n_children FROM k
    UNION ALL SELECT app_id, pkg, 'class', name, "full", 1, 0 FROM v"""
)
def package_tree(v):
    app = F.concat(F.lit("app"), (F.col("cls") % 3).cast("string"))
    return shapes.package_tree(v.v_class.withColumn("app_id", app)).withColumn("kind_rank", F.col("kind_rank").cast("long"))


_COLUMNS = {
    "events.k": ("events", "CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS VARCHAR)"),
    "events.type": ("events", "event_type"),
    "part.name": ("part", "p_name"),
    "part.size": ("part", "CAST(p_size AS VARCHAR)"),
    "part.price": ("part", "CAST(p_retailprice AS VARCHAR)"),
    "orders.status": ("orders", "o_orderstatus"),
    "orders.key": ("orders", "CAST(o_orderkey AS VARCHAR)"),
    "labels.toxic": ("labels", "CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END"),
}
_MET_SQL = " UNION ALL ".join(f"SELECT '{key}' AS value, {expr} AS t FROM {table}" for key, (table, expr) in _COLUMNS.items())


@query(
    f"""WITH x AS ({_MET_SQL}), n AS (SELECT value, t, CASE WHEN regexp_full_match(t, '-?[0-9]+') THEN TRY_CAST(t AS BIGINT) END AS i FROM x),
    m AS (SELECT value, CAST(512
      + CASE WHEN bool_and(coalesce(t IN ('true', 'false'), FALSE)) THEN 1 ELSE 0 END
      + CASE WHEN bool_and(coalesce(i BETWEEN -128 AND 127, FALSE)) THEN 2 ELSE 0 END
      + CASE WHEN bool_and(coalesce(i BETWEEN -32768 AND 32767, FALSE)) THEN 4 ELSE 0 END
      + CASE WHEN bool_and(length(t) = 1) THEN 8 ELSE 0 END
      + CASE WHEN bool_and(coalesce(i BETWEEN -2147483648 AND 2147483647, FALSE)) THEN 16 ELSE 0 END
      + CASE WHEN bool_and(i IS NOT NULL) THEN 32 ELSE 0 END
      + CASE WHEN bool_and(regexp_full_match(t, '-?[0-9]+(\\.[0-9]+)?')) THEN 192 ELSE 0 END AS INTEGER) AS mask FROM n GROUP BY value)
    SELECT value, mask, CASE WHEN mask & 16 <> 0 THEN 'int' WHEN mask & 64 <> 0 THEN 'float' WHEN mask & 32 <> 0 THEN 'long'
      WHEN mask & 128 <> 0 THEN 'double' WHEN mask & 1 <> 0 THEN 'boolean' WHEN mask & 8 <> 0 THEN 'char' WHEN mask & 4 <> 0 THEN 'short'
      WHEN mask & 2 <> 0 THEN 'byte' ELSE 'object' END AS chosen FROM m"""
)
def infer_types(v):
    """Column type inference: every text value of a column narrows what the column can be."""
    def column(table, key, value):
        return v.table(table).select(F.lit(key).alias("value"), masks.kinds_of_text(value).alias("mask"))

    parts = [
        column("events", "events.k", F.get_json_object("props", "$.k")),
        column("events", "events.type", F.col("event_type")),
        column("part", "part.name", F.col("p_name")),
        column("part", "part.size", F.col("p_size").cast("string")),
        column("part", "part.price", F.col("p_retailprice").cast("string")),
        column("orders", "orders.status", F.col("o_orderstatus")),
        column("orders", "orders.key", F.col("o_orderkey").cast("string")),
        column("labels", "labels.toxic", F.when(F.col("toxic") == 1, "true").otherwise("false")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return shapes.infer_types(whole)


@query(
    """SELECT 'p.C' || o_orderkey AS cls FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND o_custkey % 5 <> 0 AND o_custkey % 7 <> 0
    GROUP BY o_orderkey HAVING count(DISTINCT l_linenumber) = count(*) AND max(l_linenumber) = count(*)
    AND bool_and(l_discount <= 0.09)"""
)
def data_classes(v):
    """Orders as classes, their lines as fields and component methods."""
    o = v.table("orders")
    cls = F.concat(F.lit("p.C"), F.col("o_orderkey").cast("string"))
    flags = F.when(F.col("o_orderstatus") != "P", 0x10).otherwise(0) + F.when(
        F.col("o_orderpriority") == "5-LOW", 0x400
    ).otherwise(0)
    kind = F.when(F.col("o_orderstatus") == "F", "I").otherwise("Lx/A;")
    classes = o.select(cls.alias("cls"), flags.alias("flags"))
    lines = v.table("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    each = lines.select(
        cls.alias("cls"), F.col("l_linenumber").alias("ln"), F.xxhash64("l_extendedprice", "l_shipdate").alias("h"),
        F.when(F.col("l_discount") > 0.09, "Z").otherwise(kind).alias("type"), kind.alias("kind"), "o_custkey",
    )
    fields = each.select("cls", "type", F.lit(0).alias("flags"), F.struct("ln", "h").alias("ord"))
    component = each.select(
        "cls", F.concat(F.lit("component"), F.col("ln").cast("string")).alias("name"),
        F.array().cast("array<string>").alias("params"), F.col("type").alias("ret"),
    )
    sized = each.groupBy("cls", "kind", "o_custkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    types = F.array_repeat("kind", F.col("n"))
    none = F.array().cast("array<string>")
    desc = F.concat(F.lit("L"), F.translate("cls", ".", "/"), F.lit(";"))

    def method(name, params, ret, when=None):
        rows = sized if when is None else sized.filter(when)
        return rows.select("cls", F.lit(name).alias("name"), params.alias("params"), ret.alias("ret"))

    methods = (
        component.unionByName(method("<init>", types, F.lit("V")))
        .unionByName(method("copy", types, desc, F.col("o_custkey") % 5 != 0))
        .unionByName(method("equals", F.array(F.lit("Ljava/lang/Object;")), F.lit("Z")))
        .unionByName(method("hashCode", none, F.lit("I")))
        .unionByName(method("toString", none, F.lit("Ljava/lang/String;"), F.col("o_custkey") % 7 != 0))
        .withColumn("ord", F.lit(0))
    )
    return shapes.data_classes(classes, fields, methods)


# --- search ----------------------------------------------------------------------------------

_LINES_SQL = """r AS (SELECT unit, regexp_replace(code, '\\r\\n|\\r', chr(10), 'g') AS code FROM v_doc WHERE code IS NOT NULL),
    l AS (SELECT unit, unnest(string_split(code, chr(10))) AS t, generate_subscripts(string_split(code, chr(10)), 1) AS line FROM r)"""


@query(
    f"""WITH @v_doc, {_LINES_SQL} SELECT unit, unit AS ord, line, regexp_replace(t, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS snippet
    FROM l WHERE contains(lower(t), 'tion th') ORDER BY unit, line"""
)
def search_code(v):
    found = search.search_code(v.v_doc, "Tion th")
    return found.withColumn("line", F.col("line").cast("long"))


@query(
    f"""WITH @v_doc, {_LINES_SQL} SELECT unit, line, md5(t) AS text FROM l WHERE regexp_matches(t, '\\b[a-z]+ed\\b the')"""
)
def search_regex(v):
    found = search.matching_lines(v.v_doc.select("unit", "code"), "\\b[a-z]+ed\\b the", ignore_case=False, regex=True)
    return found.select("unit", F.col("line").cast("long").alias("line"), F.md5("text").alias("text"))


@query(
    f"""WITH @v_doc, {_LINES_SQL}, h AS (SELECT unit, row_number() OVER (ORDER BY unit, line) AS i FROM l WHERE contains(lower(t), 'tion th')),
    s AS (SELECT count(*) AS n, (SELECT unit FROM h WHERE i = 301) AS stop FROM h)
    SELECT (SELECT count(*) FROM v_doc WHERE stop IS NULL OR unit <= stop) AS scanned, (SELECT count(*) FROM v_doc) AS total,
    least(n, 300) AS matches, CAST(0 AS BIGINT) AS failed, n > 300 AS truncated FROM s"""
)
def search_summary(v):
    return search.search_summary(v.v_doc, "tion th", search.CODE_CAP)


@query(
    """WITH @v_doc, p AS (SELECT unit, unnest(string_split(lower(code), 'the')) AS piece,
      generate_subscripts(string_split(lower(code), 'the'), 1) AS i FROM v_doc),
    s AS (SELECT unit, i, max(i) OVER (PARTITION BY unit) AS last, sum(length(piece) + 3) OVER (PARTITION BY unit ORDER BY i) AS upto FROM p)
    SELECT unit, CAST(upto - 3 AS BIGINT) AS start, CAST(upto AS BIGINT) AS "end" FROM s WHERE i < last"""
)
def match_spans(v):
    return search.match_spans(v.v_doc.select("unit", "code"), "the")


@query(
    """WITH @v_class SELECT cls AS ord, CASE WHEN flags & 8192 <> 0 THEN 'annotation' WHEN flags & 16384 <> 0 THEN 'enum'
      WHEN flags & 512 <> 0 THEN 'interface' ELSE 'class' END AS kind, name AS label, pkg || ':' || cls AS signature FROM v_class
    WHERE (contains(name, 'ring') OR contains(pkg || ':' || cls, 'brand2.')) AND (flags & 8192 <> 0 OR flags & 24576 = 0 AND flags & 512 = 0)
    ORDER BY cls"""
)
def search_members(v):
    members = v.v_class.select(
        "ord", class_kind(F.col("flags")).alias("kind"), F.col("name").alias("label"),
        F.concat_ws(":", "pkg", F.col("cls").cast("string")).alias("signature"),
    )
    both = members.filter(F.col("kind").isNotNull())
    return search.search_members(both, "RING|brand2\\.", ["annotation", "class"], regex=True)


@query(
    """WITH @v_class, c AS (SELECT DISTINCT CASE WHEN cls % 6 = 0 THEN name ELSE "full" END AS f FROM v_class)
    SELECT f AS "full", list_last(string_split(f, '.')) AS title,
    CASE WHEN position('.' IN f) > 0 THEN substr(f, 1, length(f) - position('.' IN reverse(f))) ELSE '(default package)' END AS subtitle
    FROM c WHERE contains(f, 'brand1') OR contains(f, 'red') ORDER BY f"""
)
def search_classes(v):
    names = v.v_class.select(F.when(F.col("cls") % 6 == 0, F.col("name")).otherwise(F.col("full")).alias("full")).distinct()
    return search.search_classes(names, " (BRAND1|red) ", regex=True)


@query(
    """WITH @v_doc, c AS (SELECT cat, count(*) AS n FROM v_doc GROUP BY cat)
    SELECT cat, least(n, 60) AS shown, 60 < n AS has_more, 'showing ' || least(n, 60) || ' of ' || n || CASE WHEN n >= 300 THEN '+' ELSE '' END AS label FROM c"""
)
def result_page(v):
    counts = v.v_doc.groupBy("cat").agg(F.count(F.lit(1)).alias("n"))
    page = search.result_page(F.col("n"), F.lit(search.PAGE_SIZE), F.col("n") >= search.CODE_CAP)
    return counts.select("cat", page.alias("p")).select("cat", "p.shown", "p.has_more", "p.label")
