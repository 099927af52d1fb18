"""Lookups by position and questions about rows in instruction order."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.catalog.registry import query
from symloom.catalog.table_queries import STACK_SQL, annots
from symloom.operators import positions
from symloom.plans.ordered import lead, scan
from symloom.session import cut


@query(
    f"""WITH RECURSIVE @v_step, {STACK_SQL}
    SELECT a.unit, a.off, list_last(w.stack) AS encl FROM a JOIN walk w ON a.unit = w.unit AND a.i = w.i"""
)
def enclosing_definition(v):
    placed = positions.enclosing(annots(v))
    return placed.select(
        "unit", "off", F.when(F.col("encl").isNotNull(), F.concat_ws(":", "encl.kind", "encl.owner")).alias("encl")
    )


@query(
    """WITH @v_step, c AS (SELECT method, idx, "at" AS t FROM v_step WHERE op = 'purchase'),
    r AS (SELECT method, "at" AS t, id FROM v_step WHERE op <> 'purchase')
    SELECT c.method, c.idx, r.id AS hit FROM c ASOF LEFT JOIN r ON c.method = r.method AND c.t >= r.t"""
)
def asof_floor(v):
    """Latest step of another kind at or before each purchase."""
    left = v.v_step.filter("op = 'purchase'").select("method", "idx", "at")
    right = v.v_step.filter("op <> 'purchase'").select("method", F.col("at").alias("r_at"), F.col("id").alias("hit"))
    return positions.asof(left, right, ["method"], "at", "r_at", ["hit"], tie=["hit"]).select("method", "idx", "hit")


@query(
    """WITH @v_range, @v_ref, l AS (SELECT id, grp, s FROM v_range)
    SELECT l.id, (SELECT max(o.s) FROM v_range o WHERE o.grp = l.grp AND o.s < l.s) AS before,
    (SELECT min(o.s) FROM v_range o WHERE o.grp = l.grp AND o.s > l.s) AS after,
    (SELECT min(o.s) FROM v_range o WHERE o.grp = l.grp AND o.s >= l.s + 1) AS ceil_next FROM l"""
)
def asof_strict_and_ceil(v):
    """Days of the previous and the next order of the same customer."""
    left = v.v_range.select("id", "grp", "s", (F.col("s") + 1).alias("s1"))
    right = v.v_range.select("grp", F.col("s").alias("at"))
    hits = right.select("grp", "at", F.col("at").alias("before"), F.col("at").alias("after"), F.col("at").alias("ceil_next"))
    found = positions.asof(left, hits, ["grp"], "s", "at", ["before"], "floor", strict=True)
    found = positions.asof(found, hits, ["grp"], "s", "at", ["after"], "ceil", strict=True)
    found = positions.asof(found, hits, ["grp"], "s1", "at", ["ceil_next"], "ceil")
    return found.select("id", "before", "after", "ceil_next")


@query(
    """WITH @v_step, @v_edit SELECT s.method, s.idx, e.text AS hit FROM v_step s LEFT JOIN
    (SELECT sym, seq, text FROM v_edit WHERE text <> '') e ON e.sym = s.method AND e.seq = s.id"""
)
def position_exact(v):
    left = v.v_step.select("method", "idx", F.col("id").alias("at"))
    right = v.v_edit.filter("text <> ''").select(F.col("sym").alias("method"), F.col("seq").alias("r"), F.col("text").alias("hit"))
    return positions.asof(left, right, ["method"], "at", "r", ["hit"], "exact").select("method", "idx", "hit")


@query(
    """WITH @v_doc, l AS (SELECT unit, unnest(string_split(code, chr(10))) AS t, generate_subscripts(string_split(code, chr(10)), 1) AS line FROM v_doc)
    SELECT unit, line, CAST(coalesce(sum(length(t) + 1) OVER (PARTITION BY unit ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_off FROM l"""
)
def line_starts(v):
    found = positions.line_starts(v.v_doc.select("unit", "code"))
    return found.select("unit", F.col("line").cast("long").alias("line"), F.col("start_off").cast("long").alias("start_off"))


_BLOCKS_SQL = """b AS (SELECT method, idx, op, lag(op) OVER (PARTITION BY method ORDER BY idx) AS prev FROM v_step),
    n AS (SELECT method, idx, op, CAST(sum(CASE WHEN prev IS NULL OR prev IN ('purchase', 'error') THEN 1 ELSE 0 END)
      OVER (PARTITION BY method ORDER BY idx) AS BIGINT) AS block FROM b)"""


def _insns(v):
    return v.v_step.select(
        F.col("method").alias("method_key"), F.col("idx").alias("off"), "op", "k",
        F.col("op").isin("purchase", "error").alias("terminator"),
        F.array().cast("array<bigint>").alias("targets"),
    )


@query(f"WITH @v_step, {_BLOCKS_SQL} SELECT method AS method_key, idx AS off, block FROM n")
def number_blocks(v):
    insns = _insns(v)
    starts = positions.leaders(insns)
    return positions.number_blocks(insns, starts).select("method_key", "off", "block")


@query(
    """WITH @v_step, t AS (SELECT method, idx + k % 7 + 1 AS target FROM v_step WHERE op = 'click'),
    m AS (SELECT method, max(idx) AS size FROM v_step GROUP BY 1)
    SELECT DISTINCT method AS method_key, off FROM (
      SELECT method, idx AS off FROM v_step WHERE idx = 1
      UNION ALL SELECT s.method, idx + 1 FROM v_step s JOIN m ON m.method = s.method WHERE op IN ('purchase', 'error') AND idx < size
      UNION ALL SELECT t.method, target FROM t JOIN m ON m.method = t.method WHERE target <= size
      UNION ALL SELECT s.method, idx FROM v_step s WHERE op = 'signup'
      UNION ALL SELECT s.method, least(idx + 3, size) + 1 FROM v_step s JOIN m ON m.method = s.method WHERE op = 'signup' AND idx + 3 < size
      UNION ALL SELECT s.method, greatest(idx - 1, 1) FROM v_step s WHERE op = 'signup')"""
)
def block_leaders(v):
    """Leaders with jump targets, and a protected range of four rows from each signup."""
    size = v.v_step.groupBy("method").agg(F.max("idx").alias("size"))
    rows = cut(v.v_step.select("method", "idx", "op", "k").join(size, "method"))
    target = F.col("idx") + F.col("k") % 7 + 1
    jumps = F.when((F.col("op") == "click") & (target <= F.col("size")), F.array(target)).otherwise(
        F.array().cast("array<bigint>")
    )
    insns = rows.select(
        F.col("method").alias("method_key"), F.col("idx").alias("off"),
        F.col("op").isin("purchase", "error").alias("terminator"), jumps.alias("targets"),
    )
    handler = F.struct(F.lit("E").alias("type"), F.greatest(F.col("idx") - 1, F.lit(1)).alias("off"))
    tries = rows.filter("op = 'signup'").select(
        F.col("method").alias("method_key"), F.col("idx").alias("start_off"),
        F.least(F.col("idx") + 3, F.col("size")).alias("end_off"), F.array(handler).alias("handlers"),
    )
    return positions.leaders(insns, tries).select("method_key", "off")


@query(
    f"""WITH @v_step, {_BLOCKS_SQL}, x AS (SELECT *, lead(block) OVER (PARTITION BY method ORDER BY idx) AS nb FROM n),
    w AS (SELECT * FROM x WHERE nb IS NULL OR nb <> block)
    SELECT DISTINCT method AS method_key, block AS src, dst FROM (
      SELECT method, block, nb AS dst FROM w WHERE op <> 'error' AND nb IS NOT NULL
      UNION ALL SELECT method, block, idx % 5 + 1 FROM w WHERE op = 'error')"""
)
def normal_edges(v):
    insns = _insns(v)
    blocked = positions.number_blocks(insns, positions.leaders(insns))
    jump = F.when(F.col("op") == "error", F.array(F.col("off") % 5 + 1)).otherwise(F.array().cast("array<bigint>"))
    rows = blocked.select(
        "method_key", "off", "block", (F.col("op") != "error").alias("falls_through"), jump.alias("target_blocks")
    )
    return positions.normal_edges(rows)


@query(
    """WITH @v_range, b AS (SELECT o_custkey AS grp, l_orderkey AS block,
      CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS at FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT b.grp, b.block, b.at, r.id, count(*) AS n FROM b JOIN v_range r ON r.grp = b.grp AND b.at BETWEEN r.s AND r.e GROUP BY 1, 2, 3, 4"""
)
def points_in_ranges(v):
    """Ship dates that fall into the 30 days after any order of the same customer."""
    at = F.unix_date(F.to_date("l_shipdate")).cast("long")
    points = v.table("lineitem").join(v.table("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("method_key"), F.lit(0).alias("reg"), F.col("l_orderkey").alias("block"), at.alias("off")
    )
    variables = v.v_range.select(
        F.col("grp").alias("method_key"), F.lit(0).alias("reg"), "id", F.col("s").alias("start_off"), F.col("e").alias("end_off")
    )
    found = positions.locals_in_scope(variables, points)
    return found.groupBy(F.col("method_key").alias("grp"), "block", F.col("off").alias("at"), "id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH @v_range, h AS (SELECT DISTINCT grp, id, s FROM v_range),
    e AS (SELECT DISTINCT b.grp, b.id AS src, d.id AS dst FROM v_range b JOIN v_range r ON r.grp = b.grp AND b.s BETWEEN r.s AND r.e
      JOIN h d ON d.grp = b.grp AND d.s = r.s),
    n AS (SELECT grp, id AS src, lead(id) OVER (PARTITION BY grp ORDER BY s, id) AS dst FROM v_range)
    SELECT e.grp AS method_key, e.src, e.dst, n.src IS NULL AS exceptional FROM e LEFT JOIN n ON n.grp = e.grp AND n.src = e.src AND n.dst = e.dst"""
)
def protected_by(v):
    """Orders as blocks at their day; each order protects the next 30 days and is its own handler."""
    blocks = v.v_range.select(F.col("grp").alias("method_key"), F.col("id").alias("block"), F.col("s").alias("first_off"))
    tries = v.v_range.select(
        F.col("grp").alias("method_key"), F.col("s").alias("start_off"), F.col("e").alias("end_off"),
        F.array(F.struct(F.lit("E").alias("type"), F.col("s").alias("off"))).alias("handlers"),
    )
    follow = scan(blocks, ["method_key"], ["first_off", "block"], {"dst": lead(F.col("block"))})
    normal = follow.select("method_key", F.col("block").alias("src"), "dst").filter("dst IS NOT NULL")
    return positions.protected_by(blocks, tries, normal)


@query(
    """WITH @v_range SELECT a.grp, a.id AS id1, b.id AS id2 FROM v_range a JOIN v_range b
    ON a.grp = b.grp AND a.id < b.id AND greatest(a.s, b.s) <= least(a.e, b.e)"""
)
def overlapping_pairs(v):
    return positions.overlapping_pairs(v.v_range, ["grp"], "id", "s", "e")


@query(
    """SELECT o_custkey AS grp, a.id1, a.id2 FROM (
      SELECT x.l_orderkey AS id1, y.l_orderkey AS id2, x.c AS o_custkey FROM
      (SELECT l_orderkey, o_custkey AS c, min(epoch_us(l_shipdate) // 86400000000) AS s, max(epoch_us(l_shipdate) // 86400000000) AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) x JOIN
      (SELECT l_orderkey, o_custkey AS c, min(epoch_us(l_shipdate) // 86400000000) AS s, max(epoch_us(l_shipdate) // 86400000000) AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) y
      ON x.c = y.c AND x.l_orderkey < y.l_orderkey AND x.s <= y.e AND y.s <= x.e) a"""
)
def overlapping_shipments(v):
    """Ranges of very different length: the days from first to last shipment of each order."""
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    ranges = (
        v.table("lineitem").groupBy("l_orderkey").agg(F.min(day).alias("s"), F.max(day).alias("e"))
        .join(v.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("grp")), "l_orderkey")
    )
    return positions.overlapping_pairs(ranges, ["grp"], "l_orderkey", "s", "e")


@query(
    """WITH @v_step, n AS (SELECT method, idx, k, op, lead(idx) OVER (PARTITION BY method ORDER BY idx) AS nx FROM v_step),
    p AS (SELECT method, idx, [k, k + 10] AS rel FROM v_step WHERE op IN ('view', 'click'))
    SELECT n.method AS method_key, n.idx AS off, nx AS "default", coalesce(array_to_string([x + n.idx for x in rel], ','), '') AS targets
    FROM n LEFT JOIN p ON p.method = n.method AND p.idx = n.k % 40 + 1 WHERE n.op = 'signup'"""
)
def attach_payloads(v):
    insns = v.v_step.select(
        F.col("method").alias("method_key"), F.col("idx").alias("off"),
        F.when(F.col("op") == "signup", (F.col("k") % 40 + 1).cast("long")).alias("target"),
    )
    payloads = v.v_step.filter("op IN ('view', 'click')").select(
        F.col("method").alias("method_key"), F.col("idx").alias("off"),
        F.array(F.col("k").cast("long"), F.col("k").cast("long") + 10).alias("targets"),
    )
    return positions.attach_payloads(insns, payloads).select(
        "method_key", "off", "default", F.array_join("targets", ",").alias("targets")
    )


@query(
    """WITH @v_step, e AS (SELECT method, k % 4 AS reg, idx, op, k, lead(idx) OVER (PARTITION BY method, k % 4 ORDER BY idx) AS nx FROM v_step),
    m AS (SELECT method, max(idx) AS size FROM v_step GROUP BY 1)
    SELECT e.method AS method_key, e.reg,
    (SELECT 'v' || b.k FROM e b WHERE b.method = e.method AND b.reg = e.reg AND b.idx <= e.idx AND b.op IN ('signup', 'purchase') ORDER BY b.idx DESC LIMIT 1) AS name,
    CASE WHEN e.op = 'signup' THEN -1 ELSE e.idx END AS start_off, coalesce(nx, size + 4) AS end_off, e.op = 'signup' AS is_param
    FROM e JOIN m ON m.method = e.method WHERE e.op <> 'error' AND EXISTS
    (SELECT 1 FROM e b WHERE b.method = e.method AND b.reg = e.reg AND b.idx <= e.idx AND b.op IN ('signup', 'purchase'))"""
)
def live_ranges(v):
    """Steps as debug events: signup is a parameter, purchase a start, error an end, others restarts."""
    op = F.col("op")
    action = F.when(op == "signup", "param").when(op == "purchase", "start").when(op == "error", "end").otherwise("restart")
    events = v.v_step.select(
        F.col("method").alias("method_key"), (F.col("k") % 4).alias("reg"), F.col("idx").alias("seq"),
        F.col("idx").alias("addr"), action.alias("action"),
        F.concat(F.lit("v"), F.col("k").cast("string")).alias("name"), F.lit("I").alias("type"),
    )
    size = v.v_step.groupBy(F.col("method").alias("method_key")).agg((F.max("idx") + 5).alias("code_size"))
    found = positions.live_ranges(events, size).drop("type")
    return found.withColumns({"start_off": F.col("start_off").cast("long"), "reg": F.col("reg").cast("int")})


@query(
    """WITH @v_step, c AS (SELECT method, idx, k // 15 AS pc, -4 + k % 15 AS ln FROM v_step),
    r AS (SELECT method, idx, least(sum(pc) OVER w, 59) AS off, sum(ln) OVER w AS line FROM c WINDOW w AS (PARTITION BY method ORDER BY idx))
    SELECT method AS method_key, CAST(off AS BIGINT) AS off, CAST(arg_max(line, idx) AS BIGINT) AS line FROM r GROUP BY 1, 2"""
)
def line_table(v):
    rows = v.v_step.select(
        F.col("method").alias("method_key"), "idx", (F.col("k") + positions.FIRST_SPECIAL).alias("code"),
        F.lit(None).cast("long").alias("advance_pc"), F.lit(None).cast("long").alias("advance_line"),
    )
    size = rows.select("method_key").distinct().withColumn("code_size", F.lit(60).cast("long"))
    return positions.line_table(rows, size)


_WRITES_SQL = """w AS (SELECT method, idx, k % 5 AS reg, CASE WHEN op = 'view' THEN NULL WHEN op = 'click' THEN NULL ELSE 'T' || (k % 13) END AS ty,
      op = 'error' AS ca, CASE WHEN op = 'click' THEN k % 3 END AS src FROM v_step WHERE op <> 'purchase')"""


def _writes(v):
    op, k = F.col("op"), F.col("k")
    return v.v_step.filter("op <> 'purchase'").select(
        F.col("method").alias("method_key"), F.col("idx").alias("off"), (k % 5).alias("reg"),
        F.when(~op.isin("view", "click"), F.concat(F.lit("T"), (k % 13).cast("string"))).alias("type"),
        (op == "error").alias("catch_all"), F.when(op == "click", k % 3).alias("src_reg"),
    )


@query(
    f"""WITH RECURSIVE @v_step, {_WRITES_SQL},
    rd AS (SELECT method, idx, k % 5 AS reg FROM v_step WHERE op = 'purchase'),
    chase AS (SELECT rd.method, rd.idx, rd.reg AS at_reg, rd.idx AS at_idx, CAST('go' AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS ty, CAST(NULL AS BOOLEAN) AS ca FROM rd
      UNION ALL SELECT c.method, c.idx, coalesce(w.src, w.reg), w.idx, CASE WHEN w.src IS NULL THEN 'end' ELSE 'go' END, w.ty, w.ca
      FROM chase c JOIN w ON w.method = c.method AND w.reg = c.at_reg AND w.idx < c.at_idx AND c.state = 'go'
      AND NOT EXISTS (SELECT 1 FROM w x WHERE x.method = w.method AND x.reg = w.reg AND x.idx < c.at_idx AND x.idx > w.idx))
    SELECT rd.method AS method_key, rd.idx AS off, rd.reg, c.ty AS type, c.ca AS catch_all FROM rd
    LEFT JOIN chase c ON c.method = rd.method AND c.idx = rd.idx AND c.state = 'end'"""
)
def last_known_type(v):
    """Clicks copy another register, views clear one; purchases ask what theirs holds."""
    reads = v.v_step.filter("op = 'purchase'").select(
        F.col("method").alias("method_key"), F.col("idx").alias("off"), (F.col("k") % 5).alias("reg")
    )
    return positions.last_known_type(_writes(v), reads)


@query(
    """WITH @v_step, n AS (SELECT method, idx, op, lead(op) OVER w AS nop, lead(idx) OVER w AS nidx FROM v_step WHERE op <> 'view'
      WINDOW w AS (PARTITION BY method ORDER BY idx))
    SELECT method AS method_key, idx AS off, CASE WHEN nop = 'purchase' THEN nidx END AS result_off FROM n WHERE op = 'click'"""
)
def pair_results(v):
    rows = v.v_step.select(F.col("method").alias("method_key"), F.col("idx").alias("off"), "op")
    op = F.col("op")
    return positions.pair_results(rows, op == "click", op == "purchase", op == "view")
