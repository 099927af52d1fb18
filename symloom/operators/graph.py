"""Graph questions over keyed edge tables, asked of all methods and apps in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.signatures import BRIDGE, FINAL, STATIC, SYNTHETIC, has_flag
from symloom.plans.apps import APP, has_app, packed, unpacked
from symloom.plans.bounded import solve_groups, split_by_size
from symloom.plans.fixpoint import fresh, grow, sized
from symloom.plans.ordered import lead, row_number, scan
from symloom.session import cut, cut_spread, scratch_folder

# most ancestors that are held as one list
LISTED = 10_000
# most members of a set whose lists are brought together
TOGETHER = 1_000

# Fixed values.
OBJECT = "java.lang.Object"
CATCH_EVERYTHING = ("java.lang.Throwable", "java.lang.Exception")
UNCHECKED_ROOTS = ("java.lang.RuntimeException", "java.lang.Error")
UNCHECKED = (
    "java.lang.RuntimeException java.lang.Error "
    "java.lang.NullPointerException java.lang.IllegalArgumentException "
    "java.lang.IllegalStateException java.lang.IndexOutOfBoundsException "
    "java.lang.ArrayIndexOutOfBoundsException java.lang.StringIndexOutOfBoundsException "
    "java.lang.ClassCastException java.lang.ArithmeticException "
    "java.lang.NumberFormatException java.lang.UnsupportedOperationException "
    "java.lang.NegativeArraySizeException java.lang.ArrayStoreException "
    "java.lang.SecurityException java.lang.IllegalMonitorStateException "
    "java.util.ConcurrentModificationException java.util.NoSuchElementException "
    "java.lang.AssertionError java.lang.OutOfMemoryError java.lang.StackOverflowError "
    "java.lang.ExceptionInInitializerError java.lang.NoClassDefFoundError"
).split()
KNOWN_FINAL = [
    f"java.lang.{name}"
    for name in (
        "String Integer Long Short Byte Character Boolean Float Double Class StringBuilder "
        "StringBuffer Void"
    ).split()
]
PRIMITIVE_NAMES = "boolean byte short char int long float double void".split()


# --- hierarchy -------------------------------------------------------------------------------


def supertype_edges(classes: DataFrame) -> DataFrame:
    """(cls, parent, idx): super is 0, interfaces follow in declared order; with the ``app_id`` of the classes if they have one."""
    app = [APP] if has_app(classes) else []
    up = F.concat(F.array(F.col("super")), F.coalesce("interfaces", F.array().cast(classes.schema["interfaces"].dataType)))
    return (
        classes.select(*app, "cls", F.posexplode(up).alias("idx", "parent"))
        .filter(F.col("parent").isNotNull())
        .select(*app, "cls", "parent", "idx")
    )


def ancestors(edges: DataFrame) -> DataFrame:
    """(cls, anc, depth) for every proper ancestor of edges(cls, parent); depth is the shortest way.

    With an ``app_id`` a class has ancestors in its own app.  Pairs are made as in ``closure``.
    """
    if has_app(edges):
        return unpacked(ancestors(packed(edges, "cls", "parent")), "cls", "anc")
    numbered = cut(edges.filter("cls <> parent").select("cls", "parent").distinct())
    return _handed_down(numbered, False)


def closure(edges: DataFrame) -> DataFrame:
    """(cls, anc, depth, path) for every proper ancestor of edges(cls, parent, idx), without cycles.

    ``path`` is the smallest sequence of edge numbers to the ancestor, which orders ancestors as a
    depth-first walk (super before interfaces) meets them.  Its first step is the lowest edge that
    leads there.  With an ``app_id`` a class has ancestors in its own app.

    A class takes the ancestors of its parents in the round after the last of these is complete, so every pair is made once and
    is not compared with those of earlier rounds.  Classes on or below a cycle are never complete; they are followed round by round.
    """
    if has_app(edges):
        return unpacked(closure(packed(edges, "cls", "parent")), "cls", "anc")
    numbered = cut(edges.filter("cls <> parent").groupBy("cls", "parent").agg(F.min("idx").alias("idx")))
    return _handed_down(numbered, True)


def _handed_down(edges: DataFrame, paths: bool) -> DataFrame:
    """Ancestors of edges that are distinct and no loops, with their paths or without.

    Pairs of a class are carried on while it has a child that is not complete; all pairs of a round are a folder of the result.
    """
    spark = edges.sparkSession
    folder = scratch_folder(spark, "ancestors")
    step = [F.struct("idx", "parent", F.array().cast("array<int>").alias("more")).alias("step")] if paths else []
    direct = lambda df: df.select("cls", F.col("parent").alias("anc"), F.lit(1).alias("depth"), *step)
    further = [F.struct("idx", "parent", F.col("path").alias("more")).alias("step")] if paths else []

    def settled(found: DataFrame) -> DataFrame:
        best = [F.min("step").alias("step")] if paths else []
        out = found.groupBy("cls", "anc").agg(F.min("depth").cast("int").alias("depth"), *best)
        path = [F.concat(F.array("step.idx").cast("array<int>"), "step.more").alias("path")] if paths else []
        return out.select("cls", "anc", "depth", *path)

    shape = settled(direct(edges)).schema
    waiting, carried, left, rounds = edges, None, edges.count(), 0
    while left:
        later = fresh(waiting).select(F.col("cls").alias("parent")).distinct()
        late = fresh(waiting).join(later, "parent", "left_semi").select("cls").distinct().withColumn("__late", F.lit(True))
        marked = cut(waiting.join(late, "cls", "left"))
        ready, waiting = marked.filter("__late IS NULL").drop("__late"), marked.filter("__late").drop("__late")
        now = waiting.count()
        if now == left:
            break
        found = direct(ready)
        if carried is not None:
            up = fresh(carried).withColumnRenamed("cls", "parent")
            found = found.unionByName(fresh(ready).join(up, "parent").select("cls", "anc", (F.col("depth") + 1).alias("depth"), *further))
        settled(found).write.parquet(f"{folder}/{rounds}")
        made = spark.read.schema(shape).parquet(f"{folder}/{rounds}")
        rounds, left = rounds + 1, now
        if left:
            wanted = fresh(waiting).select(F.col("parent").alias("cls")).distinct()
            carried = cut((made if carried is None else carried.unionByName(made)).join(wanted, "cls", "left_semi").select(*shape.names))
    out = spark.read.schema(shape).parquet(f"{folder}/*") if rounds else settled(direct(edges.limit(0)))
    if not left:
        return out
    circular = waiting.select("cls").distinct()
    above = grow(circular, lambda new: new.join(fresh(edges), "cls").select(F.col("parent").alias("cls")))
    around = cut(edges.join(fresh(above), "cls", "left_semi").select(*edges.columns))
    walked = (_closure_by_rounds if paths else _ancestors_by_rounds)(around)
    return out.unionByName(walked.join(fresh(circular), "cls", "left_semi").select(*shape.names))


def _ancestors_by_rounds(edges: DataFrame) -> DataFrame:
    up = cut_spread(edges.select(F.col("cls").alias("anc"), F.col("parent").alias("up")).distinct())
    base = edges.select("cls", F.col("parent").alias("anc"), F.lit(1).alias("depth")).filter("cls <> anc")

    def step(delta: DataFrame) -> DataFrame:
        return delta.join(fresh(up), "anc").filter(F.col("up") != F.col("cls")).select(
            "cls", F.col("up").alias("anc"), (F.col("depth") + 1).alias("depth")
        )

    # a pair is new in the round that equals its distance, so the first depth found is the least
    return grow(base, step, ["cls", "anc"])


def _closure_by_rounds(edges: DataFrame) -> DataFrame:
    """Steps are put together by doubling, so rounds of the paths grow with the log of the depth.

    A step to a class of the same cycle is taken only where it leads nearer, or ways would go round for ever.
    """
    reached = _ancestors_by_rounds(edges)
    back = fresh(reached).select(F.col("cls").alias("parent"), F.col("anc").alias("cls"), F.lit(True).alias("circular"))
    numbered = edges.groupBy("cls", "parent").agg(F.min("idx").alias("idx")).join(back, ["cls", "parent"], "left")
    direct = numbered.select("cls", F.col("parent").alias("anc"), "idx", "parent")
    further = numbered.join(
        fresh(reached).select(F.col("cls").alias("parent"), "anc", F.col("depth").alias("rest")), "parent"
    ).join(fresh(reached), ["cls", "anc"]).filter("circular IS NULL OR rest < depth").select("cls", "anc", "idx", "parent")
    first = direct.unionByName(further).groupBy("cls", "anc").agg(
        F.min(F.struct("idx", "parent")).alias("s")
    )
    state = cut(
        first.filter("cls <> anc").select("cls", "anc", F.col("s.parent").alias("at"), F.array("s.idx").alias("path"))
    )
    while not state.filter("at <> anc").isEmpty():
        rest = fresh(state).select(
            F.col("cls").alias("at"), "anc", F.col("at").alias("on"), F.col("path").alias("more")
        )
        state = cut(
            state.join(rest, ["at", "anc"], "left").select(
                "cls", "anc", F.coalesce("on", "at").alias("at"),
                F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"),
            )
        )
    return reached.join(state.select("cls", "anc", "path"), ["cls", "anc"])


def with_object(closed: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds the root type as an ancestor of every loaded class (of its app) that does not reach it."""
    keys = [*([APP] if has_app(closed, classes) else []), "cls"]
    missing = classes.select(*keys).filter(F.col("cls") != OBJECT).join(
        closed.filter(F.col("anc") == OBJECT).select(*keys), keys, "left_anti"
    )
    deepest = F.array().cast("array<int>")
    return closed.unionByName(
        missing.select(*keys, F.lit(OBJECT).alias("anc"), F.lit(None).cast("int").alias("depth"), deepest.alias("path"))
    )


def top_ancestor(child_parent: DataFrame) -> DataFrame:
    """(node, top) up the parent chain, by pointer doubling: rounds grow with log of the depth.

    ``child_parent(node, parent)`` with null or absent parents at the top.  Nodes that only lead
    into a cycle have no top.
    """
    state = cut(child_parent.select("node", F.col("parent").alias("up")))
    nodes = state.select("node").distinct()
    roots = state.filter(F.col("up").isNull()).select("node", F.col("node").alias("top"))
    dangling = (
        state.filter(F.col("up").isNotNull()).select(F.col("up").alias("node")).distinct()
        .join(nodes, "node", "left_anti")
        .select("node", F.col("node").alias("top"))
    )
    done = cut(roots.unionByName(dangling))
    active = cut(state.filter(F.col("up").isNotNull()))
    finished = [roots]
    left = active.count()
    while left:
        ends = fresh(done).select(F.col("node").alias("up"), "top")
        arrived = cut(active.join(ends, "up").select("node", "top"))
        finished.append(arrived)
        jump = fresh(active).select(F.col("node").alias("up"), F.col("up").alias("up2"))
        moved = cut(active.join(jump, "up").select("node", F.col("up2").alias("up")))
        done = cut(fresh(done).unionByName(arrived))
        now = moved.count()
        if now == left and arrived.isEmpty():
            break
        active, left = moved, now
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return nodes.join(out, "node", "left")


def on_cycle(child_parent: DataFrame) -> DataFrame:
    """(node, cycle) for nodes of child_parent(node, parent) that lie on a cycle.

    A node has one parent at most (of several the smallest counts).  Pointers double: after 2^k jumps a node that leads to a top has run out,
    and with 2^k at the number of nodes that are left, every pointer stands on a cycle; all nodes of a cycle are stood
    on.  ``cycle`` is its smallest node, found by doubling too.  Rounds grow with the log of the longest chain, and with that of the
    number of nodes that lead into a cycle.
    """
    links = cut(child_parent.filter(F.col("parent").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent")))
    state, jumps = links, 1
    left = state.count()
    while left and jumps < left:
        ahead = fresh(state).select(F.col("node").alias("parent"), F.col("parent").alias("__far"))
        state = cut(state.join(ahead, "parent").select("node", F.col("__far").alias("parent")))
        left, jumps = state.count(), 2 * jumps
    circular = cut(state.select(F.col("parent").alias("node")).distinct())
    size = circular.count()
    inside = links.join(fresh(circular), "node", "left_semi")
    state = cut(inside.select("node", F.col("parent").alias("at"), F.least("node", "parent").alias("cycle")))
    for _ in range(size.bit_length()):
        ahead = fresh(state).select(F.col("node").alias("at"), F.col("at").alias("__far"), F.col("cycle").alias("__least"))
        state = cut(state.join(ahead, "at").select("node", F.col("__far").alias("at"), F.least("cycle", "__least").alias("cycle")))
    return state.select("node", "cycle")


def _shape(name: Column) -> tuple[Column, Column, Column]:
    base = F.regexp_replace(name, "(\\[\\])+$", "")
    dims = F.floor((F.length(name) - F.length(base)) / 2)
    return base, dims, base.isin(*PRIMITIVE_NAMES)


def subtype(pairs: DataFrame, closed: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs(sub, sup) with ``relation``: yes, no (provably not) or unknown.

    Types are display names, arrays end in ``[]``.  Reference arrays are covariant, primitive ones
    are not.  A negative answer is proved when sup is final or both classes are loaded.  With an ``app_id`` in all three, both
    types are those of one app.
    """
    app = [APP] if has_app(pairs, closed, classes) else []
    sb, sd, sp = _shape(F.col("sub"))
    pb, pd, pp = _shape(F.col("sup"))
    shaped = pairs.withColumns({"__sb": sb, "__sd": sd, "__sp": sp, "__pb": pb, "__pd": pd, "__pp": pp})
    known = closed.select(*app, F.col("cls").alias("__sb"), F.col("anc").alias("__pb")).distinct()
    hit = shaped.join(known.withColumn("__up", F.lit(True)), [*app, "__sb", "__pb"], "left")
    flags = classes.select(*app, "cls", "flags").groupBy(*app, "cls").agg(F.max("flags").alias("flags"))
    hit = hit.join(flags.select(*app, F.col("cls").alias("__sb"), F.lit(True).alias("__sub_in")), [*app, "__sb"], "left")
    hit = hit.join(
        flags.select(*app, F.col("cls").alias("__pb"), F.col("flags").alias("__sup_flags")), [*app, "__pb"], "left"
    )
    reference = ~F.col("__sp") | (F.col("__sd") > 0)
    yes = (
        (F.col("sub") == F.col("sup"))
        | ((F.col("__pb") == OBJECT) & (F.col("__pd") == 0) & reference)
        | ((F.col("__pb") == OBJECT) & (F.col("__sd") > F.col("__pd")))
        | (
            (F.col("__sd") == F.col("__pd")) & ~F.col("__sp") & ~F.col("__pp")
            & ((F.col("__pb") == OBJECT) | F.coalesce("__up", F.lit(False)))
        )
    )
    plain = (F.col("__sd") == 0) & (F.col("__pd") == 0) & ~F.col("__sp") & ~F.col("__pp")
    loaded_sup = F.col("__sup_flags").isNotNull()
    final = F.when(loaded_sup, has_flag(F.col("__sup_flags"), FINAL)).otherwise(F.col("__pb").isin(*KNOWN_FINAL))
    no = plain & (final | (F.coalesce("__sub_in", F.lit(False)) & loaded_sup))
    return hit.select(
        *pairs.columns, F.when(yes, "yes").when(no, "no").otherwise("unknown").alias("relation")
    )


def common_supertype(pairs: DataFrame, closed: DataFrame, root: str | int = OBJECT, listed: int = LISTED) -> DataFrame:
    """pairs(…, a, b) with ``joined``: the nearest type both are assignable to.

    The general one if one is assignable to the other, else the first type of a's chain (super spine
    first, then interfaces) that b reaches, else the root type.  With an ``app_id`` on both sides, a and b are classes of one app.

    Each class has its ancestors as one list in that order, and a pair takes the first of a's that is among b's, so a pair stays one
    row.  A class with more than ``listed`` ancestors gets no list; its pairs are joined with single ancestors.
    """
    app = [APP] if has_app(pairs, closed) else []
    rank = F.struct(
        (F.aggregate("path", F.lit(0), lambda acc, x: acc + x) > 0).alias("x"),
        F.coalesce("depth", F.lit(2**31 - 1)).alias("depth"), "path", "anc"
    )
    ranked = cut(closed.select(*app, "cls", "anc", rank.alias("rank")))
    wide = cut(ranked.groupBy(*app, "cls").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > listed).select(*app, "cls"))
    if wide.isEmpty():
        return _joined_by_lists(pairs, ranked, app, root)
    marked = pairs
    for side in ("a", "b"):
        flag = fresh(wide).withColumnRenamed("cls", side).withColumn(f"__{side}", F.lit(True))
        marked = marked.join(flag, [*app, side], "left")
    is_wide = F.coalesce("__a", "__b", F.lit(False))
    by_rows = _joined_by_rows(marked.filter(is_wide).select(*pairs.columns), ranked, app, root)
    narrow = ranked.join(fresh(wide), [*app, "cls"], "left_anti")
    by_lists = _joined_by_lists(marked.filter(~is_wide).select(*pairs.columns), narrow, app, root)
    return by_lists.unionByName(by_rows.select(*by_lists.columns))


def _joined_by_lists(pairs: DataFrame, ranked: DataFrame, app: list[str], root: str | int) -> DataFrame:
    lists = ranked.groupBy(*app, "cls").agg(F.array_sort(F.collect_list("rank"))["anc"].alias("__up"))
    out = pairs
    for side in ("a", "b"):
        up = fresh(lists).select(*app, F.col("cls").alias(side), F.col("__up").alias(f"__up_{side}"))
        out = out.join(up, [*app, side], "left")
    chain = {side: F.concat(F.array(side), F.coalesce(f"__up_{side}", F.array().cast(lists.schema["__up"].dataType))) for side in ("a", "b")}
    # an intersection keeps the order of its first list
    first = F.get(F.array_intersect(chain["a"], chain["b"]), F.lit(0))
    return out.select(*pairs.columns, F.coalesce(first, F.lit(root)).alias("joined"))


def _joined_by_rows(pairs: DataFrame, ranked: DataFrame, app: list[str], root: str | int) -> DataFrame:
    up_a = fresh(ranked).select(*app, F.col("cls").alias("a"), "anc", "rank")
    up_b = fresh(ranked).select(*app, F.col("cls").alias("b"), "anc")
    top = F.struct(F.lit(False).alias("x"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path"), F.col("a").alias("anc"))
    both = pairs.select(*app, "a", "b").distinct()
    via_a = both.join(up_a, [*app, "a"]).unionByName(both.withColumn("anc", F.col("a")).withColumn("rank", top))
    reach_b = both.join(up_b, [*app, "b"]).unionByName(both.withColumn("anc", F.col("b")))
    met = via_a.join(reach_b.select(*app, "a", "b", "anc"), [*app, "a", "b", "anc"])
    best = met.groupBy(*app, "a", "b").agg(F.min_by("anc", "rank").alias("joined"))
    return pairs.join(best, [*app, "a", "b"], "left").withColumn("joined", F.coalesce("joined", F.lit(root)))


def deepest_common(sets: DataFrame, closed: DataFrame, depth: DataFrame, listed: int = LISTED, together: int = TOGETHER) -> DataFrame:
    """sets(set, node) -> (set, ancestor): the deepest node that is an ancestor of all, self included.

    ``closed(cls, anc)``; ``depth(anc, level)``.  Nodes are numbered from the top down, and each has one sorted list of the numbers
    of its ancestors and itself.  A member takes that list to its set and stays one row; the answer is the largest number that
    all lists of the set hold.  Sets of more than ``together`` members, or with one of more than ``listed`` ancestors, are counted by single ancestors.
    """
    members = sets.select("set", "node").filter("set IS NOT NULL")
    large = cut(members.groupBy("set").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > together).select("set"))
    wide = cut(closed.groupBy(F.col("cls").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > listed).select("node"))
    if large.isEmpty() and wide.isEmpty():
        return _deepest_by_lists(members, closed, depth)
    apart = cut(large.unionByName(members.join(sized(wide, wide.count()), "node", "left_semi").select("set")).distinct())
    n = apart.count()
    by_rows = _deepest_by_rows(members.join(sized(apart, n), "set", "left_semi"), closed, depth)
    narrow = closed.join(sized(wide, wide.count()).withColumnRenamed("node", "cls"), "cls", "left_anti")
    return _deepest_by_lists(members.join(sized(apart, n), "set", "left_anti"), narrow, depth).unionByName(by_rows)


def _deepest_by_lists(members: DataFrame, closed: DataFrame, depth: DataFrame) -> DataFrame:
    both = closed.select(F.explode(F.array("cls", "anc")).alias("anc")).filter("anc IS NOT NULL").distinct()
    level = depth.groupBy("anc").agg(F.max(F.coalesce("level", F.lit(0))).alias("level"))
    nodes = cut(both.join(level, "anc", "left").select("anc", F.coalesce("level", F.lit(0)).alias("level")))
    numbered = scan(nodes, [], ["level", "anc"], {"id": row_number()}, True)
    ids = cut(numbered.select("anc", F.col("id").cast("int" if nodes.count() < 2**31 else "long").alias("id")))
    up = closed.select(F.col("cls").alias("node"), "anc").join(fresh(ids), "anc").select("node", "id")
    itself = fresh(ids).select(F.col("anc").alias("node"), "id")
    # neighbours in a list's order share their tops, which is what a shuffle packs well
    lists = up.unionByName(itself).groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # a node that the hierarchy does not know has no ancestor but itself
    placed = members.join(lists, "node", "left").select("set", "ids", F.when(F.col("ids").isNull(), F.col("node")).alias("lone"))
    found = placed.groupBy("set").agg(
        F.collect_list("ids").alias("lists"), F.count(F.lit(1)).alias("n"), F.count("lone").alias("named"), F.min("lone").alias("least"), F.max("lone").alias("most")
    )
    rest = F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0)))
    common = F.aggregate(rest, F.get("lists", F.lit(0)), lambda acc, ids: F.array_intersect(acc, ids))
    alone = (F.size("lists") == 0) & F.col("least").eqNullSafe(F.col("most")) & F.col("named").isin(F.lit(0), F.col("n"))
    best = found.select("set", F.when(F.size("lists") == F.col("n"), F.array_max(common)).alias("id"), alone.alias("alone"), "least")
    met = best.filter(F.col("alone") | F.col("id").isNotNull()).join(fresh(ids), "id", "left")
    return met.select("set", F.coalesce("anc", "least").alias("ancestor"))


def _deepest_by_rows(sets: DataFrame, closed: DataFrame, depth: DataFrame) -> DataFrame:
    members = sets.select("set", "node").distinct()
    size = members.groupBy("set").agg(F.count(F.lit(1)).alias("size"))
    up = closed.select(F.col("cls").alias("node"), "anc")
    reach = members.join(up, "node").unionByName(members.withColumn("anc", F.col("node")))
    counted = reach.groupBy("set", "anc").agg(F.count(F.lit(1)).alias("n"))
    shared = counted.join(size, "set").filter(F.col("n") == F.col("size")).join(depth, "anc", "left")
    return shared.groupBy("set").agg(
        F.max_by("anc", F.struct(F.coalesce("level", F.lit(0)), "anc")).alias("ancestor")
    )


# --- calls -----------------------------------------------------------------------------------


def forwarders(methods: DataFrame, insns: DataFrame) -> DataFrame:
    """(method_key, target): methods that only pass their arguments on to another static method.

    ``methods(method_key, params, ret, flags, registers, has_handlers)``; ``insns(method_key, off, op,
    regs, ref_key, ref_params, ref_ret)``.  Counting and first/last rows per method are aggregates.
    """
    body = insns.filter(F.col("op") != "nop")
    moves = F.col("op").startswith("move-result")
    shape = body.groupBy("method_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("op", "regs", "ref_key", "ref_params", "ref_ret"), "off").alias("call"),
        F.max_by(F.struct("op", "regs"), "off").alias("back"),
        F.sum(moves.cast("int")).alias("moved"),
        F.max(F.when(moves, F.col("regs")[0])).alias("result"),
    )
    joined = methods.join(shape, "method_key")
    slots = F.aggregate(
        "params", F.lit(0), lambda acc, p: acc + F.when(p.isin("J", "D"), 2).otherwise(1)
    )
    first = F.col("registers") - slots
    identity = F.when(slots == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(first, F.col("registers") - 1)
    )
    calls_static = F.col("call.op").startswith("invoke-static")
    hands_back = F.when(
        F.col("ret") == "V",
        (F.col("n") == 2) & (F.col("back.op") == "return-void"),
    ).otherwise(
        (F.col("n") == 3) & (F.col("moved") == 1) & F.col("back.op").startswith("return")
        & (F.col("back.op") != "return-void") & (F.col("back.regs")[0] == F.col("result"))
    )
    return joined.filter(
        has_flag(F.col("flags"), STATIC)
        & has_flag(F.col("flags"), SYNTHETIC | BRIDGE)
        & ~F.col("has_handlers")
        & calls_static & hands_back
        & (F.col("call.ref_params") == F.col("params"))
        & (F.col("call.ref_ret") == F.col("ret"))
        & (F.col("call.regs") == identity)
    ).select("method_key", F.col("call.ref_key").alias("target"))


def terminal_targets(forwards: DataFrame) -> DataFrame:
    """(method_key, terminal): where a chain of forwarders ends, null on a cycle.

    Pointers double each round.  No chain is longer than there are forwarders, so after as many rounds as their number
    has binary digits a pointer that still stands at a forwarder goes round a cycle.  Only such pointers are moved; one that has
    arrived is written once.
    """
    state = forwards.select("method_key", F.col("target").alias("ptr"))
    keys = fresh(forwards).select(F.col("method_key").alias("ptr")).distinct().withColumn("__fwd", F.lit(True))
    marked = cut(state.join(keys, "ptr", "left").select("method_key", "ptr", F.coalesce("__fwd", F.lit(False)).alias("open")))
    arrived, moving = marked.filter("NOT open"), marked.filter("open")
    left = moving.count()
    for _ in range(marked.count().bit_length()):
        if not left:
            break
        ahead = arrived.unionByName(moving).toDF("ptr", "__next", "__open")
        moved = cut(sized(moving, left).select("method_key", "ptr").join(ahead, "ptr").select("method_key", F.col("__next").alias("ptr"), F.col("__open").alias("open")))
        arrived, moving = arrived.unionByName(moved.filter("NOT open")), moved.filter("open")
        left = moving.count()
    return arrived.unionByName(moving).select("method_key", F.when(~F.col("open"), F.col("ptr")).alias("terminal"))


def redirect_calls(calls: DataFrame, terminals: DataFrame) -> DataFrame:
    """calls(…, callee) with every call of a forwarder pointed at the terminal method."""
    ends = terminals.select(F.col("method_key").alias("callee"), "terminal")
    return calls.join(ends, "callee", "left").withColumn("callee", F.coalesce("terminal", "callee")).drop("terminal")


def checked_only(direct: DataFrame, closed: DataFrame) -> DataFrame:
    """Drop exceptions that need no throws clause."""
    below = closed.filter(F.col("anc").isin(*UNCHECKED_ROOTS)).select(F.col("cls").alias("exc")).distinct()
    return direct.filter(~F.col("exc").isin(*UNCHECKED)).join(below, "exc", "left_anti").select(*direct.columns)


def propagate_throws(direct: DataFrame, calls: DataFrame, caught: DataFrame, closed: DataFrame) -> DataFrame:
    """Least (method, exc) set: thrown here or by a callee, and not caught here.

    ``direct(method, exc)``, ``calls(caller, callee)``, ``caught(method, exc)``, ``closed(cls, anc)``.
    A handler catches the type, its subtypes, and everything if it is one of the two root types.

    A method with one callee that has no other caller only hands on what comes from there.  Such paths are found by doubling and passed
    in one step: an exception leaves a path if no handler on it stands in the way.  Rounds are those of the paths among each
    other; which methods of a path are passed is worked out at the end from positions.
    """
    every = cut(caught.filter(F.col("exc").isin(*CATCH_EVERYTHING)).select("method").distinct())
    silent = fresh(every).withColumnRenamed("method", "caller")
    below = closed.select(F.col("cls").alias("sub"), F.col("anc").alias("exc"))
    stopped = cut_spread(
        caught.select("method", "exc")
        .unionByName(caught.join(below, "exc").select("method", F.col("sub").alias("exc")))
        .distinct()
    )
    # nothing leaves a method that catches everything, so calls from it do not matter
    into = cut_spread(
        calls.select("caller", F.col("callee").alias("method")).distinct()
        .filter(F.col("caller") != F.col("method")).join(silent, "caller", "left_anti")
    )
    leaves = cut(
        direct.select("method", "exc").distinct().join(fresh(stopped), ["method", "exc"], "left_anti")
        .join(fresh(every), "method", "left_anti")
    )
    one_callee = fresh(into).groupBy("caller").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("caller")
    one_caller = fresh(into).groupBy("method").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("method")
    links = fresh(into).join(one_callee, "caller", "left_semi").join(one_caller, "method", "left_semi")
    path = cut(_chain_ends(links.select(F.col("caller").alias("node"), F.col("method").alias("to"))).withColumnsRenamed({"node": "method", "end": "head", "steps": "at"}))
    if path.isEmpty():
        hops, blocked = into, None
        seeds = leaves
    else:
        onto = fresh(path).select("method", "head")
        # from the head of a path to the heads that its last method is called from
        inner = fresh(path).select(F.col("method").alias("caller"))
        hops = cut_spread(
            into.join(inner, "caller", "left_anti").join(onto, "method", "left")
            .select("caller", F.coalesce("head", "method").alias("method")).distinct()
        )
        stops = cut(fresh(path).join(fresh(stopped), "method").select("head", "exc", "at"))
        starts = cut(fresh(path).join(fresh(leaves), "method").select("head", "exc", "at"))
        blocked = cut(fresh(stops).groupBy("head", "exc").agg(F.max("at").alias("last")))
        out = (
            starts.groupBy("head", "exc").agg(F.max("at").alias("at")).join(fresh(blocked), ["head", "exc"], "left")
            .filter(F.col("last").isNull() | (F.col("last") < F.col("at"))).select(F.col("head").alias("method"), "exc")
        )
        arriving = out.join(fresh(hops), "method").select(F.col("caller").alias("method"), "exc").join(
            fresh(stopped), ["method", "exc"], "left_anti"
        )
        seeds = leaves.join(fresh(path).select("method"), "method", "left_anti").unionByName(arriving)

    def step(delta: DataFrame) -> DataFrame:
        if blocked is not None:
            delta = delta.join(fresh(blocked).select(F.col("head").alias("method"), "exc"), ["method", "exc"], "left_anti")
        return delta.join(fresh(hops), "method").select(F.col("caller").alias("method"), "exc")

    found = grow(seeds.select("method", "exc"), step, barred=stopped)
    if blocked is None:
        return found
    # on a path: from where an exception comes in up to the next event, or to the last method
    length = fresh(path).groupBy("head").agg(F.max("at").alias("length"))
    comes = (
        fresh(found).withColumnRenamed("method", "head").join(length, "head").select("head", "exc", F.lit(0).cast("long").alias("at"))
        .unionByName(starts).withColumn("comes", F.lit(True))
    )
    events = comes.unionByName(stops.withColumn("comes", F.lit(False)))
    runs = scan(events, ["head", "exc"], ["at"], {"until": lead(F.col("at"))}).filter("comes").join(fresh(length), "head")
    passed = runs.select(
        "head", "exc", F.explode(F.sequence(F.col("at"), F.coalesce(F.col("until") - 1, F.col("length")))).alias("at")
    ).join(fresh(path), ["head", "at"])
    return found.select("method", "exc").unionByName(passed.select("method", "exc"))


def throws_clause(pairs: DataFrame) -> DataFrame:
    """(method, throws): sorted exception list per method.

    Pairs are made distinct first, so a list holds each exception type once.
    """
    return pairs.distinct().groupBy("method").agg(F.array_sort(F.collect_set("exc")).alias("throws"))


# --- control flow ----------------------------------------------------------------------------


def clean_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("exceptional"))


def _type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _flow_rows(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """(method_key, src, dst, mark): edges with mark 0, and marked blocks as src with their own mark.

    No column is ever null, which keeps whole numbers exact on their way to Python.
    """
    steps = edges.select("method_key", "src", "dst").distinct().withColumn("mark", F.lit(0))
    return steps.unionByName(marked.withColumn("dst", F.col("src")))


def _walk(after: dict, starts: list) -> list:
    """Blocks that can be reached, in the order met."""
    seen = dict.fromkeys(starts)
    todo = list(seen)
    while todo:
        for nxt in after.get(todo.pop(), ()):
            if nxt not in seen:
                seen[nxt] = None
                todo.append(nxt)
    return list(seen)


def _solve_reach(key, rows):
    after: dict = {}
    for _, src, dst, mark in rows:
        if not mark:
            after.setdefault(src, []).append(dst)
    for block in _walk(after, [src for _, src, _, mark in rows if mark]):
        yield key, block


def _solve_dominators(key, rows):
    """Sets as bit masks: a block is dominated by itself and by what dominates all its predecessors."""
    after: dict = {}
    before: dict = {}
    for _, src, dst, mark in rows:
        if not mark:
            after.setdefault(src, []).append(dst)
            before.setdefault(dst, []).append(src)
    roots = dict.fromkeys(src for _, src, _, mark in rows if mark)
    blocks = _walk(after, list(roots))
    bit = {b: 1 << i for i, b in enumerate(blocks)}
    everything = (1 << len(blocks)) - 1
    dom = {b: bit[b] if b in roots else everything for b in blocks}
    todo = dict.fromkeys(blocks)
    while todo:
        block = next(iter(todo))
        del todo[block]
        mask = bit[block]
        if block not in roots:
            shared = everything
            for p in before[block]:
                if p in bit:
                    shared &= dom[p]
            mask |= shared
        if mask != dom[block]:
            dom[block] = mask
            todo.update((n, None) for n in after.get(block, ()))
    for block in blocks:
        mask = dom[block]
        while mask:
            low = mask & -mask
            yield key, block, blocks[low.bit_length() - 1]
            mask ^= low


def _large_only(df: DataFrame, large: DataFrame) -> DataFrame:
    return df.join(large, "method_key", "left_semi").select(*df.columns)


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(method_key, block) reached from the entries."""
    marked = entries.select("method_key", F.col("block").alias("src")).distinct().withColumn("mark", F.lit(1))
    small, large = split_by_size(_flow_rows(edges, marked), "method_key")
    schema = f"method_key {_type_of(edges, 'method_key')}, block {_type_of(edges, 'src')}"
    out = solve_groups(small, "method_key", _solve_reach, schema)
    if large is None:
        return out
    return out.unionByName(_reachable_by_rounds(_large_only(edges, large), _large_only(entries, large)))


def _reachable_by_rounds(edges: DataFrame, entries: DataFrame) -> DataFrame:
    hops = cut(edges.select("method_key", F.col("src").alias("block"), "dst").distinct())

    def step(delta: DataFrame) -> DataFrame:
        return delta.join(fresh(hops), ["method_key", "block"]).select("method_key", F.col("dst").alias("block"))

    return grow(entries.select("method_key", "block"), step)


def dominators(edges: DataFrame, entries: DataFrame, reverse: bool = False) -> DataFrame:
    """(method_key, block, dom): every block on all ways from the entry to the block, itself included.

    ``reverse`` gives post-dominators with ``entries`` as exit blocks; a block that reaches no exit has
    none.
    """
    if reverse:
        edges = edges.select("method_key", F.col("dst").alias("src"), F.col("src").alias("dst"))
    marked = entries.select("method_key", F.col("block").alias("src")).distinct().withColumn("mark", F.lit(1))
    small, large = split_by_size(_flow_rows(edges, marked), "method_key")
    block = _type_of(edges, "src")
    schema = f"method_key {_type_of(edges, 'method_key')}, block {block}, dom {block}"
    out = solve_groups(small, "method_key", _solve_dominators, schema)
    if large is None:
        return out
    return out.unionByName(_dominators_by_rounds(_large_only(edges, large), _large_only(entries, large)))


def _dominators_by_rounds(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Starts from the path to each block in a breadth-first tree, which holds all its dominators, and
    removes what some predecessor lacks.  Rows stay near blocks times depth; no block is ever paired
    with all others.
    """
    hops = cut(
        edges.select("method_key", F.col("src").alias("p"), F.col("dst").alias("b")).distinct()
    )
    roots = cut(entries.select("method_key", "block").distinct())
    front = cut(roots.withColumn("dom", F.col("block")))
    layers = [front]
    seen = reached = roots
    new = roots.count()
    while True:
        at = sized(reached.withColumnRenamed("block", "p"), new)
        step = (
            fresh(hops).join(at, ["method_key", "p"])
            .groupBy("method_key", F.col("b").alias("block"))
            .agg(F.min("p").alias("p"))
            .join(fresh(seen), ["method_key", "block"], "left_anti")
        )
        tree = cut(step)
        new = tree.count()
        if not new:
            break
        above = fresh(front).select("method_key", F.col("block").alias("p"), "dom")
        front = cut(
            sized(tree, new).join(above, ["method_key", "p"]).select("method_key", "block", "dom")
            .unionByName(tree.select("method_key", "block", F.col("block").alias("dom")))
        )
        layers.append(front)
        reached = tree.select("method_key", "block")
        seen = fresh(seen).unionByName(reached)
        if len(layers) % 12 == 0:
            seen = cut(seen)
    candidates = layers[0]
    for layer in layers[1:]:
        candidates = candidates.unionByName(layer)
    candidates = cut(candidates)

    names = ["method_key", "block", "dom"]
    inner = cut(
        hops.join(fresh(seen).select("method_key", F.col("block").alias("p")), ["method_key", "p"], "left_semi")
        .join(fresh(roots).select("method_key", F.col("block").alias("b")), ["method_key", "b"], "left_anti")
    )
    open_rows = fresh(candidates).filter(F.col("block") != F.col("dom"))
    lacking = (
        open_rows.join(fresh(inner).withColumnRenamed("b", "block"), ["method_key", "block"])
        .join(
            fresh(candidates).select("method_key", F.col("block").alias("p"), "dom"),
            ["method_key", "p", "dom"], "left_anti",
        )
        .select(*names).distinct()
    )

    def spread(removed: DataFrame) -> DataFrame:
        onward = removed.select("method_key", F.col("block").alias("p"), "dom").join(
            fresh(inner), ["method_key", "p"]
        )
        return onward.select("method_key", F.col("b").alias("block"), "dom").filter(F.col("block") != F.col("dom"))

    gone = grow(lacking, spread, allowed=candidates)
    return candidates.join(fresh(gone), names, "left_anti").select(*names)


def immediate_dominators(dom: DataFrame) -> DataFrame:
    """(method_key, block, idom): of the strict dominators the one that has most dominators itself."""
    dom = cut(dom)
    depth = fresh(dom).groupBy("method_key", "block").agg(F.count(F.lit(1)).alias("depth"))
    above = depth.select("method_key", F.col("block").alias("dom"), "depth")
    strict = dom.filter(F.col("dom") != F.col("block")).join(above, ["method_key", "dom"])
    return strict.groupBy("method_key", "block").agg(F.max_by("dom", "depth").alias("idom"))


def dominance_frontier(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """(method_key, block, frontier): where the region dominated by the block ends."""
    dom = cut(dom)
    into = edges.select("method_key", F.col("src").alias("p"), F.col("dst").alias("frontier")).distinct()
    above = dom.select("method_key", F.col("block").alias("p"), F.col("dom").alias("block"))
    found = into.join(above, ["method_key", "p"]).select("method_key", "block", "frontier").distinct()
    strict = fresh(dom).filter(F.col("dom") != F.col("block")).select(
        "method_key", F.col("dom").alias("block"), F.col("block").alias("frontier")
    )
    return found.join(strict, ["method_key", "block", "frontier"], "left_anti")


def back_edges(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """Edges whose target dominates their source."""
    return edges.select("method_key", "src", "dst").distinct().join(
        dom.select("method_key", F.col("block").alias("src"), F.col("dom").alias("dst")),
        ["method_key", "src", "dst"], "left_semi",
    )


def _solve_loops(key, rows):
    before: dict = {}
    back = []
    for _, src, dst, is_back in rows:
        if is_back:
            back.append((src, dst))
        else:
            before.setdefault(dst, []).append(src)
    bodies: dict = {}
    for tail, header in back:
        bodies.setdefault(header, []).append(tail)
    for header, tails in bodies.items():
        body = {header}
        todo = list(tails)
        while todo:
            block = todo.pop()
            if block not in body:
                body.add(block)
                todo += before.get(block, ())
        for block in body:
            yield key, header, block


def natural_loops(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """(method_key, header, block): the header and all blocks that reach a back edge without it."""
    edges = edges.select("method_key", "src", "dst").distinct()
    back = cut(back_edges(edges, dom))
    looping = back.select("method_key").distinct()
    # methods without a back edge have no loop and are left out
    inside = edges.join(looping, "method_key", "left_semi").withColumn("back", F.lit(False))
    rows = inside.unionByName(fresh(back).withColumn("back", F.lit(True)))
    small, large = split_by_size(rows, "method_key")
    block = _type_of(edges, "src")
    schema = f"method_key {_type_of(edges, 'method_key')}, header {block}, block {block}"
    out = solve_groups(small, "method_key", _solve_loops, schema)
    if large is None:
        return out
    return out.unionByName(_loops_by_rounds(_large_only(edges, large), _large_only(fresh(back), large)))


def _loops_by_rounds(edges: DataFrame, back: DataFrame) -> DataFrame:
    heads = back.select("method_key", F.col("dst").alias("header"), F.col("dst").alias("block")).distinct()
    tails = back.filter(F.col("src") != F.col("dst")).select(
        "method_key", F.col("dst").alias("header"), F.col("src").alias("block")
    )
    before = cut(edges.select("method_key", F.col("dst").alias("block"), "src").distinct())

    def step(delta: DataFrame) -> DataFrame:
        return delta.join(fresh(before), ["method_key", "block"]).filter(
            F.col("src") != F.col("header")
        ).select("method_key", "header", F.col("src").alias("block"))

    return grow(tails, step).unionByName(heads)


def _solve_acyclic(key, rows):
    """Strips blocks without a predecessor; edges that stay lie on or behind a cycle."""
    after: dict = {}
    entered: dict = {}
    for _, src, dst in rows:
        after.setdefault(src, []).append(dst)
        entered[dst] = entered.get(dst, 0) + 1
    todo = [b for b in after if b not in entered]
    left = len(rows)
    while todo:
        for dst in after.get(todo.pop(), ()):
            left -= 1
            entered[dst] -= 1
            if not entered[dst]:
                todo.append(dst)
    if left:
        yield (key,)


def reducible(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """(method_key, reducible): nothing circular is left once the back edges are gone."""
    edges = edges.select("method_key", "src", "dst").distinct()
    forward = edges.join(fresh(back_edges(edges, dom)), ["method_key", "src", "dst"], "left_anti")
    small, large = split_by_size(forward, "method_key")
    circular = solve_groups(small, "method_key", _solve_acyclic, f"method_key {_type_of(edges, 'method_key')}")
    if large is not None:
        circular = circular.unionByName(_circular_by_rounds(_large_only(forward, large)))
    methods = edges.select("method_key").distinct()
    return methods.join(circular.withColumn("__bad", F.lit(True)), "method_key", "left").select(
        "method_key", F.col("__bad").isNull().alias("reducible")
    )


def _circular_by_rounds(forward: DataFrame) -> DataFrame:
    live = cut(forward)
    size = live.count()
    while size:
        entered = fresh(live).select("method_key", F.col("dst").alias("src")).distinct()
        trimmed = cut(live.join(entered, ["method_key", "src"], "left_semi").select("method_key", "src", "dst"))
        now = trimmed.count()
        if now == size:
            break
        live, size = trimmed, now
    return live.select("method_key").distinct()


def _solve_liveness(key, rows):
    before: dict = {}
    gen: dict = {}
    kill: dict = {}
    for _, src, dst, mark, reg in rows:
        if mark == 0:
            before.setdefault(dst, []).append(src)
        else:
            table = gen if mark == 1 else kill
            table.setdefault(src, set()).add(reg)
    live = {b: set(regs) for b, regs in gen.items()}
    todo = list(live)
    while todo:
        block = todo.pop()
        for p in before.get(block, ()):
            have = live.setdefault(p, set())
            more = live[block] - kill.get(p, set()) - have
            if more:
                have |= more
                todo.append(p)
    for block, regs in live.items():
        for reg in regs:
            yield key, block, reg


def liveness(edges: DataFrame, uses: DataFrame, defs: DataFrame) -> DataFrame:
    """(method_key, block, reg) live at the start of a block.

    ``uses`` and ``defs`` are (method_key, block, idx, reg); a use in the row that also defines the
    register counts as before the definition.  Parameters are definitions at idx -1 of the entry.
    """
    first_use = uses.groupBy("method_key", "block", "reg").agg(F.min("idx").alias("u"))
    first_def = defs.groupBy("method_key", "block", "reg").agg(F.min("idx").alias("d"))
    keys = ["method_key", "block", "reg"]
    gen = first_use.join(first_def, keys, "left").filter(
        F.col("d").isNull() | (F.col("u") <= F.col("d"))
    ).select(*keys)
    kill = fresh(first_def.select(*keys))

    def marked(df: DataFrame, mark: int) -> DataFrame:
        return df.select(
            "method_key", F.col("block").alias("src"), F.col("block").alias("dst"), F.lit(mark).alias("mark"),
            F.col("reg").cast("string").alias("reg"),
        )

    steps = edges.select("method_key", "src", "dst").distinct().withColumns({"mark": F.lit(0), "reg": F.lit("")})
    rows = steps.unionByName(marked(gen, 1)).unionByName(marked(kill, 2))
    small, large = split_by_size(rows, "method_key")
    schema = f"method_key {_type_of(edges, 'method_key')}, block {_type_of(edges, 'src')}, reg string"
    out = solve_groups(small, "method_key", _solve_liveness, schema).withColumn(
        "reg", F.col("reg").cast(uses.schema["reg"].dataType)
    )
    if large is None:
        return out
    return out.unionByName(
        _liveness_by_rounds(_large_only(edges, large), _large_only(gen, large), _large_only(kill, large))
    )


def _liveness_by_rounds(edges: DataFrame, gen: DataFrame, kill: DataFrame) -> DataFrame:
    into = cut(edges.select("method_key", F.col("dst").alias("block"), "src").distinct())

    def step(delta: DataFrame) -> DataFrame:
        return delta.join(fresh(into), ["method_key", "block"]).select(
            "method_key", F.col("src").alias("block"), "reg"
        )

    return grow(gen, step, barred=cut(kill))


def renderable(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(method_key, ok): a straight line, that is no handler, no fork and no edge backwards.

    ``blocks(method_key, block, ord, is_handler)``; a method without blocks is fine.
    """
    keyed = blocks.select("method_key", F.col("block").alias("src"), F.col("ord").alias("__so"))
    after = blocks.select("method_key", F.col("block").alias("dst"), F.col("ord").alias("__do"))
    steps = edges.select("method_key", "src", "dst").distinct().join(keyed, ["method_key", "src"]).join(
        after, ["method_key", "dst"]
    )
    per_block = steps.groupBy("method_key", "src").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("__do") <= F.col("__so")).alias("back")
    )
    shape = per_block.groupBy("method_key").agg(
        F.max("n").alias("widest"), F.bool_or("back").alias("back")
    )
    handled = blocks.groupBy("method_key").agg(F.bool_or("is_handler").alias("handled"))
    return handled.join(shape, "method_key", "left").select(
        "method_key",
        (~F.col("handled") & (F.coalesce("widest", F.lit(0)) <= 1) & ~F.coalesce("back", F.lit(False))).alias("ok"),
    )


# --- sets ------------------------------------------------------------------------------------


def _compressed(links: DataFrame) -> DataFrame:
    """links(node, to) with ``to`` followed to its end, by doubling; a chain comes to an end because ``to`` is smaller."""
    state = cut(links)
    while True:
        ahead = fresh(state).select(F.col("node").alias("to"), F.col("to").alias("__far"))
        moved = cut(state.join(ahead, "to", "left").select("node", F.coalesce("__far", "to").alias("to"), F.col("__far").isNotNull().alias("moved")))
        state = moved.select("node", "to")
        if moved.filter("moved").isEmpty():
            return state


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of undirected pairs(a, b); a component is named after its smallest node.

    In a round every node hangs on its smallest neighbour if that is smaller, chains are followed to their ends, and each star becomes one
    node: pairs inside a star are gone for good, the others go on between stars.  It ends when no pair is left, which is when no
    label can change any more.  Neighbours are only ever aggregated to a minimum, never listed.  Labels are put together from the last,
    smallest round back to the first.
    """
    once = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(once)
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    edges = edges.filter(F.col("u") != F.col("v"))
    hung = []
    while not edges.isEmpty():
        # the smallest neighbour of the larger end; a smaller end with a still smaller neighbour is a larger end itself
        stars = _compressed(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("to")))
        hung.append(stars)
        moved = edges
        for side in ("u", "v"):
            centre = fresh(stars).select(F.col("node").alias(side), F.col("to").alias("__to"))
            moved = moved.join(centre, side, "left").withColumn(side, F.coalesce("__to", side)).drop("__to")
        edges = cut(
            moved.filter(F.col("u") != F.col("v"))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
    labels = None
    for stars in reversed(hung):
        if labels is None:
            labels = stars
            continue
        later = fresh(labels).select(F.col("node").alias("to"), F.col("to").alias("__end"))
        own = stars.join(later, "to", "left").select("node", F.coalesce("__end", "to").alias("to"))
        # a centre of this round that hung on another one later on
        labels = cut(own.unionByName(fresh(labels)))
    if labels is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("to", "node").alias("component"))


def _chain_ends(links: DataFrame) -> DataFrame:
    """(node, end, steps): where links(node, to) lead, one ``to`` a node, by doubling; nodes that lead into a ring have no row."""
    state = cut(links.select("node", F.col("to").alias("end"), F.lit(1).cast("long").alias("steps")))
    nodes, jumps, moved = state.count(), 1, 1
    while moved:
        ahead = fresh(state).select(F.col("node").alias("end"), F.col("end").alias("__end"), F.col("steps").alias("__steps"))
        state = cut(
            state.select("node", "end", "steps").join(ahead, "end", "left").select(
                "node", F.coalesce("__end", "end").alias("end"),
                (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), F.col("__end").isNotNull().alias("moved"),
            )
        )
        moved = state.filter("moved").count()
        # pointers had reached further than there are nodes: what still moves goes round
        if jumps >= nodes:
            break
        jumps *= 2
    return state.filter("NOT moved").select("node", "end", "steps")


def sweep_unused(nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """Nodes that stay when removable nodes without a remaining consumer are dropped, repeatedly.

    ``nodes(node, removable)``, ``uses(consumer, used)``.  A cycle that only uses itself stays.

    A removable node with one consumer goes when that goes: such chains are followed by doubling to where they begin and merged with it, so
    a chain of any length falls in one wave.  A wave takes out the uses by what has just been dropped; what is used no more
    is the next wave.  Uses of dropped and of merged nodes are never looked at again.
    """
    removable = cut(nodes.filter("removable").select("node").distinct())
    edges = cut(
        uses.select("consumer", "used").distinct()
        .join(fresh(removable).withColumnRenamed("node", "used"), "used", "left_semi").select("consumer", "used")
    )
    gone = cut(removable.join(fresh(edges).select(F.col("used").alias("node")).distinct(), "node", "left_anti"))
    merged, waves = [], []
    while not gone.isEmpty():
        waves.append(gone)
        alone = edges.groupBy(F.col("used").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("consumer").alias("to"))
        links = alone.filter("n = 1 AND node <> to").select("node", "to").join(
            fresh(removable).withColumnRenamed("node", "to"), "to", "left_semi"
        )
        ends = cut(_chain_ends(links).select("node", "end"))
        merged.append(ends)
        begin = fresh(ends).select(F.col("node").alias("consumer"), F.col("end").alias("__to"))
        kept = cut(
            edges.join(fresh(ends).select(F.col("node").alias("used")), "used", "left_anti")
            .join(begin, "consumer", "left").select(F.coalesce("__to", "consumer").alias("consumer"), "used").distinct()
        )
        edges = cut(kept.join(fresh(gone).withColumnRenamed("node", "consumer"), "consumer", "left_anti").select("consumer", "used"))
        gone = cut(
            fresh(kept).select(F.col("used").alias("node")).distinct()
            .join(fresh(edges).select(F.col("used").alias("node")).distinct(), "node", "left_anti")
        )
    if not waves:
        return nodes
    dropped = waves[0]
    for wave in waves[1:]:
        dropped = dropped.unionByName(wave)
    for ends in reversed(merged):
        dropped = cut(dropped.unionByName(ends.join(fresh(dropped).withColumnRenamed("node", "end"), "end", "left_semi").select("node")))
    return nodes.join(fresh(dropped), "node", "left_anti")
