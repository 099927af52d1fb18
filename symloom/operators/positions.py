"""Lookups by position: as-of, nesting, ranges, and questions about rows in instruction order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.text import running_sums
from symloom.plans import intervals
from symloom.plans.ordered import (
    lag,
    last_value,
    lead,
    needs_split,
    next_value,
    running_min,
    running_sum,
    scan,
)
from symloom.plans.apps import has_app, packed, unpacked
from symloom.plans.fixpoint import fresh, sized
from symloom.session import cut

# The delta-coded line table.
FIRST_SPECIAL, LINE_BASE, LINE_RANGE = 10, -4, 15


def line_starts(units: DataFrame) -> DataFrame:
    """(unit, line, start_off): where every line begins.  Only line lengths are shuffled.

    A group holds the lines of one text cell, which one task held before, so it is never split.  With an ``app_id``
    units are those of one app.
    """
    if has_app(units):
        return unpacked(line_starts(packed(units, "unit")), "unit")
    lines = units.select("unit", F.posexplode(F.split("code", "\n")).alias("i", "text")).select(
        "unit", (F.col("i") + 1).alias("line"), (F.length("text") + 1).alias("size")
    )
    summed = scan(lines, ["unit"], ["line"], {"upto": running_sum(F.col("size"))}, False)
    return summed.select("unit", "line", (F.col("upto") - F.col("size")).cast("int").alias("start_off"))


def repeated(units: DataFrame) -> DataFrame:
    """The keys of units whose code comes in several rows; only keys are shuffled."""
    return cut(units.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("unit"))


def line_texts(units: DataFrame) -> DataFrame:
    """(unit, line, start_off, text) of units that are one row each, worked out in the task that holds the code."""
    cells = units.select("unit", F.split("code", "\n").alias("text"))
    placed = cells.withColumn("end", running_sums(F.transform("text", lambda x: F.length(x) + 1)))
    rows = placed.select("unit", F.posexplode(F.arrays_zip("text", "end")).alias("i", "z"))
    return rows.select(
        "unit", (F.col("i") + 1).alias("line"), (F.col("z.end") - F.length("z.text") - 1).alias("start_off"), F.col("z.text").alias("text")
    )


def pieces(units: DataFrame, separator: str) -> DataFrame:
    """(unit, line, off, tok): what stands between separators (one sign each) on every line.

    Code of one row is taken apart and summed where it is.  The rows of a unit that comes in several are put in one order by line.
    """
    several = repeated(units)
    n = several.count()
    few = sized(several, n)
    lines = line_texts(units.join(few, "unit", "left_anti") if n else units)
    cells = lines.withColumn("tok", F.split("text", separator)).drop("text")
    placed = cells.withColumn("end", running_sums(F.transform("tok", lambda x: F.length(x) + 1)))
    rows = placed.select("unit", "line", "start_off", F.explode(F.arrays_zip("tok", "end")).alias("z"))
    off = lambda end: (F.col("start_off") + F.col(end) - F.length("tok") - 1).alias("off")
    alone = rows.select("unit", "line", "start_off", "z.tok", "z.end").select("unit", "line", off("end"), "tok")
    if not n:
        return alone
    again = units.join(fresh(few), "unit", "left_semi")
    texts = again.select("unit", F.posexplode(F.split("code", "\n")).alias("i", "text"))
    words = texts.select("unit", (F.col("i") + 1).alias("line"), F.posexplode(F.split("text", separator)).alias("j", "tok"))
    run = scan(words, ["unit", "line"], ["j"], {"upto": running_sum(F.length("tok") + 1)}).join(line_starts(again), ["unit", "line"])
    return alone.unionByName(run.select("unit", "line", off("upto"), "tok"))


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_at: str,
    right_at: str,
    take: Sequence[str],
    direction: str = "floor",
    strict: bool = False,
    tie: Sequence[str] = (),
    split: bool | None = None,
) -> DataFrame:
    """Nearest right row per left row: 'exact', 'floor' (at or below) or 'ceil' (at or above).

    ``strict`` leaves out equal positions; ``tie`` orders right rows that share a position (floor
    takes the last of them, ceil the first).  One union and one scan, whatever the group sizes.
    """
    if direction == "exact":
        hit = right.select(*by, F.col(right_at).alias(left_at), *take)
        return left.join(hit, [*by, left_at], "left")
    floor = direction == "floor"
    payload = F.struct(*take)
    # right rows sort before the left rows they may answer
    rank = {(True, False): 0, (True, True): 2, (False, False): 2, (False, True): 0}[(floor, strict)]
    lhs = left.select(
        *by, F.col(left_at).alias("__at"), F.lit(1).alias("__side"),
        F.struct(*left.columns).alias("__row"),
    )
    rhs = right.select(
        *by, F.col(right_at).alias("__at"), F.lit(rank).alias("__side"), payload.alias("__hit"),
        *[F.col(t).alias(f"__tie{i}") for i, t in enumerate(tie)],
    )
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    order = ["__at", "__side", *[f"__tie{i}" for i in range(len(tie))]]
    spec = last_value(F.col("__hit")) if floor else next_value(F.col("__hit"))
    found = scan(both, by, order, {"__found": spec}, split).filter(F.col("__side") == 1)
    return found.select(
        *[F.col("__row")[c].alias(c) for c in left.columns],
        *[F.col("__found")[t].alias(t) for t in take],
    )


def floor_each(
    left: DataFrame,
    by: Sequence[str],
    at: str,
    rights: Sequence[tuple[DataFrame, str, Sequence[str]]],
    split: bool | None = None,
) -> DataFrame:
    """``asof`` with several right tables (table, position, columns to take), all 'floor', in one union and one scan."""
    rest = [c for c in left.columns if c not in by and c != at]
    both = left.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*rest).alias("__row"))
    for i, (right, right_at, take) in enumerate(rights):
        hit = right.select(*by, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.struct(*take).alias(f"__hit{i}"))
        both = both.unionByName(hit, allowMissingColumns=True)
    specs = {f"__found{i}": last_value(F.col(f"__hit{i}")) for i in range(len(rights))}
    found = scan(both, by, ["__at", "__side"], specs, split).filter(F.col("__side") == 1)
    return found.select(
        *by, F.col("__at").cast(left.schema[at].dataType).alias(at), *[F.col("__row")[c].alias(c) for c in rest],
        *[F.col(f"__found{i}")[t].alias(t) for i, (_, _, take) in enumerate(rights) for t in take],
    )


def enclosing(annots: DataFrame, split: bool | None = None) -> DataFrame:
    """Adds ``encl``: the innermost class or method definition around each annotation.

    Opens and ends are summed into a depth (never below zero); the enclosing definition is the last
    one opened on the level that is current.
    """
    if split is None:
        split = needs_split(annots, ["unit"])
    opens = (F.col("kind") == "def") & F.col("sym.kind").isin("class", "method")
    step = F.when(opens, 1).when(F.col("kind") == "end", -1).otherwise(0)
    summed = scan(annots, ["unit"], ["off"], {"__s": running_sum(step)}, split)
    floor = scan(summed, ["unit"], ["off"], {"__m": running_min(F.col("__s"))}, split)
    levelled = floor.withColumn("__level", F.col("__s") - F.least(F.lit(0), F.col("__m")))
    out = scan(
        levelled, ["unit", "__level"], ["off"],
        {"encl": last_value(F.when(opens, F.col("sym")))}, split,
    )
    return out.withColumn("encl", F.when(F.col("__level") > 0, F.col("encl"))).drop(
        "__s", "__m", "__level"
    )


def number_blocks(insns: DataFrame, leaders: DataFrame) -> DataFrame:
    """Block number of each instruction(method_key, off); ``leaders(method_key, off)`` start blocks."""
    marks = leaders.select("method_key", "off").distinct().withColumn("__lead", F.lit(1))
    flagged = insns.join(marks, ["method_key", "off"], "left")
    return scan(flagged, ["method_key"], ["off"], {"block": running_sum(F.col("__lead"))}).drop("__lead")


def leaders(insns: DataFrame, try_ranges: DataFrame | None = None) -> DataFrame:
    """Offsets that start a block: entry, after a terminator, targets, try edges and handlers.

    ``insns(method_key, off, terminator, targets ARRAY)``;
    ``try_ranges(method_key, start_off, end_off, handlers ARRAY<STRUCT<type, off>>)``.  Rows and range ends are narrow rows of
    one scan: a row that comes first, or right after a terminator or a range's end, starts a block.
    """
    steps = insns.select(
        "method_key", "off", F.lit(0).alias("__side"), F.coalesce("terminator", F.lit(False)).alias("__ends")
    )
    if try_ranges is not None:
        # the end of a range sorts after the row at its offset, so the row that follows is the one behind the range
        steps = steps.unionByName(
            try_ranges.select("method_key", F.col("end_off").alias("off"), F.lit(1).alias("__side"), F.lit(True).alias("__ends"))
        )
    ranked = scan(steps, ["method_key"], ["off", "__side"], {"__prev": lag(F.col("__ends"))})
    own = ranked.filter((F.col("__side") == 0) & F.coalesce("__prev", F.lit(True))).select("method_key", "off")
    found = own.unionByName(insns.select("method_key", F.explode("targets").alias("off")))
    if try_ranges is not None:
        edges = try_ranges.select("method_key", F.col("start_off").alias("off"))
        handlers = try_ranges.select("method_key", F.explode("handlers.off").alias("off"))
        found = found.unionByName(edges).unionByName(handlers)
    return found.filter(F.col("off").isNotNull()).distinct()


def normal_edges(insns: DataFrame, jumps: DataFrame | None = None) -> DataFrame:
    """Edges between blocks: fall-through of a block's last row, and explicit targets.

    ``insns(method_key, off, block, falls_through, target_blocks ARRAY<INT>)``, or without the array
    and with ``jumps(method_key, src, dst)``.
    """
    ahead = scan(insns, ["method_key"], ["off"], {"__next": lead(F.col("block"))})
    last = ahead.filter(F.col("__next").isNull() | (F.col("__next") != F.col("block")))
    through = last.filter(F.col("falls_through") & F.col("__next").isNotNull()).select(
        "method_key", F.col("block").alias("src"), F.col("__next").alias("dst")
    )
    if jumps is None:
        jumps = last.select(
            "method_key", F.col("block").alias("src"), F.explode("target_blocks").alias("dst")
        )
    return through.unionByName(jumps).distinct()


def protected_by(blocks: DataFrame, try_ranges: DataFrame, normal: DataFrame) -> DataFrame:
    """Handler edges of blocks that start inside a protected range (end inclusive).

    An edge that exists as a normal edge already is not exceptional.
    """
    covered = intervals.points_in_ranges(
        blocks.select("method_key", F.col("block").alias("src"), "first_off"),
        try_ranges.select("method_key", "start_off", "end_off", "handlers"),
        ["method_key"], "first_off", "start_off", "end_off",
    )
    into = covered.select("method_key", "src", F.explode("handlers.off").alias("first_off")).distinct()
    edges = into.join(
        blocks.select("method_key", "first_off", F.col("block").alias("dst")), ["method_key", "first_off"]
    ).select("method_key", "src", "dst").distinct()
    known = normal.select("method_key", "src", "dst").distinct().withColumn("__normal", F.lit(True))
    return edges.join(known, ["method_key", "src", "dst"], "left").select(
        "method_key", "src", "dst", F.col("__normal").isNull().alias("exceptional")
    )


def locals_in_scope(local_vars: DataFrame, points: DataFrame) -> DataFrame:
    """Variables of the point's register whose live range holds the point."""
    return intervals.points_in_ranges(
        points, local_vars, ["method_key", "reg"], "off", "start_off", "end_off"
    )


def overlapping_pairs(ranges: DataFrame, by: Sequence[str], ident: str, start: str, end: str) -> DataFrame:
    return intervals.overlapping(ranges, by, ident, start, end)


def attach_payloads(insns: DataFrame, payloads: DataFrame) -> DataFrame:
    """Absolute case targets and the default (next instruction) of switch rows.

    ``insns(method_key, off, target)``, ``payloads(method_key, off, targets ARRAY<INT>)`` with targets
    relative to the switch.  A missing payload leaves an empty target list.
    """
    ahead = scan(insns, ["method_key"], ["off"], {"default": lead(F.col("off"))})
    data = payloads.select("method_key", F.col("off").alias("target"), F.col("targets").alias("__rel"))
    joined = ahead.filter(F.col("target").isNotNull()).join(data, ["method_key", "target"], "left")
    absolute = F.transform(F.array_compact("__rel"), lambda x: x + F.col("off"))
    return joined.withColumn(
        "targets", F.coalesce(absolute, F.array().cast("array<bigint>"))
    ).drop("__rel")


def live_ranges(events: DataFrame, code_size: DataFrame) -> DataFrame:
    """Local-variable ranges from debug events(method_key, reg, seq, addr, action, name, type).

    action: param (start is marked -1), start, restart (reopens under the last name) or end.
    An open range ends at code_size - 1.  Columns ``app_id`` and ``signature`` are carried where they exist.
    """
    held_on = [c for c in ("name", "type", "signature") if c in events.columns]
    named = F.col("action").isin("param", "start")
    held = scan(
        events, ["method_key", "reg"], ["seq"],
        {
            "__var": last_value(F.when(named, F.struct(*held_on))),
            "__close": lead(F.col("addr")),
        },
    )
    sized = held.filter((F.col("action") != "end") & F.col("__var").isNotNull()).join(
        code_size, "method_key", "left"
    )
    is_param = F.col("action") == "param"
    return sized.select(
        *[c for c in ("app_id",) if c in events.columns], "method_key", "reg",
        *[F.col(f"__var.{c}").alias(c) for c in held_on],
        F.when(is_param, F.lit(-1)).otherwise(F.col("addr")).alias("start_off"),
        F.coalesce("__close", F.col("code_size") - 1).alias("end_off"),
        is_param.alias("is_param"),
    )


def line_table(debug_bytes: DataFrame, code_size: DataFrame) -> DataFrame:
    """Decoded line map of debug rows(method_key, idx, code, advance_pc, advance_line).

    A special code moves address and line; the two advance columns hold the explicit moves of other
    rows.  Addresses stop at code_size - 1; the last row for an address wins.
    """
    special = F.col("code") >= FIRST_SPECIAL
    step = F.col("code") - FIRST_SPECIAL
    pc = F.when(special, F.floor(step / LINE_RANGE).cast("long")).otherwise(F.coalesce("advance_pc", F.lit(0)))
    line = F.when(special, LINE_BASE + step % LINE_RANGE).otherwise(F.coalesce("advance_line", F.lit(0)))
    run = scan(
        debug_bytes, ["method_key"], ["idx"],
        {"__pc": running_sum(pc), "__line": running_sum(line)},
    ).filter(special)
    sized = run.join(code_size, "method_key")
    return (
        sized.withColumn("off", F.least("__pc", F.col("code_size") - 1))
        .groupBy("method_key", "off")
        .agg(F.max_by("__line", "idx").alias("line"))
    )


def last_known(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], known: Column, defines: Column
) -> DataFrame:
    """Adds ``held``: what the latest earlier definition left in a register.

    ``known`` is the produced type (null clears it) and ``defines`` marks rows that write the register.
    """
    wrapped = F.when(defines, F.struct(known.alias("v")))
    out = scan(rows, by, order, {"__held": last_value(wrapped, strict=True)})
    return out.withColumn("held", F.col("__held.v")).drop("__held")


def last_known_type(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """Type a register holds at each read.

    ``writes(method_key, off, reg, type, catch_all, src_reg)``: type null clears, ``src_reg`` marks a
    move whose type is what its source holds.  One as-of lookup finds the write that each move copies; chains of moves then double
    their pointers, so rounds grow with the log of the longest chain.
    """
    split = needs_split(
        writes.select("method_key", "reg").unionByName(reads.select("method_key", "reg")), ["method_key", "reg"]
    )
    at = ["method_key", "reg"]
    marks = writes.select(
        *at, F.col("off").alias("w_off"), F.col("off").alias("from_off"), "type", "catch_all", F.col("src_reg").isNotNull().alias("moved")
    )
    moves = writes.filter(F.col("src_reg").isNotNull()).select("method_key", "off", F.col("reg").alias("to_reg"), F.col("src_reg").alias("reg"))
    copied = asof(moves, marks, at, "off", "w_off", ["from_off", "type", "catch_all", "moved"], strict=True, split=split)
    state = cut(
        copied.select(
            "method_key", F.col("to_reg").alias("reg"), "off", F.col("reg").alias("from_reg"), "from_off", "type", "catch_all",
            F.coalesce("moved", F.lit(False)).alias("moved"),
        )
    )
    # a move copies an earlier write, so a chain has an end
    while not state.filter("moved").isEmpty():
        names = ["from_reg", "from_off", "type", "catch_all", "moved"]
        ahead = state.toDF(*state.columns).select(
            "method_key", F.col("reg").alias("from_reg"), F.col("off").alias("from_off"), F.struct(*names).alias("__next")
        )
        held = state.filter("moved").select("method_key", "reg", "off", "from_reg", "from_off").join(ahead, ["method_key", "from_reg", "from_off"])
        state = cut(
            held.select("method_key", "reg", "off", *[F.col("__next")[n].alias(n) for n in names])
            .unionByName(state.filter("NOT moved").select("method_key", "reg", "off", *names))
        )
    solved = writes.filter(F.col("src_reg").isNull()).select("method_key", "off", "reg", "type", "catch_all").unionByName(
        state.select("method_key", "off", "reg", "type", "catch_all")
    )
    return asof(
        reads, solved.withColumnRenamed("off", "w_off"), at, "off", "w_off", ["type", "catch_all"], strict=True, split=split,
    )


def direct_throws(writes: DataFrame, throws: DataFrame) -> DataFrame:
    """(method_key, exc) thrown by throw rows(method_key, off, reg).

    Re-raising what a catch-all handler caught is not a throw of its own.
    """
    held = last_known_type(writes, throws)
    real = held.filter(F.col("type").isNotNull() & ~F.coalesce("catch_all", F.lit(False)))
    return real.select("method_key", F.col("type").alias("exc")).distinct()


def pair_results(insns: DataFrame, makes_result: Column, is_result: Column, skip: Column) -> DataFrame:
    """Producer rows with the offset of the move-result that belongs to them (null if none).

    Skipped rows (nop) do not break a pair, any other row does.
    """
    rows = insns.filter(~skip).withColumns({"__makes": makes_result, "__is": is_result})
    ahead = scan(rows, ["method_key"], ["off"], {"__n": lead(F.struct("off", "__is"))})
    return ahead.filter(F.col("__makes")).select(
        "method_key", "off", F.when(F.col("__n.__is"), F.col("__n.off")).alias("result_off")
    )
