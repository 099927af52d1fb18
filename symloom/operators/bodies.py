"""From instruction rows to the tables the graph and position operators read."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.names import binary_name
from symloom.functions.signatures import parse_signature
from symloom.operators import graph, positions, xref
from symloom.session import cut

# Instruction names by what they do.
LEAVES = ("return", "throw")
JUMPS = ("goto",)
BRANCHES = ("if-", "packed-switch", "sparse-switch")
WRITES_NOTHING = (
    "if- goto return throw invoke iput sput aput monitor nop packed-switch sparse-switch "
    "fill-array-data filled-new-array"
).split()
NAMES_TYPE = ("new-instance", "check-cast")
PLAIN_MOVES = ("move", "move-object", "move/from16", "move-object/from16", "move/16", "move-object/16")


def _starts(op: Column, words: tuple[str, ...] | list[str]) -> Column:
    return reduce(or_, [op.startswith(w) for w in words])


def control_rows(insns: DataFrame, switches: DataFrame | None = None) -> DataFrame:
    """Instruction rows with ``terminator``, ``falls_through`` and ``targets``.

    ``switches(method_key, off, target)`` holds the cases of switch rows.
    """
    op = F.col("op")
    leaves, jumps = _starts(op, LEAVES), _starts(op, JUMPS)
    none = F.array().cast("array<int>")
    rows = insns.withColumns(
        {
            "terminator": leaves | jumps | _starts(op, BRANCHES),
            "falls_through": ~leaves & ~jumps,
            "targets": F.when(
                (jumps | op.startswith("if-")) & F.col("target").isNotNull(), F.array("target")
            ).otherwise(none),
        }
    )
    if switches is None:
        return rows
    # the cases of one switch come from one method's text
    cases = switches.groupBy("method_key", "off").agg(F.array_sort(F.collect_set("target")).alias("__cases"))
    return rows.join(cases, ["method_key", "off"], "left").withColumn(
        "targets", F.coalesce("__cases", "targets")
    ).drop("__cases")


def control_flow(
    insns: DataFrame, try_ranges: DataFrame, switches: DataFrame | None = None
) -> dict[str, DataFrame]:
    """``row`` (instructions with their block), ``block`` (method_key, block, first_off) and ``edge``
    (method_key, src, dst, exceptional) of all methods."""
    # parsed rows are read several times below, so they are written once
    rows = cut(control_rows(insns, switches))
    try_ranges = cut(try_ranges)
    numbered = cut(positions.number_blocks(rows, positions.leaders(rows, try_ranges)))
    blocks = numbered.groupBy("method_key", "block").agg(F.min("off").alias("first_off"))
    starts = blocks.select("method_key", F.col("first_off").alias("at"), F.col("block").alias("dst"))
    jumps = (
        numbered.select("method_key", F.col("block").alias("src"), F.explode("targets").alias("at"))
        .join(starts, ["method_key", "at"])
        .select("method_key", "src", "dst")
    )
    normal = positions.normal_edges(numbered, jumps)
    handled = positions.protected_by(blocks, try_ranges, normal).filter("exceptional")
    edges = normal.withColumn("exceptional", F.lit(False)).unionByName(handled)
    return {"row": numbered, "block": blocks, "edge": edges}


def member_ref(ref: Column) -> Column:
    """``Lp/C;->run(IJ)V`` -> struct<cls, name, params, ret, key>; for a field ret is its type."""
    owner = binary_name(F.substring_index(ref, "->", 1))
    rest = F.regexp_extract(ref, "->(.*)$", 1)
    called = F.contains(rest, F.lit("("))
    sig = parse_signature(F.concat(F.lit("("), F.regexp_extract(rest, "\\((.*)$", 1)))
    return F.struct(
        owner.alias("cls"),
        F.when(called, F.substring_index(rest, "(", 1)).otherwise(F.substring_index(rest, ":", 1)).alias("name"),
        F.when(called, sig["params"]).alias("params"),
        F.when(called, sig["ret"]).otherwise(F.substring_index(rest, ":", -1)).alias("ret"),
        F.concat(owner, F.lit("->"), rest).alias("key"),
    )


def calls(insns: DataFrame) -> DataFrame:
    """(app_id, caller, off, cls, name, params, ret, key) of every invoke row; ``key`` as a method key."""
    made = insns.filter(F.col("op").startswith("invoke") & F.contains(F.col("ref"), F.lit("->")))
    return made.withColumn("r", member_ref(F.col("ref"))).select(
        "app_id", F.col("method_key").alias("caller"), "off", "r.cls", "r.name", "r.params", "r.ret",
        F.concat("app_id", F.lit("/"), "r.key").alias("key"),
    )


def forwarder_rows(insns: DataFrame) -> DataFrame:
    """Instruction rows in the shape graph.forwarders reads."""
    r = member_ref(F.col("ref"))
    return insns.select(
        "method_key", "off", "op", "regs", F.concat("app_id", F.lit("/"), r["key"]).alias("ref_key"), r["params"].alias("ref_params"), r["ret"].alias("ref_ret")
    )


def _class_type(desc: Column) -> Column:
    """Dotted name of an object descriptor, null for primitives and arrays."""
    return F.when(desc.startswith("L"), binary_name(desc))


def register_writes(insns: DataFrame, try_ranges: DataFrame) -> DataFrame:
    """(method_key, off, reg, type, catch_all, src_reg) of every row that writes a register.

    The type is that of a new instance, a cast, a field, a call result or a caught exception; a plain
    move names its source; anything else clears.
    """
    op = F.col("op")
    paired = positions.pair_results(
        insns.select("method_key", "off", "op"),
        op.startswith("invoke") | op.startswith("filled-new-array"), op.startswith("move-result"), op == "nop",
    )
    results = paired.filter("result_off IS NOT NULL").join(
        insns.select("method_key", "off", member_ref(F.col("ref"))["ret"].alias("__ret")), ["method_key", "off"]
    ).select("method_key", F.col("result_off").alias("off"), "__ret")
    handlers = try_ranges.select("method_key", F.explode("handlers").alias("h")).groupBy(
        "method_key", F.col("h.off").alias("off")
    ).agg(F.min("h.type").alias("__caught"), F.bool_or(F.col("h.type").isNull()).alias("__all"))
    rows = (
        insns.filter(~_starts(op, WRITES_NOTHING) & (F.size("regs") > 0))
        .join(results, ["method_key", "off"], "left")
        .join(handlers, ["method_key", "off"], "left")
    )
    entered = op == "move-exception"
    written = (
        F.when(op.isin(*NAMES_TYPE), _class_type(F.col("ref")))
        .when(op.startswith("iget") | op.startswith("sget"), _class_type(member_ref(F.col("ref"))["ret"]))
        .when(op.startswith("move-result"), _class_type(F.col("__ret")))
        .when(entered, F.col("__caught"))
    )
    return rows.select(
        "method_key", "off", F.col("regs")[0].alias("reg"), written.alias("type"),
        (entered & F.coalesce("__all", F.lit(False))).alias("catch_all"),
        F.when(op.isin(*PLAIN_MOVES), F.get("regs", F.lit(1))).alias("src_reg"),
    )


def throws_of(
    insns: DataFrame, try_ranges: DataFrame, methods: DataFrame, closed: DataFrame
) -> DataFrame:
    """(method, exc): checked exceptions every method lets out, over calls to all loaded methods."""
    insns, try_ranges = cut(insns), cut(try_ranges)
    raised = insns.filter(F.col("op").startswith("throw")).select("method_key", "off", F.col("regs")[0].alias("reg"))
    direct = positions.direct_throws(register_writes(insns, try_ranges), raised)
    checked = graph.checked_only(direct.withColumnRenamed("method_key", "method"), closed)
    caught = try_ranges.select(F.col("method_key").alias("method"), F.explode("handlers.type").alias("exc")).filter(
        "exc IS NOT NULL"
    )
    made = calls(insns).select("app_id", "caller", "cls", "name", "params", "ret").distinct()
    resolved = xref.resolve_calls(made, methods).filter("method_key IS NOT NULL").select(
        "caller", F.col("method_key").alias("callee")
    )
    return graph.propagate_throws(checked, resolved, caught.distinct(), closed)
