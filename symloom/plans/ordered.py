"""Ordered scans within groups: running values, last/next value, lag/lead, numbering.

A plain window sends each group to one task.  That is right while groups are small; a group that
holds a large share of all rows would make one task do most of the work.  ``scan`` therefore looks
at the largest group first.  Above the per-task limit it range-partitions rows by (group, order),
scans every slice on its own, and passes a small per-slice summary (one row per group and slice)
on to the later slices.  Both ways give the same result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from symloom.session import cut, rows_per_task

_SLICE = "__slice"
_RANK = "__rank"


@dataclass(frozen=True)
class Spec:
    kind: str
    value: Column | None = None
    strict: bool = False


def row_number() -> Spec:
    return Spec("row_number")


def running_sum(value: Column) -> Spec:
    return Spec("sum", F.coalesce(value, F.lit(0)))


def running_min(value: Column) -> Spec:
    return Spec("min", value)


def last_value(value: Column, strict: bool = False) -> Spec:
    """Latest non-null value at (or, when strict, before) the current row."""
    return Spec("last", value, strict)


def next_value(value: Column, strict: bool = False) -> Spec:
    """Nearest non-null value at (or, when strict, after) the current row."""
    return Spec("next", value, strict)


def lag(value: Column) -> Spec:
    return Spec("lag", F.struct(value.alias("v")), True)


def lead(value: Column) -> Spec:
    return Spec("lead", F.struct(value.alias("v")), True)


def largest_group(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, rows in all); counts are combined before the shuffle."""
    row = df.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    return int(row[0] or 0), int(row[1] or 0)


def needs_split(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether some group is too large for one task; finer groups of a frame that is not split need no
    check of their own."""
    return largest_group(df, by)[0] > rows_per_task(df.sparkSession)


def _windows(by: Sequence[str], order: Sequence[str]) -> tuple[WindowSpec, WindowSpec]:
    """The group in order and in reverse.

    What follows a row is looked up in reverse: a frame that reaches to the end of the group would be
    worked out anew for every row.
    """
    group = Window.partitionBy(*by)
    forward = group.orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return forward, group.orderBy(*[F.col(c).desc_nulls_last() for c in order])


def _local(spec: Spec, name: str, windows: tuple[WindowSpec, WindowSpec]) -> Column:
    forward, backward = windows
    value = F.col(name)
    first = Window.unboundedPreceding
    end = -1 if spec.strict else Window.currentRow
    if spec.kind == "row_number":
        return F.row_number().over(forward).cast("long")
    if spec.kind == "lag":
        return F.lag(value).over(forward)
    if spec.kind == "lead":
        return F.lead(value).over(forward)
    if spec.kind == "sum":
        return F.sum(value).over(forward.rowsBetween(first, Window.currentRow))
    if spec.kind == "min":
        return F.min(value).over(forward.rowsBetween(first, Window.currentRow))
    window = forward if spec.kind == "last" else backward
    return F.last(value, ignorenulls=True).over(window.rowsBetween(first, end))


def _summary(spec: Spec, name: str) -> Column:
    value = F.col(name)
    if spec.kind == "row_number":
        return F.count(F.lit(1))
    if spec.kind == "sum":
        return F.sum(value)
    if spec.kind == "min":
        return F.min(value)
    rank = F.when(value.isNotNull(), F.col(_RANK))
    return F.max_by(value, rank) if spec.kind in ("last", "lag") else F.min_by(value, rank)


def _carry(spec: Spec, name: str, windows: tuple[WindowSpec, WindowSpec]) -> Column:
    forward, backward = (w.rowsBetween(Window.unboundedPreceding, -1) for w in windows)
    value = F.col(name)
    if spec.kind in ("row_number", "sum"):
        return F.sum(value).over(forward)
    if spec.kind == "min":
        return F.min(value).over(forward)
    window = forward if spec.kind in ("last", "lag") else backward
    return F.last(value, ignorenulls=True).over(window)


def _combine(spec: Spec, here: Column, carried: Column) -> Column:
    if spec.kind in ("row_number", "sum"):
        return here + F.coalesce(carried, F.lit(0))
    if spec.kind == "min":
        return F.least(here, carried)
    return F.coalesce(here, carried)


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, Spec],
    split: bool | None = None,
) -> DataFrame:
    """Add one column per entry of ``outputs``; ``order`` must be total within a group.

    ``split`` forces or forbids slicing; None decides by the size of the largest group.
    """
    limit = rows_per_task(df.sparkSession)
    total = None
    if split is None:
        largest, total = largest_group(df, by)
        split = largest > limit
    inputs = {
        f"__in_{name}": spec.value for name, spec in outputs.items() if spec.value is not None
    }
    staged = df.withColumns(inputs) if inputs else df
    by, order = list(by), list(order)
    wrapped = {n for n, s in outputs.items() if s.kind in ("lag", "lead")}

    if not split:
        windows = _windows(by, order)
        out = staged.withColumns({n: _local(s, f"__in_{n}", windows) for n, s in outputs.items()})
    else:
        out = _sliced(staged, by, order, outputs, total, limit)
    out = out.withColumns({n: F.col(n)["v"] for n in wrapped}) if wrapped else out
    return out.drop(*inputs)


def _sliced(
    staged: DataFrame, by: list[str], order: list[str], outputs: dict[str, Spec], total: int | None, limit: int
) -> DataFrame:
    spark = staged.sparkSession
    rows = total if total is not None else staged.count()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * rows / limit))
    slices = cut(
        staged.repartitionByRange(wanted, *by, *order)
        .withColumn(_SLICE, F.spark_partition_id())
    )
    windows = _windows([*by, _SLICE], order)
    local = slices.withColumns(
        {_RANK: F.row_number().over(windows[0])}
        | {f"__at_{n}": _local(s, f"__in_{n}", windows) for n, s in outputs.items()}
    )
    summary = local.groupBy(*by, _SLICE).agg(
        *[_summary(s, f"__in_{n}").alias(f"__sum_{n}") for n, s in outputs.items()]
    )
    per_group = _windows(by, [_SLICE])
    carried = summary.withColumns(
        {f"__from_{n}": _carry(s, f"__sum_{n}", per_group) for n, s in outputs.items()}
    ).select(
        *[F.col(b).alias(f"__k{i}") for i, b in enumerate(by)],
        F.col(_SLICE).alias("__ks"),
        *[f"__from_{n}" for n in outputs],
    )
    # Only a group that crosses a slice border has something to carry, and a border is crossed by one
    # group: at most two rows per slice are left, so they may be broadcast whatever the data.
    carried = carried.filter(reduce(or_, [F.col(f"__from_{n}").isNotNull() for n in outputs]))
    same = F.col(_SLICE) == F.col("__ks")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__k{i}"))
    merged = local.join(F.broadcast(carried), same, "left")
    return merged.select(
        *staged.columns,
        *[
            _combine(s, F.col(f"__at_{n}"), F.col(f"__from_{n}")).alias(n)
            for n, s in outputs.items()
        ],
    )


def kth_free(
    wanting: DataFrame,
    blocked: DataFrame,
    by: Sequence[str],
    index: str,
    number: str,
    split: bool | None = None,
) -> DataFrame:
    """Adds ``free``: the ``index``-th positive integer that is not among the blocked numbers.

    With blocked r1 < r2 < … this is index + #{j : r_j - j < index}.  Both sides are merged on that
    key in one ordered pass per group, so nothing is compared pairwise.
    """
    by = list(by)
    ranked = scan(blocked.select(*by, number).distinct(), by, [number], {"__j": row_number()}, split)
    blockers = ranked.select(
        *by, (F.col(number) - F.col("__j")).alias("__key"), F.lit(1).alias("__side"), F.col("__j").alias("__tie")
    )
    asking = wanting.select(
        *by, F.col(index).alias("__key"), F.lit(0).alias("__side"), F.lit(0).cast("long").alias("__tie"),
        F.struct(*wanting.columns).alias("__row"),
    )
    merged = scan(
        asking.unionByName(blockers, allowMissingColumns=True),
        by, ["__key", "__side", "__tie"], {"__over": running_sum(F.col("__side"))}, split,
    ).filter(F.col("__side") == 0)
    return merged.select(
        *[F.col("__row")[c].alias(c) for c in wanting.columns], (F.col("__key") + F.col("__over")).alias("free")
    )


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every group.  An aggregate, not a window: each task keeps one row per key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    )
    return best.select(*keys, *[F.col("__first")[c].alias(c) for c in rest]).select(*df.columns)
