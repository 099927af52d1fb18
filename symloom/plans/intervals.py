"""Interval joins on a grid of doubling cell sizes.

An interval lives on the level whose cell is at least as long as the interval, so it touches at
most two cells there.  The other side is placed on every level in use (at most 63, from the data).
A pair meets in exactly one shared cell: the one that holds the later of the two starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level_of(start: Column, end: Column) -> Column:
    """Smallest k with 2**k >= length of the closed interval [start, end]."""
    return F.ceil(F.log2((end - start + 1).cast("double"))).cast("int")


def _cell(position: Column, level: Column) -> Column:
    return F.floor(position / F.pow(F.lit(2.0), level)).cast("long")


def levels_in_use(ranges: DataFrame, start: str, end: str) -> list[int]:
    rows = ranges.select(level_of(F.col(start), F.col(end)).alias("k")).distinct().collect()
    return sorted(r["k"] for r in rows if r["k"] is not None)


def _own_cells(ranges: DataFrame, start: str, end: str) -> DataFrame:
    level = level_of(F.col(start), F.col(end))
    return ranges.filter(F.col(end) >= F.col(start)).withColumn("__level", level).withColumn(
        "__cell",
        F.explode(F.sequence(_cell(F.col(start), F.col("__level")), _cell(F.col(end), F.col("__level")))),
    )


def points_in_ranges(
    points: DataFrame, ranges: DataFrame, by: Sequence[str], at: str, start: str, end: str
) -> DataFrame:
    """Every (point, range) of one group with start <= at <= end.

    Column names of the two sides must differ except for ``by``.
    """
    levels = levels_in_use(ranges, start, end)
    if not levels:
        levels = [0]
    placed = points.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels])))
    placed = placed.withColumn("__cell", _cell(F.col(at), F.col("__level")))
    joined = placed.join(_own_cells(ranges, start, end), [*by, "__level", "__cell"])
    return joined.filter((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).drop(
        "__level", "__cell"
    )


def overlapping(
    ranges: DataFrame, by: Sequence[str], ident: str, start: str, end: str
) -> DataFrame:
    """Pairs (id1 < id2) of one group whose closed ranges share a position."""
    levels = levels_in_use(ranges, start, end) or [0]
    base = ranges.select(*by, ident, start, end)
    big = _own_cells(base, start, end).select(
        *by, "__level", "__cell",
        F.col(ident).alias("__a"), F.col(start).alias("__as"), F.col(end).alias("__ae"),
    )
    own = level_of(F.col(start), F.col(end))
    small = (
        base.filter(F.col(end) >= F.col(start))
        .withColumn("__own", own)
        .withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels])))
        .filter(F.col("__level") >= F.col("__own"))
        .withColumn(
            "__cell",
            F.explode(
                F.sequence(_cell(F.col(start), F.col("__level")), _cell(F.col(end), F.col("__level")))
            ),
        )
        .select(
            *by, "__level", "__cell", "__own",
            F.col(ident).alias("__b"), F.col(start).alias("__bs"), F.col(end).alias("__be"),
        )
    )
    later = F.greatest("__as", "__bs")
    met = big.join(small, [*by, "__level", "__cell"]).filter(
        (later <= F.least("__ae", "__be"))
        & (_cell(later, F.col("__level")) == F.col("__cell"))
        & (F.col("__a") != F.col("__b"))
        & ((F.col("__level") > F.col("__own")) | (F.col("__a") < F.col("__b")))
    )
    return met.select(
        *by, F.least("__a", "__b").alias("id1"), F.greatest("__a", "__b").alias("id2")
    )
