"""Work inside groups that were counted to be small.

A question about one method's graph needs as many relational rounds as the method is deep, and every
round would shuffle the edges of all methods.  Methods up to a row limit are therefore brought
together once, sorted, and answered one after the other inside their task; rows stream through and
only one counted method is held.  The few methods above the limit take the relational way.  Names
that are given one after the other within a scope are treated alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHOD_ROWS_KEY = "spark.symloom.methodRows"
METHOD_ROWS = 5_000
NAMING_ROWS_KEY = "spark.symloom.namingRows"
NAMING_ROWS = 100_000
OUT_ROWS = 50_000

Solve = Callable[[object, list[tuple]], Iterable[tuple]]


def split_by_size(
    rows: DataFrame, key: str, setting: str = METHOD_ROWS_KEY, default: int = METHOD_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of small groups, keys of large groups or None).  At most rows / limit keys are large."""
    limit = int(rows.sparkSession.conf.get(setting, str(default)))
    large = rows.groupBy(key).count().filter(F.col("count") > limit).select(key)
    if large.isEmpty():
        return rows, None
    return rows.join(large, key, "left_anti").select(*rows.columns), large


def solve_groups(rows: DataFrame, key: str, solve: Solve, schema: str) -> DataFrame:
    """``solve(key, rows)`` for every group of bounded size, in no order; it yields result tuples.

    A window brings each group together, not a repartition: where a union of tables that have the key's partitioning is below,
    Spark leaves a repartition out and then coalesces each side of the union by itself, which tears groups apart.  What a window needs
    is checked again after coalescing.
    """
    names = rows.columns
    at = names.index(key)
    out_names = [part.split()[0] for part in schema.split(",")]

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        current, held = None, []
        for batch in batches:
            for row in zip(*[batch[n].tolist() for n in names], strict=True):
                if row[at] != current:
                    if held:
                        yield current, held
                    current, held = row[at], []
                held.append(row)
        if held:
            yield current, held

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        results = (out for current, held in groups(batches) for out in solve(current, held))
        while chunk := list(islice(results, OUT_ROWS)):
            yield pd.DataFrame(chunk, columns=out_names)

    together = rows.withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return together.mapInPandas(run, schema)
