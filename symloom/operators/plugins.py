"""User-defined parts: input readers, transforms over apps, classes and methods, guarded groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Reader = Callable[[DataFrame], DataFrame]


class Readers:
    """Named input readers in order; for each input the first reader that yields rows wins."""

    def __init__(self) -> None:
        self._readers: dict[str, Reader] = {}

    def register_reader(self, ident: str, fn: Reader) -> None:
        if ident in self._readers:
            raise ValueError(f"reader {ident!r} is registered already")
        self._readers[ident] = fn

    def load(self, files: DataFrame, key: str = "path") -> DataFrame:
        """Rows of the winning reader of every input, with ``reader``.

        A reader declines an input by yielding no row for it.  The winner is an aggregate over
        (input, reader); the rows are then kept by a semi join.
        """
        parts = None
        for rank, (ident, fn) in enumerate(self._readers.items()):
            rows = fn(files).withColumns({"reader": F.lit(ident), "__rank": F.lit(rank)})
            parts = rows if parts is None else parts.unionByName(rows)
        if parts is None:
            raise ValueError("no reader is registered")
        winner = parts.groupBy(key).agg(F.min("__rank").alias("__rank"))
        return parts.join(winner, [key, "__rank"], "left_semi").drop("__rank")


def transform_app(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Whole-program transform: a function from DataFrame to DataFrame, planned by Spark."""
    return df.transform(fn)


def _map_groups(df: DataFrame, keys: Sequence[str], fn, schema) -> DataFrame:
    return df.groupBy(*keys).applyInPandas(fn, schema)


def map_classes(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    return _map_groups(df, ["app_id", "cls"], fn, schema)


def map_methods(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    return _map_groups(df, ["method_key"], fn, schema)


def guarded_apply(
    df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType
) -> DataFrame:
    """Apply ``fn`` to every group; a failing group becomes one row with its keys and ``error``.

    Every group is computed; a caller with groups too large for one task gives finer keys.
    """
    keys = list(keys)
    out = T.StructType([*schema.fields, T.StructField("error", T.StringType())])
    names = [f.name for f in schema.fields]

    def guarded(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        try:
            done = fn(group)[names]
            return done.assign(error=None)
        except Exception as failure:  # noqa: BLE001 - any failure of user code is a result row
            row = {n: [None] for n in names}
            row.update({k: [v] for k, v in zip(keys, key, strict=True) if k in row})
            return pd.DataFrame({**row, "error": [f"{type(failure).__name__}: {failure}"]})

    return df.groupBy(*keys).applyInPandas(guarded, out)
