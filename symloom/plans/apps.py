"""The application as part of a key.

Class names, units and offsets repeat from app to app.  An operator whose tables hold an ``app_id`` packs it into
its key columns, so that every join, group and order inside it stays within one app, and unpacks it from the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

APP = "app_id"


def has_app(*frames: DataFrame) -> bool:
    """Whether the tables are keyed by app; either all are or none is."""
    keyed = [APP in f.columns for f in frames]
    if any(keyed) and not all(keyed):
        raise ValueError(f"{APP} is in some of the tables only")
    return all(keyed)


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """Each column becomes a struct of the app and its value; null stays null."""
    both = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(APP), F.col(c).alias("value"))) for c in columns}
    return df.withColumns(both).drop(APP)


def unpacked(df: DataFrame, first: str, *more: str) -> DataFrame:
    """The app of ``first``, which is never null, as a column, and the values of all the columns named."""
    values = {c: F.col(c)["value"] for c in (first, *more)}
    return df.withColumn(APP, F.col(first)[APP]).withColumns(values).select(APP, *df.columns)
