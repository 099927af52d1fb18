"""Set-at-a-time fixpoints.

Every round joins only the rows that were new in the round before, and is cut into the shared
checkpoint folder so plans stay flat and a lost executor costs one round.  While the new rows are
many, joins are plain ones that AQE may split.  Once they are counted to be few they are broadcast,
so the static tables and the result so far are scanned but no longer shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.session import BROADCAST_ROWS, cut, cut_spread

COMPACT_EVERY = 12
# below this many rows shuffling the result so far costs less than one more materialised step
SHUFFLE_ROWS = 2_000_000


def fresh(df: DataFrame) -> DataFrame:
    """New column identities, so a frame can be joined with a descendant of itself."""
    return df.toDF(*df.columns)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """A frame whose rows have been counted, to be broadcast if they are few."""
    return F.broadcast(fresh(df)) if rows <= BROADCAST_ROWS else fresh(df)


def grow(
    seed: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    keys: Sequence[str] | None = None,
    barred: DataFrame | None = None,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Least set that holds ``seed`` and is closed under ``step`` (which sees only new rows).

    ``barred`` and ``allowed`` hold keys that a found row must not, or must, be among.  Rows are told
    apart by ``keys``; of several found in one round any is kept.
    """
    columns = seed.columns
    keys = list(keys or columns)

    def admit(found: DataFrame) -> DataFrame:
        closed = fresh(total).select(*keys)
        if barred is not None:
            closed = closed.unionByName(fresh(barred).select(*keys))
        out = found.join(closed, keys, "left_anti")
        if allowed is not None:
            out = out.join(fresh(allowed).select(*keys), keys, "left_semi")
        return out.select(*columns)

    def admit_few(found: DataFrame, rows: int) -> DataFrame:
        # the few found rows go to the large tables, not the other way round
        def among(table: DataFrame) -> DataFrame:
            return fresh(table).select(*keys).join(sized(found.select(*keys), rows), keys, "left_semi")

        known = among(total) if barred is None else among(total).unionByName(among(barred))
        out = found.join(F.broadcast(known.distinct()), keys, "left_anti")
        if allowed is not None:
            out = out.join(F.broadcast(among(allowed).distinct()), keys, "left_semi")
        return out.select(*columns)

    total = delta = cut(seed.dropDuplicates(keys))
    size = new = delta.count()
    static = sum(t.count() for t in (barred, allowed) if t is not None)
    rounds = 0
    while new:
        rounds += 1
        found = step(sized(delta, new)).select(*columns).dropDuplicates(keys)
        if new <= BROADCAST_ROWS and size + static > SHUFFLE_ROWS:
            found = cut(found)
            rows = found.count()
            delta = cut(admit_few(found, rows) if rows <= BROADCAST_ROWS else admit(found))
        else:
            delta = cut(admit(found))
        new = delta.count()
        size += new
        if new:
            total = total.unionByName(delta)
            if rounds % COMPACT_EVERY == 0:
                total = cut_spread(total)
    return total
