"""A filter before a join: rows whose key is surely not on the other side are not shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# a key has one bit of this many; beyond the most bits (64 MB to broadcast) more rows pass, none is lost
BITS_A_KEY, MOST_BITS = 16, 1 << 29
# bits of one bitmap of Spark's
_ROW = 15


def sifted(df: DataFrame, on: Sequence[str], keys: DataFrame, rows: int) -> DataFrame:
    """The rows of df whose columns ``on`` may be a row of ``keys`` (as many as counted); the join itself is still to be made.

    Columns of one name have to be of one type.  A type that has several forms of one value is not sifted.
    """
    kinds = [df.schema[c].dataType for c in on]
    if kinds != [keys.schema[c].dataType for c in on] or any(w in k.simpleString() for k in kinds for w in ("float", "double", "collate")):
        return df
    buckets = max(1, min(MOST_BITS, 1 << (BITS_A_KEY * rows).bit_length()) >> _ROW)
    digest = F.xxhash64(*on)

    def bucket() -> Column:
        return F.shiftright(digest, _ROW).bitwiseAND(F.lit(buckets - 1))

    place = digest.bitwiseAND(F.lit((1 << _ROW) - 1))
    # brought together before they are made, or every task would make all bitmaps
    dealt = keys.select(bucket().alias("__bucket"), place.alias("__place")).repartition("__bucket")
    maps = dealt.groupBy("__bucket").agg(F.bitmap_construct_agg("__place").alias("__map"))
    marked = df.withColumns({"__bucket": bucket(), "__place": place}).join(F.broadcast(maps), "__bucket")
    byte = F.conv(F.hex(F.substring("__map", (F.shiftright("__place", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.col("__place").bitwiseAND(F.lit(7)).cast("int")) == 1
    return marked.filter(hit).select(*df.columns)
