"""Sharding along a Hilbert curve, so that each shard covers a compact part of several metadata dimensions.

Every dimension is quantised by its own quantiles, the codes are interleaved to a curve index, rows are sorted by
it, and the order is cut into runs.  All of it is DataFrame expressions.  A place in the global order is the number
of rows in earlier ranges plus the place within the range; ranges are cut by the whole sort key, ending with the
text's checksum and the id, so that a value that a third of all rows share is spread over many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from symloom.session import stage

BITS = 5


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """For each state and cell of one level: the cell's place along the curve and the state inside it.

    A state is the corner where the curve enters and the direction in which it leaves; the rule is that of a
    Gray code rotated and reflected into each cell.
    """
    side, mask = 1 << dims, (1 << dims) - 1

    def turn_left(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & mask if by else x

    def place_of(gray: int) -> int:
        out = 0
        while gray:
            out ^= gray
            gray >>= 1
        return out

    def low_ones(x: int) -> int:
        return ((x ^ (x + 1)).bit_length() - 1) if x >= 0 else 0

    place, after = [], []
    for corner in range(side):
        for way in range(dims):
            for cell in range(side):
                turned = turn_left(cell ^ corner, dims - (way + 1))
                at = place_of(turned)
                enter = 0 if at == 0 else ((at - 1) // 2 * 2) ^ ((at - 1) // 2 * 2 >> 1)
                new_corner = corner ^ turn_left(enter, way + 1)
                step = 0 if at == 0 else low_ones(at - 1 if at % 2 == 0 else at)
                place.append(at)
                after.append(new_corner * dims + (way + step + 1) % dims)
    return place, after


def curve_index(codes: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve through a cube of 2^bits cells a side, from one code per dimension."""
    dims = len(codes)
    place, after = curve_tables(dims)
    side = 1 << dims
    places = F.array(*[F.lit(x) for x in place])
    states = F.array(*[F.lit(x) for x in after])

    def level(acc: Column, bit: Column) -> Column:
        digits = [F.shiftleft(F.getbit(code.cast("long"), bit).cast("int"), dims - 1 - k) for k, code in enumerate(codes)]
        cell = reduce(lambda a, b: a.bitwiseOR(b), digits)
        at = acc["state"] * side + cell
        return F.struct(
            (acc["index"] * side + F.get(places, at)).alias("index"),
            F.get(states, at).alias("state"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, level, lambda acc: acc["index"])


def _bounds_of_text(keyed: DataFrame, key: str, cells: int) -> list[bytes]:
    """The values at the quantiles 1 / cells, 2 / cells ... of a binary column, in byte order: at most cells - 1.

    Distinct values are counted, sorted over ranges and cut by their running counts.
    """
    counts = keyed.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__value")).agg(F.count("*").alias("__n"))
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = stage(counts.repartitionByRange(parts, "__value").withColumn("__range", F.spark_partition_id()), "hilbert-values")
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("__range").agg(F.sum("__n").alias("__own")).select(
        "__range",
        F.coalesce(F.sum("__own").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__own").over(Window.partitionBy()).alias("__all"),
    )
    within = Window.partitionBy("__range").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(F.broadcast(ranges), "__range").withColumn("__upto", F.col("__before") + F.sum("__n").over(within))
    crossed = F.expr(f"least({cells - 1}, (__upto * {cells}) div __all) > ((__upto - __n) * {cells}) div __all")
    return [bytes(r["__value"]) for r in placed.filter(crossed).select("__value").collect()]


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """``df`` with __code_0 ... : how many quantile bounds of the dimension lie at or below the value.

    Bounds are at most 2^bits - 1 for each dimension, over all rows; equal bounds count once, so a frequent value takes
    one code.  Nulls and NaN have code 0, as have all values of a dimension without any bound.  What is no number goes by
    all bytes of its text.
    """
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    numeric = [isinstance(df.schema[name].dataType, T.NumericType) for name in dims]
    keys = [F.col(name).cast("double") if n else F.col(name).cast("string").cast("binary") for name, n in zip(dims, numeric, strict=True)]
    keyed = df.withColumns({f"__key_{k}": key for k, key in enumerate(keys)})
    quantiles = [F.percentile_approx(f"__key_{k}", steps, 10000).alias(f"q{k}") for k, n in enumerate(numeric) if n]
    found = keyed.agg(*quantiles).first() if quantiles else None
    codes = {}
    for k, n in enumerate(numeric):
        key = F.col(f"__key_{k}")
        if n:
            bounds = sorted({x for x in (found[f"q{k}"] or []) if x == x})
            parts = [F.when((key >= F.lit(b)) & ~F.isnan(key), 1).otherwise(0) for b in bounds]
        else:
            parts = [F.when(key >= F.lit(b), 1).otherwise(0) for b in _bounds_of_text(keyed, f"__key_{k}", 1 << bits)]
        codes[f"__code_{k}"] = reduce(lambda a, b: a + b, parts, F.lit(0))
    return keyed.withColumns(codes).drop(*[f"__key_{k}" for k in range(len(dims))])


def shard_plan(
    docs: DataFrame,
    dims: list[str],
    shards: int = 40,
    law: str = "rows",
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = BITS,
) -> DataFrame:
    """One row per document: the id, size (UTF-8 bytes of the text plus 16), text_crc32, law, curve, shard and slot (the
    place within the shard, from 0 without gaps).

    ``rows`` cuts runs whose counts differ by at most one, ``bytes`` runs of near equal size: a document belongs to
    the shard in which its middle byte lies.  Rows of equal curve index follow each other by checksum and id, so equal
    texts with equal metadata are neighbours.  Null text has no bytes; null metadata has the lowest code; rows that agree
    in everything take neighbouring slots.  An empty table gives an empty plan.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    if not 2 <= len(dims) <= 5:
        raise ValueError("two to five dimensions")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(id_col).alias("__id"),
        (F.length(body) + 16).cast("long").alias("__size"),
        F.crc32(body).alias("__crc"),
        F.xxhash64(body).alias("__text"),
        *[F.col(name).alias(f"__dim_{k}") for k, name in enumerate(dims)],
    )
    narrow = stage(narrow, "hilbert-rows")
    names, same = [f"__dim_{k}" for k in range(len(dims))], ["__text", "__crc", "__size"]
    # one row for each text that several rows have; combined per task first, so a hot text is not gathered
    several = narrow.groupBy(*same).agg(F.count("*").alias("__n"), F.min(F.struct(*names)).alias("__least")).filter("__n > 1")
    placed = narrow.join(several.drop("__n"), same, "left")
    least = {n: F.when(F.col("__least").isNull(), F.col(n)).otherwise(F.col("__least")[n]) for n in names}
    coded = quantised(stage(placed.withColumns(least).drop("__least"), "hilbert-groups"), names, bits)
    curve = curve_index([F.col(f"__code_{k}") for k in range(len(dims))], bits)
    rows = coded.select("__id", "__size", "__crc", "__text", curve.alias("__curve"))
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["__curve", "__crc", "__text", "__id"]
    placed = rows.repartitionByRange(parts, *order, F.xxhash64("__id", "__size")).withColumn("__range", F.spark_partition_id())
    placed = stage(placed, "hilbert-ranges")
    # one row per range: how many rows and bytes come before it
    ranges = placed.groupBy("__range").agg(F.count("*").alias("__rows"), F.sum("__size").alias("__bytes"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "__range",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rows_before"),
        F.coalesce(F.sum("__bytes").over(earlier), F.lit(0)).alias("__bytes_before"),
        F.sum("__rows").over(Window.partitionBy()).alias("__all_rows"),
        F.sum("__bytes").over(Window.partitionBy()).alias("__all_bytes"),
    )
    within = Window.partitionBy("__range").orderBy(*order)
    numbered = placed.join(F.broadcast(ranges), "__range").select(
        "*",
        (F.col("__rows_before") + F.row_number().over(within) - 1).alias("__at"),
        (F.col("__bytes_before") + F.sum("__size").over(within.rowsBetween(Window.unboundedPreceding, 0))).alias("__upto"),
    )
    if law == "rows":
        # shard k holds the places from ceil(k n / shards) on
        shard = F.expr(f"(__at * {shards}) div __all_rows")
        first = F.expr(f"((((__at * {shards}) div __all_rows) * __all_rows) + {shards - 1}) div {shards}")
        cut = numbered.select("*", shard.alias("__shard"), (F.col("__at") - first).alias("__slot"))
    else:
        shard = F.expr(f"least({shards - 1}, ((2 * __upto - __size) * {shards}) div (2 * __all_bytes))")
        cut = stage(numbered.select("*", shard.alias("__shard")), "hilbert-cuts")
        starts = cut.groupBy("__shard").agg(F.min("__at").alias("__first"))
        cut = cut.join(F.broadcast(starts), "__shard").withColumn("__slot", F.col("__at") - F.col("__first"))
    return cut.select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit(law).alias("law"),
        F.col("__curve").alias("curve"),
        F.col("__shard").cast("int").alias("shard"),
        F.col("__slot").cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The documents as Parquet, a folder for each shard, rows in slot order; ids have to be unique.

    Files cover compact ranges of all dimensions, so a reader's filter on any of them skips files by their statistics.
    """
    named = plan.select(F.col(id_col).alias("__id"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    both = docs.join(named, docs[id_col].eqNullSafe(named["__id"])).drop("__id")
    ordered = both.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    ordered.withColumnRenamed("__shard", "shard").drop("__slot").write.partitionBy("shard").parquet(path)
