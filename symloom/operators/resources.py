"""Resource tables: flattening, reference resolution, bags, types.

Every table but the framework's is keyed by ``app_id`` first: all apps number their resources alike.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.values import REFERENCE, STRING, format_value, hex_text
from symloom.plans.ordered import first_row

BAG_ITEM = "array<struct<name_ref:int,vtype:int,vdata:int>>"


def resource_id(package: Column, type_: Column, entry: Column) -> Column:
    """package << 24 | type << 16 | entry, held in a signed 32-bit int."""
    wide = F.shiftleft(package.cast("long"), 24).bitwiseOR(F.shiftleft(type_.cast("long"), 16)).bitwiseOR(
        entry.cast("long")
    )
    return F.when(wide >= 2**31, wide - 2**32).otherwise(wide).cast("int")


def split_id(id_: Column) -> Column:
    wide = id_.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.struct(
        F.shiftright(wide, 24).cast("int").alias("package"),
        F.shiftright(wide, 16).bitwiseAND(0xFF).cast("int").alias("type"),
        wide.bitwiseAND(0xFFFF).cast("int").alias("entry"),
    )


def flatten_resources(packages: DataFrame) -> DataFrame:
    """One row per (id, configuration).

    ``packages(app_id, package_id, package, types ARRAY<STRUCT<type_id, name, entries ARRAY<STRUCT<
    entry, name, config, vtype, vdata>>>>)``; missing names become ``type<N>`` and ``res_0x…``.
    """
    types = packages.select("app_id", "package_id", "package", F.explode("types").alias("t"))
    rows = types.select("app_id", "package_id", "package", "t.type_id", "t.name", F.explode("t.entries").alias("e"))
    id_ = resource_id(F.col("package_id"), F.col("type_id"), F.col("e.entry"))
    return rows.select(
        "app_id", id_.alias("id"), "package",
        F.coalesce("name", F.concat(F.lit("type"), F.col("type_id").cast("string"))).alias("type"),
        F.coalesce("e.name", F.concat(F.lit("res_0x"), hex_text(id_))).alias("name"),
        F.col("e.config").alias("config"), F.col("e.vtype").alias("vtype"), F.col("e.vdata").alias("vdata"),
    )


class Symbols(NamedTuple):
    """Names of ids: ``app(app_id, id, symbol)`` and ``framework(id, symbol)``, one row per key."""

    app: DataFrame
    framework: DataFrame


def symbolic_names(resources: DataFrame, framework: DataFrame) -> Symbols:
    """The first row of an id in its app, ``resources(app_id, id, type, name, ord)``, and the last name of
    an id in the framework's map, ``framework(id, name, ord)``."""
    own = first_row(
        resources.select("app_id", "id", "type", "name", "ord"), ["app_id", "id"], ["ord", "type", "name"]
    )
    shared = framework.groupBy("id").agg(F.max_by("name", F.struct("ord", "name")).alias("name"))
    return Symbols(
        own.select("app_id", "id", F.concat_ws("/", "type", "name").alias("symbol")),
        shared.select("id", F.concat(F.lit("android:"), F.col("name")).alias("symbol")),
    )


def attach_symbol(df: DataFrame, id_: str, symbols: Symbols, out: str) -> DataFrame:
    """df(app_id, …, id_) with the name of the id: the app's, else the framework's, else null.

    Rows that ask for no resource (null or 0) are settled outside the joins, where they would be one key.
    """
    asks = F.col(id_).isNotNull() & (F.col(id_) != 0)
    own = symbols.app.select("app_id", F.col("id").alias(id_), F.col("symbol").alias("__own"))
    shared = symbols.framework.select(F.col("id").alias(id_), F.col("symbol").alias("__shared"))
    named = df.filter(asks).join(own, ["app_id", id_], "left").join(shared, id_, "left")
    settled = df.filter(~asks).withColumn(out, F.lit(None).cast("string"))
    return named.withColumn(out, F.coalesce("__own", "__shared")).select(*df.columns, out).unionByName(settled)


def resolve_refs(refs: DataFrame, resources: DataFrame, framework: DataFrame) -> DataFrame:
    """refs(app_id, …, id) with ``ref``: ``@type/name``, ``@+id/name``, ``@android:…``, ``@null`` or ``@0x…``.

    The names are plain left joins: Spark broadcasts them when they measure small and otherwise
    shuffles, splitting ids that are referred to very often.
    """
    named = attach_symbol(refs, "id", symbolic_names(resources, framework), "symbol")
    return named.withColumn(
        "ref", format_value(F.lit(REFERENCE), F.col("id"), F.lit(None).cast("string"), F.col("symbol"))
    ).drop("symbol")


def format_entries(entries: DataFrame, symbols: Symbols) -> DataFrame:
    """entries(app_id, …, vtype, vdata, string) with the printable ``value``."""
    return attach_symbol(entries, "vdata", symbols, "__ref").withColumn(
        "value", format_value(F.col("vtype"), F.col("vdata"), F.col("string"), F.col("__ref"))
    ).drop("__ref")


def render_bags(resources: DataFrame, symbols: Symbols, strings: DataFrame | None = None) -> DataFrame:
    """(app_id, id, config, text): ``[name=value, …]`` in item order from ``bag`` arrays; empty bag ``[]``.

    ``resources(app_id, id, config, ord, bag)``; ``symbols`` from symbolic_names.

    Items are exploded from one row's array, named by joins and put back together; a group is never
    larger than the array it came from.  ``strings(app_id, vdata, string)`` names string values.
    """
    keyed = resources.filter(F.col("bag").isNotNull())
    items = keyed.select("app_id", "id", "config", "ord", F.posexplode_outer("bag").alias("pos", "item"))
    flat = items.select(
        "app_id", "id", "config", "ord", "pos",
        F.col("item.name_ref").alias("name_ref"), F.col("item.vtype").alias("vtype"),
        F.col("item.vdata").alias("vdata"),
    )
    if strings is None:
        flat = flat.withColumn("string", F.lit(None).cast("string"))
    else:
        hit = strings.withColumn("vtype", F.lit(STRING))
        flat = flat.join(hit, ["app_id", "vtype", "vdata"], "left")
    valued = format_entries(flat, symbols)
    named = attach_symbol(valued, "name_ref", symbols, "__symbol").withColumn("__name", F.translate("__symbol", "/", "."))
    text = F.when(F.col("__name").isNotNull(), F.concat("__name", F.lit("="), "value")).otherwise(F.col("value"))
    rows = named.select("app_id", "id", "config", "ord", F.when(F.col("pos").isNotNull(), F.struct("pos", text.alias("t"))).alias("i"))
    put = rows.groupBy("app_id", "id", "config", "ord").agg(F.array_sort(F.collect_list("i")).alias("items"))
    joined = F.array_join(F.transform("items", lambda x: x["t"]), ", ")
    return put.select("app_id", "id", "config", F.concat(F.lit("["), joined, F.lit("]")).alias("text"))


def resource_types(resources: DataFrame) -> DataFrame:
    """(app_id, type, n): how many rows of each type an app has."""
    return resources.groupBy("app_id", "type").agg(F.count(F.lit(1)).alias("n")).orderBy("app_id", "type")
