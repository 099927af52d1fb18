"""Input files, archives and bundles."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.names import package_of
from symloom.plans.ordered import row_number, running_sum, scan

# Signatures, names and limits.
DEX_MAGIC, ZIP_MAGIC = "6465780A", "504B0304"
ZIP_SUFFIXES = (".apk", ".jar", ".zip")
PLAIN_APK_ENTRIES = ("classes.dex", "AndroidManifest.xml", "resources.arsc")
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_TOTAL_BYTES = 200_000, 512 * 1024**2, 4 * 1024**3
EXTENSIONS = {"java": "java", "kotlin": "kt"}

ENTRY_SCHEMA = "archive string, pos int, name string, method int, csize long, usize long, error string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files; leave ``content`` out of a query and it is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def route(name: Column, magic: Column) -> Column:
    """dex, zip or null from the first four bytes (hex), else from the name."""
    low = F.lower(name)
    zip_name = reduce(lambda a, b: a | b, [low.endswith(s) for s in ZIP_SUFFIXES])
    return (
        F.when(magic == DEX_MAGIC, "dex")
        .when(magic == ZIP_MAGIC, "zip")
        .when(low.endswith(".dex"), "dex")
        .when(zip_name, "zip")
    )


def route_inputs(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, format): dex, zip, apkm, xapk, apks or null.

    ``files(path, content)``; ``entries(archive, name, text)`` with the text of small JSON entries.
    A zip is a bundle when it holds an inner ``.apk`` and none of the files a plain package has.
    """
    kinds = files.select("path", route(F.col("path"), F.hex(F.substring("content", 1, 4))).alias("__kind"))
    name, text = F.col("name"), F.coalesce(F.col("text"), F.lit(""))
    marks = entries.groupBy(F.col("archive").alias("path")).agg(
        F.bool_or(name.isin(*PLAIN_APK_ENTRIES)).alias("plain"),
        F.bool_or(F.lower(name).endswith(".apk")).alias("inner"),
        F.bool_or((name == "info.json") & F.contains(text, F.lit("apkm"))).alias("apkm"),
        F.bool_or(
            (name == "manifest.json")
            & (F.contains(text, F.lit("xapk_version")) | F.contains(text, F.lit("split_apks")))
        ).alias("xapk"),
    )
    joined = kinds.join(marks, "path", "left")
    bundle = (F.col("__kind") == "zip") & F.col("inner") & ~F.col("plain")
    named = F.when(F.col("apkm"), "apkm").when(F.col("xapk"), "xapk").otherwise("apks")
    return joined.select("path", F.when(bundle, named).otherwise(F.col("__kind")).alias("format"))


def _list_zip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                listed = zipfile.ZipFile(io.BytesIO(content)).infolist()
            except (zipfile.BadZipFile, ValueError, NotImplementedError) as refused:
                rows.append((path, None, None, None, None, None, str(refused)))
                continue
            rows.extend(
                (path, i, e.orig_filename, e.compress_type, e.compress_size, e.file_size, None)
                for i, e in enumerate(listed)
            )
        columns = ["archive", "pos", "name", "method", "csize", "usize", "error"]
        yield pd.DataFrame(rows, columns=columns, dtype=object)


def list_entries(files: DataFrame) -> DataFrame:
    """Directory of every archive in files(path, content); an unreadable one is one row with ``error``."""
    zips = files.filter(F.hex(F.substring("content", 1, 4)) == ZIP_MAGIC).select("path", "content")
    return zips.mapInPandas(_list_zip, ENTRY_SCHEMA)


def clean_entry_name(name: Column) -> Column:
    """With ``/`` separators, or null when the name leaves the archive root."""
    slashed = F.replace(name, F.lit("\\"), F.lit("/"))
    unsafe = (
        slashed.startswith("/")
        | (F.substring(slashed, 2, 1) == ":")
        | F.exists(F.split(slashed, "/"), lambda s: s == "..")
    )
    return F.when(~unsafe, slashed)


def guard_entries(
    entries: DataFrame,
    max_entries: int = MAX_ENTRIES,
    max_entry_bytes: int = MAX_ENTRY_BYTES,
    max_total_bytes: int = MAX_TOTAL_BYTES,
    reject_unsafe: bool = True,
    split: bool | None = None,
) -> DataFrame:
    """Adds ``clean`` and ``refusal`` (why an entry is not read, or null).

    An unsafe name refuses the whole archive, or only its own row when ``reject_unsafe`` is off.
    Sizes are summed over all entries in directory order, also those nobody wants.  A row with ``error``,
    where there is such a column, is an archive that could not be listed.
    """
    named = entries.withColumn("clean", clean_entry_name(F.col("name")))
    run = scan(
        named, ["archive"], ["pos"],
        {"__n": row_number(), "__total": running_sum(F.col("usize"))}, split,
    )
    whole = run.groupBy("archive").agg(
        F.bool_or(F.col("clean").isNull()).alias("__unsafe"), F.count(F.lit(1)).alias("__entries")
    )
    joined = run.join(whole, "archive")
    unlisted = F.col("error").isNotNull() if "error" in entries.columns else F.lit(False)
    refusal = F.when(unlisted, "unreadable_archive").when(F.col("__entries") > max_entries, "too_many_entries")
    if reject_unsafe:
        refusal = refusal.when(F.col("__unsafe"), "unsafe_archive")
    refusal = (
        refusal.when(F.col("clean").isNull(), "unsafe_name")
        .when(F.col("usize") > max_entry_bytes, "entry_too_large")
        .when(F.col("__total") > max_total_bytes, "archive_too_large")
    )
    return joined.withColumn("refusal", refusal).drop("__n", "__total", "__unsafe", "__entries")


def merge_inputs(frames: Sequence[DataFrame]) -> DataFrame:
    """All inputs as one frame; ``load_order`` keeps the order of the inputs."""
    numbered = [f.withColumn("load_order", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def part_name(container: Column, index: Column, parts: Column) -> Column:
    """Name of one of several programs in a container: ``name!index`` unless it is the only one."""
    return F.when(parts > 1, F.concat(container, F.lit("!"), index.cast("string"))).otherwise(container)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """parse_id_map of a text file, ``ord`` following its lines."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return parse_id_map(spark.read.text(path).select("value", place.alias("ord")))


def parse_id_map(lines: DataFrame) -> DataFrame:
    """(…, id, name) from ``value`` lines ``hexid=type/name``; other lines are skipped, other columns kept."""
    rest = [c for c in lines.columns if c != "value"]
    hex_id = F.regexp_extract("value", "^([+-]?[0-9a-fA-F]+)=", 1)
    digits = F.regexp_replace(hex_id, "^[+-]?0*(?=.)", "")
    # what has more significant digits is out of range
    number = F.when(F.length(digits) <= 8, F.conv(digits, 16, 10).cast("long"))
    signed = F.when(hex_id.startswith("-"), -number).otherwise(number)
    return lines.filter(hex_id != "").select(
        *rest, signed.alias("__id"), F.regexp_extract("value", "^[^=]+=(.*)$", 1).alias("name")
    ).filter(F.col("__id").between(-(2**31), 2**31 - 1)).select(*rest, F.col("__id").cast("int").alias("id"), "name")


def export_rows(
    units: DataFrame, language: str = "java", resources: DataFrame | None = None
) -> DataFrame:
    """(path, package, text) per unit(full, code, error); a failed unit still yields a placeholder.

    ``resources(path, text)`` go below ``resources/``.
    """
    path = F.concat(F.translate("full", ".", "/"), F.lit("." + EXTENSIONS[language]))
    reason = F.coalesce(F.col("error"), F.lit("no output"))
    placeholder = F.concat(F.lit("// could not export '"), F.col("full"), F.lit("': "), reason, F.lit("\n"))
    rows = units.select(
        path.alias("path"), package_of(F.col("full")).alias("package"),
        F.coalesce("code", placeholder).alias("text"),
    )
    if resources is None:
        return rows
    extra = resources.filter(F.col("text").isNotNull()).select(
        F.concat(F.lit("resources/"), "path").alias("path"), F.lit("resources").alias("package"), "text"
    )
    return rows.unionByName(extra)


def export_units(
    units: DataFrame,
    path: str,
    fmt: str = "parquet",
    language: str = "java",
    resources: DataFrame | None = None,
    by_package: bool = False,
) -> None:
    """Write export rows.  Files follow the number of rows; ``by_package`` makes one folder per package."""
    writer = export_rows(units, language, resources).write.mode("errorifexists").format(fmt)
    if by_package:
        writer = writer.partitionBy("package")
    writer.save(path)
