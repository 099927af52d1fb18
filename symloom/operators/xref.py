"""Cross references: usage index, call resolution, member lookup, unused and unresolved symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.text import running_sums
from symloom.operators import positions
from symloom.plans.apps import APP, has_app, packed, unpacked
from symloom.plans.fixpoint import sized
from symloom.plans.ordered import first_row, needs_split, row_number, scan
from symloom.plans.sieve import sifted
from symloom.session import BROADCAST_ROWS, cut, stage

# Symbol kinds that are indexed.
INDEXED_KINDS = ("class", "method", "field")


def usage_index(annots: DataFrame, units: DataFrame) -> DataFrame:
    """One row per use of a class, method or field.

    ``annots(unit, off, kind, sym)`` with kind def, ref, var or end; ``units(unit, code)``.
    Result ``(target, from_unit, from_member, off, line)``: rows, not one list per target, so a
    symbol that a third of the corpus refers to stays spread over tasks.  ``write_usage_index`` stores it so that one
    symbol is looked up without a scan.  With an ``app_id`` on both sides units are those of one app, and the result has it too.
    """
    if has_app(annots, units):
        return unpacked(usage_index(packed(annots, "unit"), packed(units, "unit")), "from_unit")
    split = needs_split(annots, ["unit"])
    placed = positions.enclosing(annots, split)
    refs = placed.filter(
        (F.col("kind") == "ref") & F.col("sym.kind").isin(*INDEXED_KINDS)
    ).select(
        F.col("unit"), F.col("off"), F.col("sym").alias("target"),
        F.when(F.col("encl.kind") == "method", F.col("encl")).alias("from_member"),
    )
    # only line starts travel, never the code text
    starts = positions.line_starts(units)
    lined = positions.asof(refs, starts, ["unit"], "off", "start_off", ["line"], split=split)
    return lined.select("target", F.col("unit").alias("from_unit"), "from_member", "off", "line")


def target_key(target: Column) -> Column:
    """A symbol as one string: kind, owner, name and parameters, apart by a sign that is in none of them."""
    parts = F.array(target["kind"], target["owner"], target["name"])
    return F.array_join(F.concat(parts, F.coalesce(target["params"], F.array().cast("array<string>"))), "\x1f", "\x1e")


def write_usage_index(usages: DataFrame, table: str, path: str, buckets: int = 256) -> None:
    """Stores an index as a table of the catalog, bucketed and sorted by target.

    A target that very many units use fills one bucket only; its rows are still written by all tasks that hold some of
    them, each to a file of its own, so no task gathers it.
    """
    keyed = usages.withColumn("key", target_key(F.col("target")))
    keyed.write.option("path", path).bucketBy(buckets, "key").sortBy("key", "from_unit").saveAsTable(table)


def usages_of(spark: SparkSession, table: str, target: Column) -> DataFrame:
    """The uses of one symbol, read from its bucket; files whose range of keys leaves it out are skipped by their statistics."""
    return spark.table(table).filter(F.col("key") == target_key(target)).drop("key")


def ranked_usages(usages: DataFrame, target: str, order: Sequence[str]) -> DataFrame:
    """Position of every use in its target's list sorted by (file, offset)."""
    return scan(usages, [target], list(order), {"rank": row_number()})


def usage_counts(usages: DataFrame, target: str = "target", file: str = "from_unit") -> DataFrame:
    """Uses and referring files per target; uses are combined per (target, file) first, so a hot
    target reaches the last exchange as one row per file and map task."""
    per_file = usages.groupBy(target, file).agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy(target).agg(
        F.sum("n").alias("n"), F.count(file).alias("files")
    )


def resolve_calls(calls: DataFrame, methods: DataFrame, strict: bool = False) -> DataFrame:
    """Left join of calls(cls, name, params, ret) to the first matching method in declaration order.

    ``strict`` also compares the return type; where both sides have an ``app_id`` calls stay in their
    app.  ``method_key`` is null for library targets.
    """
    app = ["app_id"] if "app_id" in calls.columns and "app_id" in methods.columns else []
    keys = [*app, "cls", "name", "params", *(["ret"] if strict else [])]
    declared = first_row(methods.select(*keys, "method_key", "ord"), keys, ["ord", "method_key"])
    return calls.join(declared.select(*keys, "method_key"), keys, "left")


def resolve_member(refs: DataFrame, members: DataFrame, walk: DataFrame) -> DataFrame:
    """Member a reference means when it may be inherited.

    ``refs(…, cls, name, params)``, ``members(cls, name, params, ord, member)``,
    ``walk(cls, anc, path)`` from graph.closure.  A class is walked before its ancestors, the super
    branch before the interfaces.  An exact signature anywhere beats a match by name alone.  With an ``app_id`` in
    all three, references stay in their app.
    """
    if has_app(refs, members, walk):
        kept = refs.withColumn("__app", F.col(APP))
        found = resolve_member(packed(kept, "cls"), packed(members, "cls"), packed(walk, "cls", "anc"))
        inner = found.withColumnsRenamed({"__app": APP}).withColumns({"cls": F.col("cls")["value"], "owner": F.col("owner")["value"]})
        return inner.select(*refs.columns, "owner", "member")
    keys = ["cls", "name", "params"]
    # a popular member is looked up once, not once per reference
    asked = refs.select(*keys).distinct()
    itself = asked.select("cls").distinct().select(
        "cls", F.col("cls").alias("anc"), F.array().cast("array<int>").alias("path")
    )
    steps = itself.unionByName(walk.select("cls", "anc", "path"))
    names = asked.select("cls", "name").distinct()
    owned = members.select(
        F.col("cls").alias("anc"), "name", F.col("params").alias("params"), "ord", "member"
    )
    # the walk meets members before it meets references, so no reference is repeated for each ancestor
    offered = (
        steps.join(asked.select("cls").distinct(), "cls", "left_semi")
        .join(owned.join(asked.select("name").distinct(), "name", "left_semi"), "anc")
        .groupBy("cls", "name", "params")
        .agg(F.min(F.struct("path", "ord", "member", "anc")).alias("first"))
        .join(names, ["cls", "name"], "left_semi")
    )
    by_name = offered.groupBy("cls", "name").agg(
        F.min("first").alias("any"), F.collect_list(F.struct("params", "first")).alias("overloads")
    )
    same = F.filter("overloads", lambda o: o["params"] == F.col("params"))
    found = asked.join(by_name, ["cls", "name"]).select(*keys, F.coalesce(F.get(same, F.lit(0))["first"], F.col("any")).alias("hit"))
    hit = found.select(*keys, F.col("hit.anc").alias("owner"), F.col("hit.member").alias("member"))
    return refs.join(hit, keys, "left")


def unreferenced(symbols: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    return symbols.join(refs.select(key), key, "left_anti")


def unresolved(refs: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    return refs.join(symbols.select(key), key, "left_anti")


_WORD = "[\\p{L}\\p{Nd}_$]"


def symbol_at(annots: DataFrame, units: DataFrame, clicks: DataFrame) -> DataFrame:
    """Symbol meant by a click(click, unit, line, token, hint).

    First definition or reference on that line whose text is the whole token; one of the hinted kind
    is preferred.  The places of clicked words are worked out where the code is, so neither code text nor other words travel, and
    annotations are sifted by them before they are shuffled.  What stands on a word that is clicked nowhere goes no
    further; the rest is written once.  Clicks then meet the first annotation
    of each word, line and kind; only tokens that are more than a word look at single places.  With an ``app_id`` in all three,
    units are those of one app; ``click`` tells the clicks of all apps apart.
    """
    if has_app(annots, units, clicks):
        return symbol_at(packed(annots, "unit"), packed(units, "unit"), packed(clicks, "unit"))

    candidates = annots.filter(
        F.col("kind").isin("def", "ref") & F.col("sym.kind").isin(*INDEXED_KINDS)
    ).select("unit", "off", "sym")
    keys = ["unit", "line", "token", "hint"]
    asks = clicks.select(*keys).distinct().filter(F.length("token") > 0).withColumn(
        "word", F.regexp_extract("token", f"^{_WORD}*", 0)
    )
    asked = cut(asks.groupBy("word").agg(F.max(F.col("token") != F.col("word")).alias("longer")))
    several = positions.repeated(units)
    n = several.count()
    spots = stage(_spots(units.join(sized(several, n), "unit", "left_anti") if n else units, asked), "spots")
    found = _on_spots(candidates, spots, spots.count())
    if n:
        among = lambda df: df.join(sized(several, n), "unit", "left_semi")
        worded = _worded(among(candidates), among(units), needs_split(among(annots), ["unit"]))
        found = found.unionByName(worded.join(sized(asked, asked.count()), "word", "left_semi").select(*found.columns))
    placed = cut(found)
    off_kind = F.coalesce(F.col("sym.kind") != F.col("hint"), F.lit(False))
    choice = F.min_by(F.struct("sym", "off"), F.struct(off_kind.alias("x"), "off")).alias("hit")
    firsts = placed.groupBy("unit", "line", "word", F.col("sym.kind").alias("k")).agg(
        F.min_by("sym", "off").alias("sym"), F.min("off").alias("off")
    )
    on = ["unit", "line", "word"]
    hits = asks.filter(F.col("token") == F.col("word")).join(firsts, on).select(*keys, "sym", "off")
    if not asked.filter("longer").isEmpty():
        hits = hits.unionByName(
            asks.filter(F.col("token") != F.col("word"))
            .join(placed, on)
            .join(units.select("unit", "code"), "unit")
            .filter(
                (F.substring(F.col("code"), F.col("off") + 1, F.length("token")) == F.col("token"))
                & ~F.substring(F.col("code"), F.col("off") + F.length("token") + 1, F.lit(1)).rlike(_WORD)
            )
            .select(*keys, "sym", "off")
        )
    best = hits.groupBy(*keys).agg(choice)
    same = [clicks[c].eqNullSafe(best[c]) for c in keys]
    return clicks.join(best, same, "left").select(
        clicks["click"], F.col("hit.sym").alias("sym"), F.col("hit.off").alias("off")
    )


def _spots(units: DataFrame, asked: DataFrame) -> DataFrame:
    """(unit, line, off, word): the places from which the rest of a word is one of asked(word), in units of one row each.

    The rest is empty on every sign that is in no word, ends of lines included.
    """
    sizes = [r[0] for r in asked.select(F.length("word")).distinct().collect()]
    cells = positions.line_texts(units).select(
        "unit", "line", "start_off", F.length("text").alias("size"),
        F.regexp_extract_all("text", F.lit(f"{_WORD}+"), F.lit(0)).alias("word"), F.split("text", f"{_WORD}+").alias("gap"),
    )
    steps = F.zip_with("word", F.slice("gap", F.lit(1), F.size("word")), lambda w, g: F.length(w) + F.length(g))
    summed = cells.withColumn("end", running_sums(steps))
    words = summed.select("unit", "line", "start_off", F.explode(F.arrays_zip("word", "end")).alias("z")).select(
        "unit", "line", (F.col("start_off") + F.col("z.end")).alias("end"), F.col("z.word").alias("word")
    )
    tails = F.filter(F.array(*[F.lit(k) for k in sizes if k]).cast("array<int>"), lambda k: k <= F.length("word"))
    rests = words.withColumn("k", F.explode(tails)).select(
        "unit", "line", (F.col("end") - F.col("k")).alias("off"), F.substring("word", F.length("word") - F.col("k") + 1, F.col("k")).alias("word")
    )
    spots = rests.join(sized(asked, asked.count()), "word", "left_semi").select("unit", "line", "off", "word")
    if 0 not in sizes:
        return spots
    gaps = summed.select("unit", "line", "start_off", "size", F.explode(F.arrays_zip("gap", "word", "end")).alias("z"))
    # the last gap of a line holds the line's end
    last = F.col("z.word").isNull()
    stop = F.when(last, F.col("size") + 1).otherwise(F.col("z.end") - F.length("z.word"))
    first = F.when(last, F.col("size")).otherwise(stop) - F.length("z.gap")
    between = gaps.withColumns({"first": first.cast("long"), "stop": stop.cast("long")}).filter("first < stop")
    return spots.unionByName(
        between.select("unit", "line", F.col("start_off"), F.explode(F.sequence("first", F.col("stop") - 1)).alias("at")).select(
            "unit", "line", (F.col("start_off") + F.col("at")).alias("off"), F.lit("").alias("word")
        )
    )


def _on_spots(candidates: DataFrame, spots: DataFrame, rows: int) -> DataFrame:
    at = candidates.withColumn("__at", F.col("off").cast("long"))
    there = spots.withColumnRenamed("off", "__at")
    if rows > BROADCAST_ROWS:
        at = sifted(at, ["unit", "__at"], there, rows)
    return at.join(sized(there, rows), ["unit", "__at"]).select("unit", "line", "off", "sym", "word")


def _worded(candidates: DataFrame, units: DataFrame, split: bool) -> DataFrame:
    """Line and rest of the word of each annotation by one as-of scan, for units that come in several rows."""
    from symloom.operators.search import spans_of

    starts = positions.line_starts(units)
    words = spans_of(units, f"{_WORD}+").select("unit", F.col("start").alias("w_at"), "text")
    worded = positions.floor_each(
        candidates, ["unit"], "off", [(starts, "start_off", ["line"]), (words, "w_at", ["w_at", "text"])], split
    )
    # what is left of the word from the annotation on; empty where no word goes on
    rest = F.substring(F.col("text"), (F.col("off") - F.col("w_at") + 1).cast("int"), F.length("text"))
    return worded.select("unit", "line", "off", "sym", F.coalesce(rest, F.lit("")).alias("word"))
