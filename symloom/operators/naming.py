"""Names given to symbols: generated aliases, uniqueness, imports, edits and renames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.names import package_of, rename_error
from symloom.functions.signatures import ANNOTATION, ENUM, has_flag
from symloom.functions.text import quote, trim_text
from symloom.operators.graph import on_cycle
from symloom.operators.positions import asof
from symloom.plans.apps import APP, has_app
from symloom.plans.bounded import NAMING_ROWS, NAMING_ROWS_KEY, solve_groups, split_by_size
from symloom.plans.fixpoint import fresh
from symloom.plans.ordered import (
    first_row,
    kth_free,
    lag,
    last_value,
    needs_split,
    row_number,
    running_sum,
    scan,
)
from symloom.session import cut

# Generated names are a prefix and a number padded to four digits.
PAD = 4
PREFIXES = {"class": "C", "field": "f", "method": "m"}


def renamable_class(flags: Column, simple: Column, is_leaf: Column, is_top: Column, short: Column) -> Column:
    """A class that can get a generated name: leaf, top level, no ``$``, not an enum or annotation."""
    special = has_flag(flags, ENUM) | has_flag(flags, ANNOTATION)
    return is_top & is_leaf & ~F.contains(simple, F.lit("$")) & ~special & short


def allocate_names(
    symbols: DataFrame,
    scope: Sequence[str],
    order: Sequence[str],
    prefix: str,
    split: bool | None = None,
) -> DataFrame:
    """Give each renamable symbol the next free ``<prefix>0001`` of its scope.

    ``symbols`` has ``name`` and ``renamable``; kept names are reserved.  The k-th symbol of a scope
    gets the k-th number that no kept name spells.  The symbols are written once and read back: what they are
    derived from is worked out once, and names are tried as rows of that table, not below a distinct that made them.
    """
    scope, order = list(scope), list(order)
    symbols = cut(symbols)
    if split is None:
        split = needs_split(symbols, scope)
    numbered = scan(
        symbols.filter("renamable"), scope, order, {"__k": row_number()}, split
    )
    digits = F.regexp_extract("name", f"^{quote(prefix)}([0-9]{{1,15}})$", 1)
    number = digits.try_cast("long")
    canonical = F.concat(F.lit(prefix), padded(number)) == F.col("name")
    kept = (
        symbols.filter(~F.col("renamable"))
        .withColumn("__r", number)
        .filter(F.col("__r").isNotNull() & canonical & (F.col("__r") > 0))
        .select(*scope, "__r")
        .distinct()
    )
    placed = kth_free(numbered, kept, scope, "__k", "__r", split)
    return placed.select(
        *symbols.columns, F.concat(F.lit(prefix), padded(F.col("free"))).alias("alias")
    )


def padded(number: Column) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) < PAD, F.lpad(text, PAD, "0")).otherwise(text)


# --- uniqueness suffixes ---------------------------------------------------------------------

_STEM = "^([\\s\\S]*?)[0-9]*$"


def unique_names(
    symbols: DataFrame, scope: Sequence[str], order: Sequence[str], base: str, split: bool | None = None
) -> DataFrame:
    """First symbol of a scope keeps its base name, later ones get base2, base3, … skipping taken ones.

    Only bases that differ in trailing digits alone can make each other's names.  Every other base is
    numbered by its position, which is exact.  Mixed families of a counted, bounded size are named one
    by one inside tasks, larger ones by rounds over all scopes.
    """
    scope, order = list(scope), list(order)
    stemmed = symbols.withColumn("__stem", F.regexp_extract(F.col(base), _STEM, 1))
    family = [*scope, "__stem"]
    mixed = (
        stemmed.groupBy(*family)
        .agg((F.min(base) != F.max(base)).alias("__mixed"))
        .filter("__mixed")
        .select(*family)
    )
    if split is None:
        split = needs_split(symbols, scope)
    simple = stemmed.join(mixed, family, "left_anti")
    ranked = scan(simple, [*scope, base], order, {"__i": row_number()}, split)
    plain = ranked.withColumn("name", _suffixed(F.col(base), F.col("__i"))).select(*symbols.columns, "name")
    rest = scan(stemmed.join(mixed, family, "left_semi"), scope, order, {"__t": row_number()}, split)
    rest = cut(rest.withColumn("__family", F.to_json(F.struct(*family))))
    if rest.isEmpty():
        return plain
    asked = rest.select("__family", "__t", F.col(base).alias("__base"))
    small, large = split_by_size(asked, "__family", NAMING_ROWS_KEY, NAMING_ROWS)
    given = solve_groups(small, "__family", _give_names, "__family string, __t long, name string")
    named = rest.join(given, ["__family", "__t"]).select(*symbols.columns, "name")
    if large is None:
        return plain.unionByName(named)
    settled = _settle(fresh(rest).join(large, "__family", "left_semi"), scope, base, split)
    return plain.unionByName(named).unionByName(settled.select(*symbols.columns, "name"))


def _give_names(family, rows):
    taken: set = set()
    following: dict = {}
    for _, t, base in sorted(rows, key=lambda r: r[1]):
        name = base
        if base in taken:
            n = following.get(base, 2)
            while f"{base}{n}" in taken:
                n += 1
            following[base] = n + 1
            name = f"{base}{n}"
        taken.add(name)
        yield family, t, name


def _suffixed(base: Column, number: Column) -> Column:
    return F.when(number == 1, base).otherwise(F.concat(base, number.cast("string")))


def _settle(timed: DataFrame, scope: list[str], base: str, split: bool) -> DataFrame:
    """Names of families whose bases make each other's names; ``__t`` numbers the rows of a scope.

    Names are assumed, what they take from other bases is worked out, and names are given again until
    nothing changes.  A symbol only depends on earlier ones, so every round settles at least the next
    of them and the end is what giving names one by one would give.  Each round is joins and ordered
    passes over all scopes at once.
    """
    rows = cut(scan(timed, [*scope, base], ["__t"], {"__o": row_number()}, split))
    owner = [*scope, "__base"]
    keyed = rows.select(*scope, F.col(base).alias("__base"), "__t", "__o")
    firsts = cut(keyed.filter("__o = 1").select(*owner, F.col("__t").alias("__first")))
    names = cut(keyed.withColumn("__name", _suffixed(F.col("__base"), F.col("__o"))))
    skips = None
    while True:
        taken = fresh(names)
        # every way to read a taken name as another base and a number
        digits = F.length(F.regexp_extract("__name", "([0-9]*)$", 1))
        cuts = taken.filter(digits > 0).withColumn(
            "__len", F.explode(F.sequence(F.lit(1), F.least(digits, F.lit(18))))
        )
        tail = F.right(F.col("__name"), F.col("__len"))
        read = cuts.select(
            *scope, F.left(F.col("__name"), F.length("__name") - F.col("__len")).alias("__as"),
            tail.alias("__tail"), F.col("__base").alias("__by"), F.col("__t").alias("__at"),
        ).filter(~F.col("__tail").startswith("0") & (F.col("__tail") != "1") & (F.col("__as") != F.col("__by")))
        outside = (
            read.withColumnRenamed("__as", "__base")
            .join(fresh(firsts).select(*owner), owner, "left_semi")
            .groupBy(*owner, (F.col("__tail").try_cast("long") - 1).alias("__r"))
            .agg(F.min("__at").alias("__at"))
        )
        # a base whose own name went to another base before its first symbol came
        lost = (
            taken.filter(F.col("__name") != F.col("__base"))
            .select(*scope, F.col("__name").alias("__base"), F.col("__t").alias("__at"))
            .join(fresh(firsts), owner)
            .filter(F.col("__at") < F.col("__first"))
            .select(*owner).distinct().withColumn("__lost", F.lit(1))
        )
        needing = (
            fresh(keyed).join(lost, owner, "left")
            .withColumn("__i", F.col("__o") - 1 + F.coalesce("__lost", F.lit(0)))
            .drop("__lost")
        )
        # a number is skipped when it went elsewhere before this base would use it
        before = asof(
            outside, needing.select(*owner, F.col("__t").alias("__nt"), F.col("__i").alias("__q")),
            owner, "__at", "__nt", ["__q"], strict=True, split=split,
        ).select(*owner, "__r", (F.col("__r") - F.coalesce("__q", F.lit(0))).alias("__a"))
        if skips is None:
            assumed = before.withColumn("__was", F.lit(1))
        else:
            assumed = before.join(fresh(skips), [*owner, "__r"], "left").na.fill(1, ["__was"])
        counted = scan(assumed, owner, ["__r"], {"__c": running_sum(F.col("__was"))}, split)
        now = cut(
            counted.select(*owner, "__r", F.col("__was").alias("__old"),
                           (F.col("__c") - F.col("__was") < F.col("__a")).cast("int").alias("__was"))
        )
        given = kth_free(
            needing.filter("__i > 0"), fresh(now).filter("__was = 1"), owner, "__i", "__r", split
        ).select(*owner, "__t", "__o", F.concat("__base", (F.col("free") + 1).cast("string")).alias("__name"))
        kept = needing.filter("__i = 0").select(*owner, "__t", "__o", F.col("__base").alias("__name"))
        following = cut(given.unionByName(kept))
        moved = fresh(following).join(
            fresh(names).select(*scope, "__t", F.col("__name").alias("__prior")), [*scope, "__t"]
        ).filter(F.col("__name") != F.col("__prior"))
        steady = moved.isEmpty() and now.filter("__old <> __was").isEmpty()
        names, skips = following, now.drop("__old")
        if steady:
            break
    final = fresh(names).select(*scope, "__t", F.col("__name").alias("name"))
    return rows.join(final, [*scope, "__t"])


# --- imports ---------------------------------------------------------------------------------


NESTING = "\\$(?=[^0-9])"


def import_claims(uses: DataFrame, split: bool | None = None) -> DataFrame:
    """How each class used by a unit is written.

    ``uses(unit, own_package, full, seq)``.  A ``$`` parts a nested class from its outer one unless a digit
    follows.  The first top-level class to use a simple name in a unit owns it; others are written in
    full.  A class of the default package claims nothing; ``java.lang`` and the unit's own package claim
    but need no import.
    Result: one row per (unit, full) with ``display`` and ``imported``, whether its top-level class is.
    """
    once = uses.groupBy("unit", "own_package", "full").agg(F.min("seq").alias("seq")).withColumns(
        {"__top": F.split("full", NESTING, 2)[0], "__written": F.regexp_replace("full", NESTING, ".")}
    ).withColumns({"__pkg": package_of(F.col("__top")), "__simple": F.substring_index("__top", ".", -1)})
    owners = (
        once.filter(F.col("__pkg") != "")
        .groupBy("unit", "__simple")
        .agg(F.min_by("__top", F.struct("seq", "__top")).alias("__owner"))
    )
    named = once.join(owners, ["unit", "__simple"], "left")
    owns = (F.col("__pkg") != "") & (F.col("__top") == F.col("__owner"))
    short = F.substring(F.col("__written"), F.length("__pkg") + 2, F.length("__written"))
    near = F.col("__pkg").isin("java.lang") | F.col("__pkg").eqNullSafe(F.col("own_package"))
    return named.select(
        "unit", "full",
        F.when(owns, short).otherwise(F.col("__written")).alias("display"),
        (owns & ~near).alias("imported"),
    )


# --- edits and effective names ---------------------------------------------------------------


def latest_edits(log: DataFrame) -> DataFrame:
    """Text now attached to each symbol from log(sym, seq, text); a blank text deletes.

    Only the latest edit of a symbol counts, so this is one aggregate.  ``changed`` tells whether
    that edit differs from the state before it; ``listed_at`` is the first edit since the last delete.
    """
    trimmed = trim_text(F.col("text"))
    edits = log.select("sym", "seq", trimmed.alias("text"))
    blank = F.col("text") == ""
    state = edits.groupBy("sym").agg(
        F.max_by("text", "seq").alias("text"),
        F.max("seq").alias("seq"),
        F.max(F.when(blank, F.col("seq"))).alias("__deleted"),
    )
    present = state.filter(F.col("text") != "")
    since = (
        edits.join(present.select("sym", "__deleted", F.col("seq").alias("__now")), "sym")
        .filter(F.col("__deleted").isNull() | (F.col("seq") > F.col("__deleted")))
        .groupBy("sym")
        .agg(
            F.min("seq").alias("listed_at"),
            F.max_by(
                "text", F.when(F.col("seq") < F.col("__now"), F.col("seq"))
            ).alias("__before"),
            F.count(F.lit(1)).alias("__n"),
        )
    )
    changed = (F.col("__n") == 1) | (F.col("__before") != F.col("text"))
    return present.select("sym", "text").join(
        since.select("sym", "listed_at", "__before", "__n"), "sym"
    ).select("sym", "text", changed.alias("changed"), "listed_at")


def edit_changes(log: DataFrame, split: bool | None = None) -> DataFrame:
    """For every edit, whether it changed anything: the state before it differs from the one after."""
    trimmed = trim_text(F.col("text"))
    rows = log.select("sym", "seq", F.nullif(trimmed, F.lit("")).alias("text"))
    before = scan(rows, ["sym"], ["seq"], {"__before": lag(F.col("text"))}, split)
    return before.select("sym", "seq", (~F.col("text").eqNullSafe(F.col("__before"))).alias("changed"))


def effective_names(symbols: DataFrame, user: DataFrame, auto: DataFrame) -> DataFrame:
    """symbols(sym, name) under user(sym, text), then auto(sym, alias), then their own name."""
    return (
        symbols.join(user.select("sym", F.col("text").alias("__user")), "sym", "left")
        .join(auto.select("sym", F.col("alias").alias("__auto")), "sym", "left")
        .withColumn("effective", F.coalesce("__user", "__auto", "name"))
        .drop("__user", "__auto")
    )


def override_union(base: DataFrame, override: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of both frames; where a key is in both, the override wins."""
    key = list(key)
    return override.unionByName(base.join(override.select(*key), key, "left_anti"))


def attach_comments(defs: DataFrame, comments: DataFrame) -> DataFrame:
    """Left join of at most one comment per symbol."""
    return defs.join(comments.select("sym", F.col("text").alias("comment")), "sym", "left")


# --- rename requests -------------------------------------------------------------------------


def _decide(requests: DataFrame, scope: list[str]) -> DataFrame:
    """(seq, sym, new_name, collided) of requests that influence each other."""
    keyed = cut(requests.withColumn("__scope", F.to_json(F.struct(*scope))))
    asked = keyed.select(
        "__scope", "seq", F.col("sym").cast("string").alias("sym"), "new_name", "effective", "held_new", "held_old"
    )
    small, large = split_by_size(asked, "__scope", NAMING_ROWS_KEY, NAMING_ROWS)
    seq = keyed.schema["seq"].dataType.simpleString()
    done = solve_groups(small, "__scope", _take_in_order, f"__scope string, seq {seq}, collided boolean")
    out = keyed.join(done, ["__scope", "seq"]).select("seq", "sym", "new_name", "collided")
    if large is None:
        return out
    rest = fresh(keyed).join(large, "__scope", "left_semi").drop("__scope")
    return out.unionByName(_accept(rest, scope))


def _take_in_order(scope, rows):
    holders: dict = {}
    present: dict = {}
    for _, seq, sym, wanted, start, held_new, held_old in sorted(rows, key=lambda r: r[1]):
        holders.setdefault(start, held_old)
        holders.setdefault(wanted, held_new)
        current = present.get(sym, start)
        taken = holders[wanted] - (current == wanted) > 0
        if not taken:
            holders[current] -= 1
            holders[wanted] += 1
            present[sym] = wanted
        yield scope, seq, taken


def _accept(requests: DataFrame, scope: list[str]) -> DataFrame:
    """``collided`` of requests(seq, sym, new_name, effective, held_new, held_old, <scope…>) taken in
    order of seq.

    Outcomes are assumed and worked out again until they agree: the present name of a symbol is its
    last accepted request, the holders of a name are a running sum of arrivals and departures.  An
    outcome only depends on earlier requests, so the fixpoint is what deciding one by one would give.
    """
    name = [*scope, "__name"]
    split = needs_split(requests, scope)
    given = cut(requests)
    # names that are held before the first request
    start = cut(
        given.select(*scope, F.col("new_name").alias("__name"), F.col("held_new").alias("__d"))
        .unionByName(given.select(*scope, F.col("effective").alias("__name"), F.col("held_old").alias("__d")))
        .distinct()
    )
    state = cut(given.withColumn("ok", F.col("held_new") == 0))
    while True:
        lined = scan(
            state, [*scope, "sym"], ["seq"],
            {"__now": last_value(F.when(F.col("ok"), F.col("new_name")), strict=True)}, split,
        ).withColumn("__now", F.coalesce("__now", "effective"))
        row = F.struct(*lined.columns)
        asks = lined.select(*scope, F.col("new_name").alias("__name"), "seq", F.lit(0).alias("__side"), F.lit(0).cast("long").alias("__d"), row.alias("__row"))
        moves = lined.filter(F.col("ok") & (F.col("__now") != F.col("new_name")))
        comes = moves.select(*scope, F.col("new_name").alias("__name"), "seq", F.lit(1).alias("__side"), F.lit(1).cast("long").alias("__d"))
        goes = moves.select(*scope, F.col("__now").alias("__name"), "seq", F.lit(1).alias("__side"), F.lit(-1).cast("long").alias("__d"))
        begin = fresh(start).select(*scope, "__name", F.lit(None).cast(given.schema["seq"].dataType).alias("seq"), F.lit(0).alias("__side"), "__d")
        events = asks.unionByName(comes.unionByName(goes).unionByName(begin), allowMissingColumns=True)
        summed = scan(events, name, ["seq", "__side"], {"__held": running_sum(F.col("__d"))}, split)
        others = F.col("__held") - (F.col("__row.__now") == F.col("__row.new_name")).cast("int")
        decided = summed.filter(F.col("__row").isNotNull())
        following = cut(
            decided.select(
                *[F.col("__row")[c].alias(c) for c in given.columns], F.col("__row.ok").alias("__was"), (others <= 0).alias("ok")
            )
        )
        steady = following.filter(F.col("ok") != F.col("__was")).isEmpty()
        state = fresh(following.drop("__was"))
        if steady:
            break
    return state.select("seq", "sym", "new_name", (~F.col("ok")).alias("collided"))


def check_renames(requests: DataFrame, symbols: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Outcome of each request(seq, sym, new_name), taken in order of seq within a scope.

    ``symbols(sym, <scope…>, effective, renamable)``.  applied, invalid (with the reason), collision
    (another symbol of the scope holds the name at that moment) or unrenamable.
    Requests that no other request of their scope can influence are decided by joins.  The rest is
    taken one by one inside tasks where the scope has a counted, bounded number of them, and by rounds
    over all scopes where it has more.
    """
    scope = list(scope)
    known = requests.join(symbols.select("sym", *scope, "effective", "renamable"), "sym", "left")
    judged = known.withColumn("reason", rename_error(F.col("new_name"))).withColumn(
        "outcome",
        F.when(F.col("reason").isNotNull(), "invalid").when(
            F.col("effective").isNull() | ~F.col("renamable"), "unrenamable"
        ),
    )
    settled = judged.filter(F.col("outcome").isNotNull()).select("seq", "sym", "new_name", "outcome", "reason")
    live = judged.filter(F.col("outcome").isNull()).drop("outcome", "reason", "renamable")

    held = symbols.groupBy(*scope, "effective").agg(F.count(F.lit(1)).alias("__n"))
    new_side = held.select(*scope, F.col("effective").alias("new_name"), F.col("__n").alias("__held_new"))
    old_side = held.select(*scope, "effective", F.col("__n").alias("__held_old"))
    # one name is touched by a request when it is asked for or may be given up
    touched = live.select(*scope, "sym", F.explode(F.array_distinct(F.array("new_name", "effective"))).alias("__t"))
    shared = (
        touched.groupBy(*scope, "__t")
        .agg((F.min("sym") != F.max("sym")).alias("__shared"))
        .filter("__shared")
        .select(*scope, "__t")
    )
    linked = touched.join(shared, [*scope, "__t"], "left_semi").select(*scope, "sym")
    again = live.groupBy(*scope, "sym").count().filter("count > 1").select(*scope, "sym")
    tied = linked.unionByName(again).distinct()
    counted = (
        live.join(new_side, [*scope, "new_name"], "left")
        .join(old_side, [*scope, "effective"], "left")
        .na.fill(0, ["__held_new", "__held_old"])
    )
    alone = counted.join(tied, [*scope, "sym"], "left_anti").withColumn(
        "collided", F.col("__held_new") > (F.col("effective") == F.col("new_name")).cast("int")
    )
    together = counted.join(tied, [*scope, "sym"], "left_semi").select(
        *scope, "seq", "sym", "new_name", "effective",
        F.col("__held_new").alias("held_new"), F.col("__held_old").alias("held_old"),
    )
    decided = alone.select("seq", "sym", "new_name", "collided")
    if not together.isEmpty():
        decided = decided.unionByName(_decide(together, scope))
    done = decided.select(
        "seq", "sym", "new_name",
        F.when(F.col("collided"), "collision").otherwise("applied").alias("outcome"),
        F.lit(None).cast("string").alias("reason"),
    )
    return settled.unionByName(done)


# --- class lists -----------------------------------------------------------------------------


def first_wins(classes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key in load order; each task keeps one row per key."""
    return first_row(classes, list(keys), list(order))


def duplicate_count(classes: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Rows that repeat a key, per group; counted per key first, so no set is built."""
    per_key = classes.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy(*by).agg((F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


def base_priority(archive: Column) -> Column:
    """0 for the surest base archive name, 4 for an obvious split."""
    leaf = F.lower(F.substring_index(archive, "/", -1))
    splitlike = F.contains(leaf, F.lit("split")) | F.contains(leaf, F.lit("config.")) | F.contains(
        leaf, F.lit(".config")
    )
    return (
        F.when(leaf == "base.apk", 0)
        .when(leaf == "base-master.apk", 1)
        .when(leaf.startswith("base-") | leaf.startswith("base.") | (leaf == "base"), 2)
        .when(~splitlike, 3)
        .otherwise(4)
    )


def pick_base(archives: DataFrame, bundle: str = "bundle", name: str = "archive") -> DataFrame:
    return archives.groupBy(bundle).agg(
        F.min_by(name, F.struct(base_priority(F.col(name)), F.col(name))).alias("base")
    )


def base_first(archives: DataFrame, bundle: str = "bundle", name: str = "archive") -> DataFrame:
    """Load order of a bundle: its base first, then the other archives by name."""
    marked = archives.join(pick_base(archives, bundle, name), bundle).withColumn(
        "__rest", (F.col(name) != F.col("base")).cast("int")
    )
    return scan(marked, [bundle], ["__rest", name], {"load_order": row_number()}).drop("__rest", "base")


def resolve_outer(classes: DataFrame, declared: DataFrame) -> DataFrame:
    """(cls, outer): the declared enclosing class, else the name before the last inner ``$``.

    An outer class that is not loaded, the class itself, or a link that would close a cycle is refused.  With an
    ``app_id`` on both sides, a class and its outer are of one app.
    """
    app = [APP] if has_app(classes, declared) else []
    last_dot = F.length("cls") - F.length(F.substring_index("cls", ".", -1))
    name = F.substring(F.col("cls"), last_dot + 1, F.length("cls"))
    before = F.regexp_extract(name, "^([\\s\\S]+)\\$[^$]+$", 1)
    derived = F.when(
        before != "", F.concat(F.substring(F.col("cls"), F.lit(1), last_dot), before)
    )
    keys = [*app, "cls"]
    wanted = classes.join(declared.select(*keys, F.col("outer").alias("__declared")), keys, "left")
    linked = wanted.withColumn("outer", F.coalesce("__declared", derived)).drop("__declared")
    loaded = classes.select(*app, F.col("cls").alias("outer")).distinct()
    links = linked.join(loaded, [*app, "outer"], "left_semi").filter(F.col("outer") != F.col("cls"))
    # the last link of a would-be cycle, in load order, is the one that is refused
    node = lambda name: F.struct(*app, F.col(name).alias("cls"))
    circular = on_cycle(links.select(node("cls").alias("node"), node("outer").alias("parent")))
    closing = (
        circular.join(links.select(node("cls").alias("node"), "ord"), "node")
        .groupBy("cycle")
        .agg(F.max_by("node", "ord").alias("last"))
        .select(*[F.col("last")[c].alias(c) for c in keys])
    )
    good = links.join(closing, keys, "left_anti").select(*keys, "outer")
    return classes.select(*keys).join(good, keys, "left")
