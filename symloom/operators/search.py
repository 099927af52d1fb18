"""Search over code, members and class names, and the pages shown of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.names import package_of
from symloom.functions.text import LINE_BREAK, pattern_of, trim_text
from symloom.plans.apps import APP, has_app, packed, unpacked
from symloom.plans.ordered import running_sum, scan

# Result caps that callers may ask for, and page size.
CODE_CAP, MEMBER_CAP, PAGE_SIZE = 300, 500, 60
DEFAULT_PACKAGE = "(default package)"
INVALID_PATTERN = "INVALID_PARAMETER_VALUE.PATTERN"


def explode_lines(units: DataFrame) -> DataFrame:
    """(…, line, text, snippet): numbered from 1; the snippet is the trimmed line."""
    rest = [c for c in units.columns if c != "code"]
    rows = units.filter(F.col("code").isNotNull()).select(
        *rest, F.posexplode(F.split("code", LINE_BREAK)).alias("__i", "text")
    )
    return rows.select(
        *rest, (F.col("__i") + 1).alias("line"), "text",
        trim_text(F.col("text")).alias("snippet"),
    )


def valid_regex(df: DataFrame, pattern: str) -> bool:
    """Whether the pattern compiles; any other failure is raised."""
    try:
        df.sparkSession.range(1).select(F.regexp_count(F.lit("x"), F.lit(pattern))).first()
        return True
    except PySparkException as refused:
        if (refused.getCondition() or "") != INVALID_PATTERN:
            raise
        return False


def matcher(df: DataFrame, query: str, ignore_case: bool, regex: bool) -> str | None:
    """The pattern to look for, or None when the query matches nothing (blank or not a valid regex)."""
    if not query.strip():
        return None
    pattern = pattern_of(query, ignore_case, regex)
    return pattern if not regex or valid_regex(df, pattern) else None


def matching_lines(units: DataFrame, query: str, ignore_case: bool = True, regex: bool = False) -> DataFrame:
    """Every matching line, without a cap.  Units without a match are dropped before lines are cut."""
    pattern = matcher(units, query, ignore_case, regex)
    if pattern is None:
        return explode_lines(units.filter(F.lit(False)))
    if not regex:
        # a literal that is in no line is not in the text either; a regex may span lines
        units = units.filter(F.col("code").rlike(pattern))
    return explode_lines(units).filter(F.col("text").rlike(pattern))


def search_code(
    units: DataFrame, query: str, cap: int | None = None, ignore_case: bool = True, regex: bool = False
) -> DataFrame:
    """Matching lines of units(unit, ord, code): all, or the first ``cap`` by (ord, unit, line) in order.

    A cap is a distributed top-k, each task keeps at most ``cap`` rows.  Without one rows stay where they
    are found; they carry their order.
    """
    found = matching_lines(units.select("unit", "ord", "code"), query, ignore_case, regex)
    lines = found.select("unit", "ord", "line", "snippet")
    return lines if cap is None else lines.orderBy("ord", "unit", "line").limit(max(cap, 0))


def search_summary(
    units: DataFrame, query: str, cap: int | None = None, ignore_case: bool = True, regex: bool = False
) -> DataFrame:
    """One row (scanned, total, matches, failed, truncated) of what a scan reports.

    With a cap the scan stops in the unit that holds match number cap + 1.
    """
    sized = units.select("unit", "ord", "code")
    pattern = matcher(sized, query, ignore_case, regex)
    total = sized.agg(F.count(F.lit(1)).alias("total"))
    if pattern is None or (cap is not None and cap <= 0):
        return total.select(
            F.lit(0).cast("long").alias("scanned"), "total", F.lit(0).cast("long").alias("matches"),
            F.lit(0).cast("long").alias("failed"), F.lit(False).alias("truncated"),
        )
    found = matching_lines(sized, query, ignore_case, regex).select("ord", "unit", "line")
    if cap is None:
        units_read = sized.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("code").isNull()).alias("failed"))
        lines = found.agg(F.count(F.lit(1)).alias("n"))
        return units_read.select(
            "scanned", F.col("scanned").alias("total"), lines.scalar().alias("matches"), "failed",
            F.lit(False).alias("truncated"),
        )
    first = found.orderBy("ord", "unit", "line").limit(cap + 1)
    seen = first.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("ord", "unit")).alias("last")
    )
    count, last = seen.select("n").scalar(), seen.select("last").scalar()
    walked = sized.filter((count <= cap) | (F.struct("ord", "unit") <= last))
    parts = walked.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("code").isNull()).alias("failed")
    )
    return parts.select(
        "scanned", total.scalar().alias("total"), F.least(count, F.lit(cap)).cast("long").alias("matches"),
        "failed", (count > cap).alias("truncated"),
    )


def spans_of(units: DataFrame, pattern: str) -> DataFrame:
    """(unit, start, end, text) of every non-empty, non-overlapping match of a pattern.

    The text is cut at the matches; piece and match lengths are summed per unit.  A unit is one row, so
    its matches are what one task has held already.  With an ``app_id`` units are those of one app.
    """
    if has_app(units):
        return unpacked(spans_of(packed(units, "unit"), pattern), "unit")
    hits = units.filter(F.col("code").rlike(pattern)).select(
        "unit",
        F.split("code", pattern).alias("pieces"),
        F.regexp_extract_all("code", F.lit(pattern), F.lit(0)).alias("found"),
    )
    # an empty match at the very start cuts off no piece
    skipped = F.size("pieces") == F.size("found")
    aligned = hits.withColumn(
        "found", F.when(skipped, F.slice("found", F.lit(2), F.size("found"))).otherwise(F.col("found"))
    )
    pairs = aligned.select(
        "unit", F.posexplode(F.arrays_zip("pieces", "found")).alias("i", "z")
    ).select(
        "unit", "i", F.length("z.pieces").alias("gap"), F.length("z.found").alias("size"), F.col("z.found").alias("text")
    ).filter(F.col("size").isNotNull())
    placed = scan(pairs, ["unit"], ["i"], {"end": running_sum(F.col("gap") + F.col("size"))}, False)
    return placed.filter(F.col("size") > 0).select(
        "unit", (F.col("end") - F.col("size")).alias("start"), "end", "text"
    )


def match_spans(
    units: DataFrame, query: str, ignore_case: bool = True, regex: bool = False
) -> DataFrame:
    """(unit, start, end) of every non-overlapping match, with the app of the unit if it has one; empty matches are dropped."""
    app = [APP] if has_app(units) else []
    pattern = matcher(units, query, ignore_case, regex)
    if pattern is None:
        return units.select(*app, "unit", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")).limit(0)
    return spans_of(units, pattern).select(*app, "unit", "start", "end")


def search_members(
    members: DataFrame, query: str, kinds: Sequence[str], cap: int | None = None,
    ignore_case: bool = True, regex: bool = False,
) -> DataFrame:
    """Members(…, ord, kind, label, signature) whose label or signature matches: all, or the first
    ``cap`` by (ord, signature) in order."""
    pattern = matcher(members, query, ignore_case, regex)
    if pattern is None or not kinds:
        return members.limit(0)
    hit = F.col("label").rlike(pattern) | F.coalesce(F.col("signature"), F.lit("")).rlike(pattern)
    found = members.filter(F.col("kind").isin(*kinds) & hit)
    return found if cap is None else found.orderBy("ord", "signature").limit(max(cap, 0))


def search_classes(classes: DataFrame, query: str, ignore_case: bool = True, regex: bool = False) -> DataFrame:
    """(full, title, subtitle) of classes whose full or simple name matches, by full name."""
    pattern = matcher(classes, query.strip(), ignore_case, regex)
    simple = F.substring_index("full", ".", -1)
    shown = classes.select(
        "full", simple.alias("title"),
        F.when(F.contains(F.col("full"), F.lit(".")), package_of(F.col("full"))).otherwise(DEFAULT_PACKAGE).alias("subtitle"),
    )
    if pattern is None:
        return shown.limit(0)
    return shown.filter(F.col("full").rlike(pattern) | F.col("title").rlike(pattern)).orderBy("full")


def result_page(collected: Column, limit: Column, capped: Column) -> Column:
    """struct<shown, has_more, label> for a list of ``collected`` results of which ``limit`` are asked."""
    shown = F.least(F.greatest(collected, F.lit(0)), F.greatest(limit, F.lit(0)))
    label = F.concat(
        F.lit("showing "), shown.cast("string"), F.lit(" of "), collected.cast("string"),
        F.when(capped, "+").otherwise(""),
    )
    return F.struct(shown.alias("shown"), (shown < collected).alias("has_more"), label.alias("label"))
