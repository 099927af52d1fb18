"""Differential scoring of a candidate against a reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.text import occurrences
from symloom.functions.verdicts import SIGNALS, VERDICTS, evidenced, improved, regressed, verdict

# Marker sentences that show a failed unit, and the indent unit of line checks.
ERROR_MARKERS = ["Code decompiled incorrectly", "Code restructure failed"]
INDENT = "    "


def pair_scores(reference: DataFrame, candidate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paired, excluded) from score tables (sample, category, failed, score).

    A sample the reference failed on is excluded and listed.  A sample without a usable candidate
    result is kept and scored as failing, its exec signal as not evaluated.
    """
    usable = reference.filter(~F.col("failed") & F.col("score").isNotNull())
    none = F.struct(
        F.lit(False).alias("no_error"), F.lit(False).alias("recompiles"), F.lit(None).cast("boolean").alias("exec")
    )
    cand = candidate.filter(~F.col("failed")).select("sample", F.col("score").alias("cand"))
    paired = usable.select("sample", "category", F.col("score").alias("ref")).join(cand, "sample", "left")
    excluded = reference.filter(F.col("failed") | F.col("score").isNull()).select("sample", "category")
    return paired.withColumn("cand", F.coalesce("cand", none)), excluded


def judge(paired: DataFrame) -> DataFrame:
    """paired(sample, category, ref, cand) with regressed, improved, verdict and evidenced."""
    ref, cand = F.col("ref"), F.col("cand")
    return paired.withColumns(
        {
            "regressed": regressed(ref, cand),
            "improved": improved(ref, cand),
            "verdict": verdict(ref, cand),
            "evidenced": evidenced(ref, cand),
        }
    )


def apply_allowlist(verdicts: DataFrame, allowlist: DataFrame) -> DataFrame:
    """A regression is expected only if its signals are exactly the documented set of the sample.

    ``allowlist(sample, signals)`` holds one row per sample.
    """
    entries = allowlist.select("sample", F.array_sort("signals").alias("__known"))
    joined = verdicts.join(entries, "sample", "left")
    expected = (F.col("verdict") == "REGRESSION") & (F.array_sort("regressed") == F.col("__known"))
    return joined.withColumn(
        "verdict", F.when(expected, "EXPECTED_DIVERGENCE").otherwise(F.col("verdict"))
    ).drop("__known")


def stale_entries(verdicts: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Allow-list rows whose sample was scored but no longer regresses on every listed signal."""
    return allowlist.join(verdicts.select("sample", "regressed"), "sample").filter(
        F.size(F.array_except("signals", "regressed")) > 0
    ).select("sample", "signals")


def scoreboard(verdicts: DataFrame) -> DataFrame:
    """Verdict counts per category, parity split by evidence."""
    is_parity = F.col("verdict") == "PARITY"
    parity = is_parity & F.col("evidenced")
    tied = is_parity & ~F.col("evidenced")
    return verdicts.groupBy(F.coalesce("category", F.lit("?")).alias("category")).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(parity).alias("evidenced_parity"),
        F.count_if(tied).alias("tied_parity"),
        *[
            F.count_if(F.col("verdict") == v).alias(v.lower())
            for v in VERDICTS if v != "PARITY"
        ],
    )


def verdict_table(verdicts: DataFrame) -> DataFrame:
    """The same counts as a pivot over the fixed verdict list."""
    return verdicts.groupBy("category").pivot("verdict", VERDICTS).count().na.fill(0)


def gate(verdicts: DataFrame) -> DataFrame:
    """One row: whether the run passes, and how many samples regressed."""
    lost = F.count_if(F.col("verdict") == "REGRESSION")
    return verdicts.agg((lost == 0).alias("passes"), lost.alias("regressions"))


def signal_pass_counts(paired: DataFrame, side: str = "ref") -> DataFrame:
    """(signal, passed, evaluated); a signal that was not evaluated is not in the denominator."""
    rows = paired.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(name).alias("signal"), F.col(side)[field].alias("v"))
                for field, name in SIGNALS.items()
            ])
        ).alias("s")
    )
    return rows.groupBy("s.signal").agg(
        F.count_if(F.col("s.v")).alias("passed"), F.count("s.v").alias("evaluated")
    )


def no_error_signal(units: DataFrame, markers: Sequence[str] = ERROR_MARKERS) -> DataFrame:
    """(sample, no_error) from units(sample, code, error_count): no reported error, at least one class,
    and no marker in any class text."""
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(F.col("code"), F.lit(m))
    present = F.col("code").isNotNull()
    return units.groupBy("sample").agg(
        (
            (F.sum(F.coalesce("error_count", F.lit(0))) == 0)
            & (F.count("code") > 0)
            & ~F.coalesce(F.bool_or(present & marked), F.lit(False))
        ).alias("no_error")
    )


def _times(code: Column, check: dict) -> Column:
    needles = check["needles"] if "needles" in check else [check["needle"]]
    total = F.lit(0)
    for n in needles:
        total = total + occurrences(code, INDENT * check.get("indent", 0) + n)
    return total


def check_assertions(units: DataFrame, checks: dict[str, dict]) -> DataFrame:
    """One boolean column per named check.

    A check is {needle, times} (None: at least once), with ``indent`` levels before a line, or
    {needles, times: 1} for exactly one of several.
    """
    code = F.col("code")
    return units.select(
        "unit",
        *[
            (_times(code, c) > 0 if c.get("times") is None else _times(code, c) == c["times"]).alias(name)
            for name, c in checks.items()
        ],
    )


def compile_tally(results: DataFrame) -> DataFrame:
    """One row of outcome counts from results(sample, status, flagged).

    ``status`` is clean, warnings, errors, no_output or unavailable.  Passing is clean or warnings;
    measured leaves out unavailable; evidenced leaves out passes the system itself flagged.
    """
    status = F.col("status")
    passing = status.isin("clean", "warnings")
    return results.agg(
        *[F.count_if(status == s).alias(s) for s in ("clean", "warnings", "errors", "no_output", "unavailable")],
        F.count_if(passing).alias("passed"),
        F.count_if(status != "unavailable").alias("measured"),
        F.count_if(passing & ~F.col("flagged")).alias("evidenced"),
    )
