"""Comparing two systems signal by signal.

A score is struct<no_error, recompiles, exec>; exec is null where it was not evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signal names as they appear in allow-lists and reports.
SIGNALS = {"no_error": "no-error", "recompiles": "recompiles", "exec": "exec-check"}
VERDICTS = ["EXPECTED_DIVERGENCE", "IMPROVEMENT", "PARITY", "REGRESSION"]


def _lost(better: Column, worse: Column) -> Column:
    # a null comparison is neither true nor false, so an unevaluated signal never counts
    return F.array_compact(
        F.array(*[F.when(better[f] & ~worse[f], name) for f, name in SIGNALS.items()])
    )


def regressed(ref: Column, cand: Column) -> Column:
    """Signals the reference passes and the candidate fails."""
    return _lost(ref, cand)


def improved(ref: Column, cand: Column) -> Column:
    return _lost(cand, ref)


def evidenced(ref: Column, cand: Column) -> Column:
    """True when at least one signal passes on both sides."""
    shared = F.lit(False)
    for f in SIGNALS:
        shared = shared | F.coalesce(ref[f] & cand[f], F.lit(False))
    return shared


def verdict(ref: Column, cand: Column) -> Column:
    """A regression on any signal outweighs every improvement."""
    return (
        F.when(F.size(regressed(ref, cand)) > 0, "REGRESSION")
        .when(F.size(improved(ref, cand)) > 0, "IMPROVEMENT")
        .otherwise("PARITY")
    )
