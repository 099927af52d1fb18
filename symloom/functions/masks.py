"""Sets of possible types held as bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One bit per kind, and the order in which an undecided set is resolved.
KIND_BITS = {
    "boolean": 1, "byte": 2, "short": 4, "char": 8, "int": 16, "long": 32,
    "float": 64, "double": 128, "void": 256, "object": 512, "array": 1024,
}
ALL_KINDS = sum(KIND_BITS.values())
PREFERENCE = ("int", "float", "long", "double", "boolean", "char", "short", "byte", "object", "array")


def mask_relation(a: Column, b: Column) -> Column:
    """equal, conflict (disjoint), narrower (a inside b), wider (b inside a) or unrelated."""
    both = a.bitwiseAND(b)
    return (
        F.when(a == b, "equal")
        .when(both == 0, "conflict")
        .when(both == a, "narrower")
        .when(both == b, "wider")
        .otherwise("unrelated")
    )


def preferred_kind(mask: Column) -> Column:
    """First kind of the preference order that the mask still allows; 'conflict' for the empty set."""
    chosen = F.lit("object")
    for kind in reversed(PREFERENCE):
        chosen = F.when(mask.bitwiseAND(KIND_BITS[kind]) != 0, kind).otherwise(chosen)
    return F.when(mask == 0, "conflict").otherwise(chosen)


def kinds_of_text(text: Column) -> Column:
    """Which kinds the text of a value allows."""
    whole = text.rlike("\\A-?[0-9]+\\z")
    number = F.when(whole, text.try_cast("long"))
    bits = KIND_BITS

    def within(low: int, high: int, kind: str) -> Column:
        return F.when(number.between(low, high), bits[kind]).otherwise(0)

    decimal = text.rlike("\\A-?[0-9]+(\\.[0-9]+)?\\z")
    return (
        within(-(2**7), 2**7 - 1, "byte")
        + within(-(2**15), 2**15 - 1, "short")
        + within(-(2**31), 2**31 - 1, "int")
        + F.when(number.isNotNull(), bits["long"]).otherwise(0)
        + F.when(decimal, bits["float"] + bits["double"]).otherwise(0)
        + F.when(text.isin("true", "false"), bits["boolean"]).otherwise(0)
        + F.when(F.length(text) == 1, bits["char"]).otherwise(0)
        + bits["object"]
    ).cast("int")
