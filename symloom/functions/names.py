"""Names of classes, packages and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that cannot be used as an identifier.
RESERVED_WORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double "
    "else enum extends final finally float for goto if implements import instanceof int interface "
    "long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while true false null "
    "var record yield sealed permits _"
).split()
RESERVED_SUFFIX = "Word"
LONGEST_OBFUSCATED = 2
CONSTRUCTOR = "<init>"
STATIC_INIT = "<clinit>"


def binary_name(desc: Column) -> Column:
    """``Lp/C;`` -> ``p.C``; anything not wrapped that way is returned as it is."""
    inner = F.translate(F.regexp_extract(desc, "^L([\\s\\S]+);$", 1), "/", ".")
    return F.when(desc.rlike("^L[\\s\\S]+;$"), inner).otherwise(desc)


def package_of(full: Column) -> Column:
    return F.regexp_extract(full, "^([\\s\\S]*)\\.", 1)


def simple_name(full: Column) -> Column:
    """Last segment; for a nested class only the innermost one."""
    return F.substring_index(F.substring_index(full, ".", -1), "$", -1)


def canonical_class(full: Column) -> Column:
    return F.translate(full, "$", ".")


def is_obfuscated(name: Column) -> Column:
    """One or two identifier characters."""
    return F.length(name).between(1, LONGEST_OBFUSCATED) & name.rlike("^[\\p{L}\\p{Nd}_$]+$")


def rename_error(name: Column) -> Column:
    """Why a requested name is refused, or null: empty, bad_start, bad_char or reserved."""
    return (
        F.when(F.length(name) == 0, "empty")
        .when(~name.rlike("^[A-Za-z_]"), "bad_start")
        .when(~name.rlike("\\A[A-Za-z0-9_]+\\z"), "bad_char")
        .when(name.isin(*RESERVED_WORDS), "reserved")
    )


def sanitize_identifier(name: Column) -> Column:
    """A legal identifier close to the given name."""
    legal = F.when(F.length(name) == 0, "_").otherwise(F.regexp_replace(name, "[^A-Za-z0-9_$]", "_"))
    started = F.when(legal.rlike("^[0-9]"), F.concat(F.lit("_"), legal)).otherwise(legal)
    return F.when(started.isin(*RESERVED_WORDS), F.concat(started, F.lit(RESERVED_SUFFIX))).otherwise(
        started
    )


def sanitize_qualified(name: Column) -> Column:
    """Sanitise every dot-separated segment; an empty name stays empty."""
    parts = F.transform(F.split(name, "\\."), sanitize_identifier)
    return F.when(F.length(name) == 0, name).otherwise(F.array_join(parts, "."))
