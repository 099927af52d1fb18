"""Method and type descriptors, access flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.names import simple_name

# Access-flag bits.
PUBLIC, PRIVATE, PROTECTED, STATIC, FINAL = 0x1, 0x2, 0x4, 0x8, 0x10
SYNCHRONIZED, VOLATILE, BRIDGE, TRANSIENT, NATIVE = 0x20, 0x40, 0x40, 0x80, 0x100
INTERFACE, ABSTRACT, SYNTHETIC, ANNOTATION, ENUM = 0x200, 0x400, 0x1000, 0x2000, 0x4000

COMMON_MODIFIERS = {
    "public": PUBLIC,
    "private": PRIVATE,
    "protected": PROTECTED,
    "static": STATIC,
    "final": FINAL,
    "abstract": ABSTRACT,
}
FIELD_MODIFIERS = {"volatile": VOLATILE, "transient": TRANSIENT}
METHOD_MODIFIERS = {"synchronized": SYNCHRONIZED, "native": NATIVE}

# One-letter primitive descriptors.
PRIMITIVES = {
    "V": "void", "Z": "boolean", "B": "byte", "S": "short", "C": "char",
    "I": "int", "J": "long", "F": "float", "D": "double",
}

_ONE_TYPE = "(\\[*(?:[VZBSCIJFD]|L[^;]+;))"


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def parse_signature(sig: Column) -> Column:
    """``(I[J)V`` -> struct<params, ret, slots>; long and double take two slots, arrays one."""
    params = F.regexp_extract_all(F.regexp_extract(sig, "^\\(([^)]*)\\)", 1), F.lit(_ONE_TYPE), F.lit(1))
    slots = F.aggregate(
        params, F.lit(0), lambda acc, p: acc + F.when(p.isin("J", "D"), 2).otherwise(1)
    )
    return F.struct(
        params.alias("params"),
        F.regexp_extract(sig, "\\)([\\s\\S]*)$", 1).alias("ret"),
        slots.alias("slots"),
    )


def array_dims(desc: Column) -> Column:
    return F.length(F.regexp_extract(desc, "^(\\[*)", 1))


def display_type(desc: Column) -> Column:
    """Short source form of a descriptor: ``[Ljava/lang/String;`` -> ``String[]``."""
    base = F.regexp_replace(desc, "^\\[+", "")
    primitive = F.lit(None).cast("string")
    for letter, word in PRIMITIVES.items():
        primitive = F.when(base == letter, word).otherwise(primitive)
    dotted = F.translate(F.regexp_extract(base, "^L(.+);$", 1), "/", ".")
    named = F.when(base.rlike("^L.+;$"), simple_name(dotted)).otherwise(simple_name(base))
    return F.concat(F.coalesce(primitive, named), F.repeat(F.lit("[]"), array_dims(desc)))


def class_kind(flags: Column) -> Column:
    return (
        F.when(has_flag(flags, ANNOTATION), "annotation")
        .when(has_flag(flags, ENUM), "enum")
        .when(has_flag(flags, INTERFACE), "interface")
        .otherwise("class")
    )


def modifiers(flags: Column, target: str) -> Column:
    """Modifier words in fixed order; target is 'class', 'field' or 'method'."""
    extra = {"class": {}, "field": FIELD_MODIFIERS, "method": METHOD_MODIFIERS}[target]
    words = {**COMMON_MODIFIERS, **extra}
    return F.array_compact(F.array(*[F.when(has_flag(flags, bit), word) for word, bit in words.items()]))


def is_synthetic(flags: Column, is_method: Column) -> Column:
    """Bit 0x40 means bridge on a method only; on a field it is volatile and must not drop it."""
    return has_flag(flags, SYNTHETIC) | (is_method & has_flag(flags, BRIDGE))


def drop_synthetic(members: DataFrame) -> DataFrame:
    """Keep the rows a person wrote.  Needs columns ``kind`` (field, method or class) and ``flags``."""
    return members.filter(~is_synthetic(F.col("flags"), F.col("kind") == "method"))
