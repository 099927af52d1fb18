"""Typed resource values and configuration qualifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Value types.
NULL, REFERENCE, ATTRIBUTE, STRING, FLOAT, DIMENSION, FRACTION = 0, 1, 2, 3, 4, 5, 6
DYNAMIC_REFERENCE, DYNAMIC_ATTRIBUTE = 7, 8
INT_DEC, INT_HEX, INT_BOOLEAN = 0x10, 0x11, 0x12
ARGB8, RGB8, ARGB4, RGB4 = 0x1C, 0x1D, 0x1E, 0x1F
# Units and radix shifts of packed numbers, density names.
DIMENSION_UNITS = ["px", "dp", "sp", "pt", "in", "mm"]
FRACTION_UNITS = ["%", "%p"]
RADIX_SHIFTS = [0, 7, 15, 23]
DENSITIES = {
    120: "ldpi", 160: "mdpi", 213: "tvdpi", 240: "hdpi", 320: "xhdpi",
    480: "xxhdpi", 640: "xxxhdpi", 0xFFFE: "anydpi", 0xFFFF: "nodpi",
}
ORIENTATIONS = {1: "port", 2: "land", 3: "square"}


def unsigned(value: Column) -> Column:
    return value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(unsigned(value)))


def _hex_padded(value: Column, mask: int, width: int) -> Column:
    return F.lpad(F.lower(F.hex(unsigned(value).bitwiseAND(F.lit(mask).cast("long")))), width, "0")


def number_text(value: Column) -> Column:
    """Whole numbers without a point, others to four decimals without trailing zeros.

    Numbers beyond 64 bits show the nearest long, infinite ones the nearest long in ten-thousandths;
    what is no number shows ``NaN``.
    """
    scaled = F.floor(F.abs(value) * 10000.0 + 0.5).cast("long")
    whole, part = F.floor(scaled / 10000).cast("long"), scaled % 10000
    digits = F.regexp_replace(F.lpad(part.cast("string"), 4, "0"), "0+$", "")
    body = F.concat(
        F.when((value < 0) & (scaled != 0), "-").otherwise(""),
        whole.cast("string"),
        F.when(part == 0, "").otherwise(F.concat(F.lit("."), digits)),
    )
    # floor ends at the range of long, and every finite double from 2^53 on is whole
    whole_number = (value == F.floor(value)) | ((F.abs(value) >= 2.0**53) & (F.abs(value) < float("inf")))
    return F.when(F.isnan(value), "NaN").when(whole_number, F.floor(value).cast("string")).otherwise(body)


def float_of_bits(bits: Column) -> Column:
    """The number a 32-bit float pattern stands for."""
    raw = unsigned(bits)
    exponent = F.shiftright(raw, 23).bitwiseAND(0xFF)
    mantissa = raw.bitwiseAND(0x7FFFFF).cast("double") / float(1 << 23)
    sign = F.when(F.shiftright(raw, 31).bitwiseAND(1) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    normal = F.pow(F.lit(2.0), exponent.cast("double") - 127.0) * (mantissa + 1.0)
    small = F.pow(F.lit(2.0), F.lit(-126.0)) * mantissa
    special = F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == 0xFF, special).when(exponent == 0, small).otherwise(normal)


def _packed(data: Column, fraction: bool) -> Column:
    mantissa = F.shiftright(unsigned(data), 8).cast("double")
    radix = F.shiftright(unsigned(data), 4).bitwiseAND(3).cast("int")
    scale = F.element_at(F.array(*[F.lit(2.0 ** -(8 + s)) for s in RADIX_SHIFTS]), radix + 1)
    unit = unsigned(data).bitwiseAND(0xF).cast("int")
    names = FRACTION_UNITS if fraction else DIMENSION_UNITS
    known = F.get(F.array(*[F.lit(n) for n in names]), unit)
    other = F.concat(F.lit("?f" if fraction else "?d"), F.lower(F.hex(unit)))
    value = mantissa * scale * (100.0 if fraction else 1.0)
    return F.concat(number_text(value), F.coalesce(known, other))


def format_value(vtype: Column, vdata: Column, string: Column, ref: Column) -> Column:
    """Text of one value; ``ref`` is the resolved ``type/name`` of vdata or null."""
    as_hex = F.concat(F.lit("0x"), hex_text(vdata))
    reference = (
        F.when(ref.startswith("id/"), F.concat(F.lit("@+"), ref))
        .when(ref.isNotNull(), F.concat(F.lit("@"), ref))
        .when(vdata == 0, "@null")
        .otherwise(F.concat(F.lit("@"), as_hex))
    )
    return (
        F.when(vtype == NULL, F.when(vdata == 1, "@empty").otherwise("@null"))
        .when(vtype.isin(REFERENCE, DYNAMIC_REFERENCE), reference)
        .when(vtype.isin(ATTRIBUTE, DYNAMIC_ATTRIBUTE), F.concat(F.lit("?"), F.coalesce(ref, as_hex)))
        .when(vtype == STRING, F.coalesce(string, F.lit("")))
        .when(vtype == FLOAT, number_text(float_of_bits(vdata)))
        .when(vtype == DIMENSION, _packed(vdata, False))
        .when(vtype == FRACTION, _packed(vdata, True))
        .when(vtype == INT_DEC, vdata.cast("string"))
        .when(vtype == INT_BOOLEAN, F.when(vdata != 0, "true").otherwise("false"))
        .when(vtype == ARGB8, F.concat(F.lit("#"), _hex_padded(vdata, 0xFFFFFFFF, 8)))
        .when(vtype == RGB8, F.concat(F.lit("#"), _hex_padded(vdata, 0xFFFFFF, 6)))
        .when(vtype == ARGB4, F.concat(F.lit("#"), _hex_padded(vdata, 0xFFFF, 4)))
        .when(vtype == RGB4, F.concat(F.lit("#"), _hex_padded(vdata, 0xFFF, 3)))
        .otherwise(as_hex)
    )


def _lookup(value: Column, table: dict[int, str], default: Column) -> Column:
    out = default
    for key, word in table.items():
        out = F.when(value == key, word).otherwise(out)
    return out


def config_qualifier(cfg: Column) -> Column:
    """``en-rUS-land-xhdpi-v21`` from struct<mcc, mnc, lang, region, orientation, density, sdk>."""
    none = F.lit(None).cast("string")
    lang = F.nullif(cfg["lang"], F.lit(""))
    density = cfg["density"]
    name = _lookup(density, DENSITIES, F.concat(density.cast("string"), F.lit("dpi")))
    return F.concat_ws(
        "-",
        F.when(cfg["mcc"] != 0, F.concat(F.lit("mcc"), cfg["mcc"].cast("string"))),
        F.when(cfg["mnc"] != 0, F.concat(F.lit("mnc"), cfg["mnc"].cast("string"))),
        lang,
        F.when(lang.isNotNull() & (cfg["region"] != ""), F.concat(F.lit("r"), cfg["region"])),
        _lookup(cfg["orientation"], ORIENTATIONS, none),
        F.when(density != 0, name),
        F.when(cfg["sdk"] != 0, F.concat(F.lit("v"), cfg["sdk"].cast("string"))),
    )
