"""Tables about classes and units: members, roll-ups, package trees, data classes, token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.masks import ALL_KINDS, preferred_kind
from symloom.functions.names import CONSTRUCTOR, RESERVED_WORDS, STATIC_INIT, package_of, simple_name
from symloom.functions.signatures import (
    ABSTRACT,
    FINAL,
    STATIC,
    display_type,
    drop_synthetic,
    has_flag,
    modifiers,
)
from symloom.functions.text import ancestors, trim_text
from symloom.plans.apps import APP, has_app, packed, unpacked
from symloom.plans.ordered import row_number, scan

SECTIONS = {"field": 0, "method": 1, "class": 2}
_OBJECT, _STRING = "Ljava/lang/Object;", "Ljava/lang/String;"


def list_members(classes: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """(app_id, cls, section, ord, kind, name, signature, modifiers) without synthetic members.

    ``classes(app_id, cls, outer, flags, ord)``, ``fields(app_id, cls, name, type, flags, ord)``,
    ``methods(app_id, cls, name, params, ret, flags, ord)``; types are descriptors.
    """
    own = drop_synthetic(fields.withColumn("kind", F.lit("field"))).select(
        "app_id", "cls", F.lit(SECTIONS["field"]).alias("section"), "ord", "kind", "name",
        F.concat("name", F.lit(": "), display_type(F.col("type"))).alias("signature"),
        F.array_join(modifiers(F.col("flags"), "field"), " ").alias("modifiers"),
    )
    params = F.array_join(F.transform("params", display_type), ", ")
    called = simple_name(F.col("cls"))
    name = F.col("name")
    kept = drop_synthetic(methods.withColumn("kind", F.lit("method")))
    code = kept.select(
        "app_id", "cls", F.lit(SECTIONS["method"]).alias("section"), "ord",
        F.when(name == CONSTRUCTOR, "constructor").when(name == STATIC_INIT, "static_initializer")
        .otherwise("method").alias("kind"),
        F.when(name == CONSTRUCTOR, called).when(name == STATIC_INIT, "static").otherwise(name).alias("name"),
        F.when(name == CONSTRUCTOR, F.concat(called, F.lit("("), params, F.lit(")")))
        .when(name == STATIC_INIT, "static { … }")
        .otherwise(F.concat(name, F.lit("("), params, F.lit("): "), display_type(F.col("ret"))))
        .alias("signature"),
        F.array_join(modifiers(F.col("flags"), "method"), " ").alias("modifiers"),
    )
    nested = drop_synthetic(classes.filter(F.col("outer").isNotNull()).withColumn("kind", F.lit("class")))
    inner = simple_name(F.col("cls"))
    types = nested.select(
        "app_id", F.col("outer").alias("cls"), F.lit(SECTIONS["class"]).alias("section"), "ord",
        F.lit("nested_class").alias("kind"), inner.alias("name"), inner.alias("signature"),
        F.array_join(modifiers(F.col("flags"), "class"), " ").alias("modifiers"),
    )
    return own.unionByName(code).unionByName(types)


def _app_keys(*frames: DataFrame) -> list[str]:
    return [APP] if has_app(*frames) else []


def error_rollup(errors: DataFrame, tops: DataFrame) -> DataFrame:
    """(top, errors): errors(cls, errors) of a class and all nested in it, per top-level class (of its app, where both have one)."""
    app = _app_keys(errors, tops)
    return errors.join(tops.withColumnRenamed("node", "cls"), [*app, "cls"]).groupBy(*app, "top").agg(
        F.sum("errors").alias("errors")
    )


def fully_structured(methods: DataFrame, tops: DataFrame) -> DataFrame:
    """(top, ok): every method of the nested tree (of its app, where both have one) can be rendered."""
    app = _app_keys(methods, tops)
    return methods.join(tops.withColumnRenamed("node", "cls"), [*app, "cls"]).groupBy(*app, "top").agg(
        F.bool_and("ok").alias("ok")
    )


def explode_ancestors(df: DataFrame, path: str, separator: str = ".") -> DataFrame:
    """Adds one row per prefix of a path: (…, ancestor, depth)."""
    return df.select("*", F.posexplode(ancestors(F.col(path), separator)).alias("__i", "ancestor")).select(
        *df.columns, "ancestor", (F.col("__i") + 1).alias("depth")
    )


def package_tree(classes: DataFrame) -> DataFrame:
    """(app_id, parent, kind, label, id, n_children, kind_rank): direct children of each package of an app.

    Order children by (kind_rank, label): packages before classes, then by name.  Package paths are
    made distinct before their prefixes are expanded.
    """
    full = classes.select("app_id", "full").withColumn("pkg", package_of(F.col("full")))
    leaves = full.select(
        "app_id", F.col("pkg").alias("parent"), F.lit("class").alias("kind"),
        F.substring_index("full", ".", -1).alias("label"), F.col("full").alias("id"), F.lit(1).alias("kind_rank"),
    )
    paths = full.select("app_id", "pkg").distinct().filter(F.col("pkg") != "")
    packages = explode_ancestors(paths, "pkg").select("app_id", F.col("ancestor").alias("id")).distinct()
    folders = packages.select(
        "app_id", package_of(F.col("id")).alias("parent"), F.lit("package").alias("kind"),
        F.substring_index("id", ".", -1).alias("label"), "id", F.lit(0).alias("kind_rank"),
    )
    children = leaves.unionByName(folders)
    counts = children.groupBy("app_id", "parent").agg(F.count(F.lit(1)).alias("n_children"))
    sized = folders.join(counts.withColumnRenamed("parent", "id"), ["app_id", "id"], "left")
    return leaves.withColumn("n_children", F.lit(0).cast("long")).unionByName(
        sized.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    )


def infer_types(constraints: DataFrame, key: str = "value", mask: str = "mask") -> DataFrame:
    """(key, mask, chosen): all masks of a value met; the empty set is a conflict."""
    met = constraints.groupBy(key).agg(F.bit_and(mask).alias("mask"))
    return met.withColumn("chosen", preferred_kind(F.col("mask")))


def any_kind() -> Column:
    return F.lit(ALL_KINDS)


def data_classes(classes: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """(cls) that have the full shape of a data class.

    Final, not abstract, n >= 1 instance fields, one constructor that takes the field types in order,
    exactly component1..n returning them, equals, hashCode, toString and a matching copy.  Fields are
    numbered and compared position by position through joins; no list per class is built.  With an ``app_id`` in all
    three, a class has the members of its own app.
    """
    if has_app(classes, fields, methods):
        # the descriptor that copy returns is that of the bare name
        named = [df.withColumn("__name", F.col("cls")) for df in (classes, fields, methods)]
        return unpacked(_data_classes(*[packed(df, "cls") for df in named]), "cls")
    return _data_classes(*[df.withColumn("__name", F.col("cls")) for df in (classes, fields, methods)])


def _data_classes(classes: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    shape = classes.filter(
        has_flag(F.col("flags"), FINAL) & ~has_flag(F.col("flags"), ABSTRACT)
    ).select("cls")
    own = fields.filter(~has_flag(F.col("flags"), STATIC)).select("cls", "type", "ord")
    placed = scan(own, ["cls"], ["ord"], {"pos": row_number()}).select("cls", "pos", "type")
    arity = own.groupBy("cls").agg(F.count(F.lit(1)).alias("arity"))
    shape = shape.join(arity, "cls")

    name, params, ret = F.col("name"), F.col("params"), F.col("ret")
    no_args = F.size(params) == 0
    index = F.regexp_extract(name, "^component(0|[1-9][0-9]*)$", 1)
    component = no_args & (index != "")
    flags = methods.groupBy("cls").agg(
        F.count_if(name == CONSTRUCTOR).alias("n_init"),
        F.bool_or((name == "equals") & (ret == "Z") & (params == F.array(F.lit(_OBJECT)))).alias("eq"),
        F.bool_or((name == "hashCode") & no_args & (ret == "I")).alias("hash"),
        F.bool_or((name == "toString") & no_args & (ret == _STRING)).alias("text"),
    )
    shape = shape.join(flags, "cls").filter((F.col("n_init") == 1) & F.col("eq") & F.col("hash") & F.col("text"))

    # parts that must agree with the fields: constructor and copy by parameter, components by number
    descriptor = F.concat(F.lit("L"), F.translate("__name", ".", "/"), F.lit(";"))
    copies = (name == "copy") & (ret == descriptor)
    whole = methods.filter((name == CONSTRUCTOR) | copies).select("cls", "name", "params", "ord")
    sized = whole.join(arity, "cls").filter(F.size(params) == F.col("arity"))
    each = sized.select("cls", "name", "ord", "arity", F.posexplode("params").alias("i", "type"))
    agree = each.withColumn("pos", (F.col("i") + 1).cast("long")).join(placed, ["cls", "pos", "type"])
    good = agree.groupBy("cls", "name", "ord", "arity").agg(F.count(F.lit(1)).alias("n")).filter("n = arity")
    has_both = good.groupBy("cls").agg(F.count_distinct("name").alias("k")).filter("k = 2").select("cls")

    numbered = methods.filter(component).select("cls", index.try_cast("long").alias("pos"), F.col("ret").alias("type"))
    total = numbered.groupBy("cls").agg(F.count(F.lit(1)).alias("n_comp"))
    right = numbered.join(placed, ["cls", "pos", "type"]).groupBy("cls").agg(F.count_distinct("pos").alias("n_right"))
    parts = total.join(right, "cls").filter(F.col("n_comp") == F.col("n_right"))
    matched = shape.join(parts, "cls").filter(F.col("n_comp") == F.col("arity"))
    return matched.join(has_both, "cls", "left_semi").select("cls")


# Order matters: the first alternative that matches at a position decides the token's kind.
_TOKENS = (
    "//[^\\n]*"
    "|/\\*[\\s\\S]*?(?:\\*/|\\z)"
    "|\"[^\"\\\\\\n]*+(?:\\\\[\\s\\S][^\"\\\\\\n]*+)*+\"?"
    "|'[^'\\\\\\n]*+(?:\\\\[\\s\\S][^'\\\\\\n]*+)*+'?"
    "|@[\\p{L}_$][\\p{L}\\p{Nd}_$]*"
    "|\\.?\\p{Nd}(?:[\\p{L}\\p{Nd}_$.]++|(?<=[eE])[+-])*+"
    "|[\\p{L}_$][\\p{L}\\p{Nd}_$]*"
    "|[^ \\t\\r\\n]"
)


def token_profile(units: DataFrame) -> DataFrame:
    """(unit, kind, n): comments, strings, annotations, numbers, keywords, identifiers, punctuation."""
    tokens = units.select("unit", F.explode(F.regexp_extract_all("code", F.lit(_TOKENS), F.lit(0))).alias("t"))
    words = [w for w in RESERVED_WORDS if w != "_"]
    t = F.col("t")
    first, more = F.substring("t", 1, 1), F.length("t") > 1
    # the first sign tells the kind; beyond ASCII a pattern has to be asked
    wide = first > "~"
    digit = first.between("0", "9") | (wide & t.rlike("^\\p{Nd}"))
    letter = first.between("a", "z") | first.between("A", "Z") | first.isin("_", "$") | (wide & t.rlike("^\\p{L}"))
    kind = (
        F.when(letter, F.when(t.isin(*words), "keyword").otherwise("identifier"))
        .when(first.isin('"', "'"), "string")
        .when(digit | ((first == ".") & more), "number")
        .when((first == "/") & more, "comment")
        .when((first == "@") & more, "annotation")
        .otherwise("punctuation")
    )
    return tokens.groupBy("unit", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_ATTRIBUTE = "\\s*=\\s*\"([^\"]+)\""


def manifest_components(docs: DataFrame, text: str) -> DataFrame:
    """(…, package, launcher, application) from manifest text; what is missing is null.

    A launcher is an activity or alias followed by the launcher category.
    """
    body = F.col(text)

    def pick(pattern: str) -> Column:
        found = F.regexp_extract(body, pattern, 1)
        return F.when(trim_text(found) != "", found)

    package = pick("<manifest\\b[^>]*?package" + _ATTRIBUTE)
    launcher = pick(
        "<activity(?:-alias)?\\b[^>]*?android:name" + _ATTRIBUTE
        + "[\\s\\S]*?android\\.intent\\.category\\.LAUNCHER"
    )
    application = pick("<application\\b[^>]*?android:name" + _ATTRIBUTE)
    return docs.withColumn("package", package).select(
        "*",
        qualify(launcher, F.col("package")).alias("launcher"),
        qualify(application, F.col("package")).alias("application"),
    )


def qualify(name: Column, package: Column) -> Column:
    """``.Foo`` and ``Foo`` belong to the package; a dotted name stands for itself."""
    owner = F.coalesce(package, F.lit(""))
    return (
        F.when(name.startswith("."), F.concat(owner, name))
        .when(~F.contains(name, F.lit(".")) & (owner != ""), F.concat(owner, F.lit("."), name))
        .otherwise(name)
    )
