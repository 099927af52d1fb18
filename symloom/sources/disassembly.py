"""Disassembly text to tables.

One file holds one class.  A file is cut into its header and method blocks inside its own row, so
owner and method of every line are known without a shuffle; only the numbering of lines within a
method is an ordered scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.functions.names import binary_name
from symloom.functions.signatures import parse_signature
from symloom.operators.positions import live_ranges
from symloom.plans.fixpoint import fresh
from symloom.plans.ordered import running_sum, scan
from symloom.session import cut, spread

# Access words of the text form and the bits they stand for.
ACCESS = {
    "public": 0x1, "private": 0x2, "protected": 0x4, "static": 0x8, "final": 0x10,
    "synchronized": 0x20, "volatile": 0x40, "bridge": 0x40, "transient": 0x80, "varargs": 0x80,
    "native": 0x100, "interface": 0x200, "abstract": 0x400, "strictfp": 0x800,
    "synthetic": 0x1000, "annotation": 0x2000, "enum": 0x4000, "constructor": 0x10000,
    "declared-synchronized": 0x20000,
}

_STRING = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_CHAR = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
#: up to the comment of a line; the stub of a method that could not be printed is none
_COMMENT = rf"(?md)^(?![ \t]*# <error rendering method: )((?:[^\"'#\n]++|{_STRING}|{_CHAR})*+)#.*$"
_METHOD = r"(?smd)^[ \t]*\.method\b.*?(?:^[ \t]*\.end method\b[^\n]*|(?=^[ \t]*\.method\b)|\z)"
_ANNOTATION = r"(?smd)^[ \t]*\.annotation\b.*?^[ \t]*\.end annotation\b[^\n]*"
_PAYLOAD = "(?s)\\.(packed-switch|sparse-switch|array-data)\\b.*?\\.end \\1"
_TABLE = "(?s):\\w+\\s*\\n\\s*\\.(packed-switch|sparse-switch)\\b.*?\\.end \\1"


def _with_end(opens: str, end: str, others: str) -> str:
    """A directive with the lines up to its end, or its line alone where another directive comes before an end."""
    lines = rf"(?:\n(?![ \t]*\.(?:{others})\b)[^\n]*)*+"
    return rf"(?md)^[ \t]*\.(?:{opens})\b[^\n]*(?:{lines}\n[ \t]*\.end (?:{end})\b[^\n]*)?"


_FIELD = _with_end("field", "field", "field|end field|method|class|super|source|implements")
_PARAM = _with_end(
    "param|parameter", "param|parameter",
    "param|parameter|end param|end parameter|line|locals|registers|local|end local|restart|prologue|source|catch|catchall|end method",
)


class Tables(Mapping):
    """Tables by name; those that ``code`` makes share rows that are written when the first of them is asked for."""

    def __init__(self, plain: dict[str, DataFrame], names: tuple[str, ...], code: Callable[[], dict[str, DataFrame]]) -> None:
        self._tables, self._names, self._code = plain, [*plain, *names], code

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._names and name not in self._tables:
            self._tables = self._tables | self._code()
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def access_flags(words: Column) -> Column:
    listed = F.split(words, " +")
    bits = F.lit(0)
    for word, bit in ACCESS.items():
        bits = bits.bitwiseOR(F.when(F.array_contains(listed, word), bit).otherwise(0))
    return bits


def read_disassembly(spark: SparkSession, path: str, app_id: str = "app") -> Mapping[str, DataFrame]:
    """Tables of all ``.smali`` files under a path."""
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.smali")
        .text(path, wholetext=True)
        .select(
            F.lit(app_id).alias("app_id"), F.col("_metadata.file_path").alias("input_file"),
            F.col("value").alias("text"),
        )
    )
    return parse_disassembly(files)


def _quoted(pattern: str) -> str:
    """The inside of a string literal, as a group."""
    return pattern.replace("<name>", r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"')


def _found(column: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def parse_disassembly(files: DataFrame) -> Mapping[str, DataFrame]:
    """``files(app_id, input_file, text)`` -> class, field, method, insn, label, try_range, switch, line, local_var, annotation
    and annotation_token tables.

    A ``method_key`` begins with its app, so it is unique in the whole corpus.  Line ends, tabs and comments are
    as free as in the text form itself; ``.locals`` counts without the parameters, ``.registers`` with them.  Strings stay as they are
    spelled.  An annotation belongs to the field or parameter before it only if that has an end line of its own.  A null or empty text, and
    one without a class line, gives a class row with null ``cls``.  Variables have ranges only in methods with code.

    Texts take far longer to parse than to read, so they are dealt evenly to all tasks first, however few files or row groups
    they come from.
    """
    text = F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), _COMMENT, "$1")
    blocked = spread(files.select("app_id", "input_file", "text")).select("app_id", "input_file", text.alias("text")).select(
        "app_id", "input_file", F.regexp_extract_all("text", F.lit(_METHOD), F.lit(0)).alias("blocks"),
        F.regexp_replace("text", _METHOD, "").alias("top"),
    )
    declared = F.btrim(F.regexp_extract("top", r"(?md)^[ \t]*\.class\b(.*)$", 1), F.lit(" \t"))
    desc = F.nullif(F.substring_index(declared, " ", -1), F.lit(""))
    owned = blocked.select(
        "app_id", "input_file", "blocks", "top", F.regexp_replace("top", _FIELD, "").alias("head"),
        binary_name(desc).alias("cls"), desc.alias("desc"), access_flags(declared).alias("flags"),
    )
    supers = _found("head", r"(?md)^[ \t]*\.super\s+(\S+)")
    classes = owned.select(
        "app_id", "cls", "flags", binary_name(supers).alias("super"),
        F.transform(
            F.regexp_extract_all("head", F.lit(r"(?md)^[ \t]*\.implements\s+(\S+)"), F.lit(1)), binary_name
        ).alias("interfaces"),
        _found("head", _quoted(r"(?md)^[ \t]*\.source\s+<name>")).alias("source_file"),
        "input_file",
    )

    field_blocks = owned.select(
        "app_id", "cls", F.posexplode(F.regexp_extract_all("top", F.lit(_FIELD), F.lit(0))).alias("ord", "block")
    ).withColumn("line", F.btrim(F.regexp_extract("block", r"^\s*\.field\b([^\n]*)", 1), F.lit(" \t")))
    spec = F.regexp_replace("line", r"\s=\s.*$", "")
    named = F.regexp_extract(F.rtrim(spec), r"(\S+)$", 1)
    placed_fields = field_blocks.select(
        "app_id", "cls",
        F.regexp_extract(named, "^(.*):([^:]+)$", 1).alias("name"),
        F.regexp_extract(named, "^(.*):([^:]+)$", 2).alias("type"),
        access_flags(spec).alias("flags"),
        _found("line", r"\s=\s+(.*)$").alias("const"),
        "ord", F.concat("app_id", F.lit("/"), "cls", F.lit("->"), named).alias("field_key"), "block",
    )
    fields = placed_fields.drop("field_key", "block")

    blocks = owned.select("app_id", "cls", "desc", F.posexplode("blocks").alias("ord", "block"))
    signed = F.btrim(F.regexp_extract("block", r"^\s*\.method\b([^\n]*)", 1), F.lit(" \t"))
    shown = F.substring_index(signed, " ", -1)
    sig = parse_signature(F.concat(F.lit("("), F.substring_index(shown, "(", -1)))
    static = access_flags(signed).bitwiseAND(ACCESS["static"]) != 0
    counted_in = F.regexp_extract("block", r"(?md)^[ \t]*\.registers\s+(\d+)", 1).try_cast("int")
    without = F.regexp_extract("block", r"(?md)^[ \t]*\.locals\s+(\d+)", 1).try_cast("int")
    own = F.when(static, 0).otherwise(1)
    failure = _found("block", r"(?md)^[ \t]*# <error rendering method: (.*)>")
    bare = F.regexp_replace(F.regexp_replace("block", _ANNOTATION, ""), _PAYLOAD, "")
    parsed = blocks.select(
        "app_id", "cls", "ord",
        F.substring_index(shown, "(", 1).alias("name"), sig.alias("sig"),
        access_flags(signed).alias("flags"),
        F.coalesce(counted_in, without + sig["slots"] + own).alias("registers"),
        failure.alias("error"),
        F.concat("app_id", F.lit("/"), "cls", F.lit("->"), shown).alias("method_key"),
        "block", bare.alias("body"), "desc",
        bare.rlike(r"(?md)^[ \t]*\.catch").alias("has_handlers"),
    )
    methods = parsed.select(
        "app_id", "method_key", "cls", "name", F.col("sig.params").alias("params"), F.col("sig.ret").alias("ret"),
        "flags", "registers", F.col("registers").isNotNull().alias("has_code"), "has_handlers", "error", "ord",
    )

    tokens = _tokens(_annotations(owned, placed_fields, parsed))
    plain = {"class": classes, "field": fields, "method": methods, "annotation": _values(tokens), "annotation_token": tokens}
    return Tables(plain, ("insn", "label", "try_range", "switch", "line", "local_var"), lambda: _code_tables(parsed))


def _code_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The tables made from the lines of method bodies, which are parsed and numbered once."""
    # parameter registers follow the locals; an instance method has one more for its receiver
    own = F.when(F.col("flags").bitwiseAND(ACCESS["static"]) == 0, 1).otherwise(0)
    first_param = F.col("registers") - F.col("sig.slots") - own
    # the type each parameter register opens with: the receiver, then one or two slots a parameter
    receiver = F.when(own == 1, F.array("desc")).otherwise(F.array().cast("array<string>"))
    wide = lambda p: F.when(p.isin("J", "D"), F.array(p, F.lit(None).cast("string"))).otherwise(F.array(p))
    opened = F.concat(receiver, F.flatten(F.transform("sig.params", wide)))
    lines = parsed.select(
        "app_id", "method_key", first_param.alias("first_param"), opened.alias("opened"),
        F.posexplode(F.split("body", "\n")).alias("pos", "raw"),
    ).select("app_id", "method_key", "first_param", "opened", "pos", F.btrim("raw", F.lit(" \t")).alias("line"))
    is_insn = F.col("line").rlike("^[a-z]")
    kept = lines.filter(is_insn | F.col("line").rlike("^(:|\\.(catch|line|local|end local|restart|param))"))
    # the lines of a method come from one cell, so a group is what one task has held already
    counted = cut(
        scan(
            kept, ["app_id", "method_key"], ["pos"], {"seen": running_sum(is_insn.cast("int"))}, False
        ).withColumn("seen", F.col("seen").cast("int"))
    )

    labels = counted.filter(F.col("line").startswith(":")).select(
        "app_id", "method_key", F.substring_index("line", " ", 1).alias("label"), F.col("seen").alias("off")
    )
    operands = F.regexp_extract("line", "^\\S+\\s+(.*)$", 1)
    register = "(?<![\\w$/;])([vp]\\d+)(?![\\w$/;])"
    span = F.regexp_extract_all("ops", F.lit("\\{([vp]\\d+) \\.\\. ([vp]\\d+)\\}"), F.lit(1))
    insns = counted.filter(is_insn).select(
        "app_id", "method_key", "first_param", (F.col("seen") - 1).alias("off"),
        F.regexp_extract("line", "^(\\S+)", 1).alias("op"), operands.alias("ops"),
    )
    plain = F.regexp_replace("ops", "\"[^\"\\\\]*+(?:\\\\.[^\"\\\\]*+)*+\"", "")

    def number(r: Column) -> Column:
        n = F.substring(r, F.lit(2), F.length(r)).try_cast("int")
        return F.when(r.startswith("p"), F.col("first_param") + n).otherwise(n)

    listed = F.transform(F.regexp_extract_all(plain, F.lit(register), F.lit(1)), number)
    ranged = F.sequence(listed[0], listed[1])
    # the call type of a polymorphic call comes after its method
    reference = F.regexp_extract(F.regexp_replace(plain, r",\s*\([^\s,]*\)\S+$", ""), "((?:\\[*L[^;]+;|\\[+[ZBSCIJFD])(?:->\\S+)?)$", 1)
    text_const = F.regexp_extract("ops", "(\"[^\"\\\\]*+(?:\\\\.[^\"\\\\]*+)*+\")$", 1)
    full = insns.select(
        "app_id", "method_key", "off", "op",
        F.when((F.size(span) > 0) & (F.size(listed) >= 2), ranged).otherwise(listed).alias("regs"),
        literal_value(F.col("op"), F.col("ops")).alias("literal"),
        F.nullif(F.regexp_extract(plain, "(:\\w+)$", 1), F.lit("")).alias("label"),
        F.coalesce(F.nullif(reference, F.lit("")), F.nullif(text_const, F.lit(""))).alias("ref"),
    )
    key = ["app_id", "method_key", "label"]
    targeted = full.join(labels.withColumnRenamed("off", "target"), key, "left").drop("label")

    catches = counted.filter(F.col("line").startswith(".catch")).select(
        "app_id", "method_key",
        F.nullif(F.regexp_extract("line", "^\\.catch (\\S+) ", 1), F.lit("")).alias("type"),
        F.regexp_extract("line", "\\{(:\\w+) \\.\\.", 1).alias("l_start"),
        F.regexp_extract("line", "\\.\\. (:\\w+)\\}", 1).alias("l_end"),
        F.regexp_extract("line", "\\} (:\\w+)", 1).alias("l_handler"),
        "pos",
    )

    def at(side: str) -> DataFrame:
        return labels.select("app_id", "method_key", F.col("label").alias(f"l_{side}"), F.col("off").alias(side))

    placed = catches
    for side in ("start", "end", "handler"):
        placed = placed.join(at(side), ["app_id", "method_key", f"l_{side}"], "left")
    # handlers of a range stand in one method's text, so a list is no longer than that text
    handler = F.struct(
        "pos", F.when(F.col("type").isNotNull(), binary_name(F.col("type"))).alias("type"), F.col("handler").alias("off")
    )
    ranges = (
        placed.groupBy("app_id", "method_key", F.col("start").alias("start_off"), (F.col("end") - 1).alias("end_off"))
        .agg(F.array_sort(F.collect_list(handler)).alias("h"))
        .select(
            "app_id", "method_key", "start_off", "end_off",
            F.transform("h", lambda x: F.struct(x["type"].alias("type"), x["off"].alias("off"))).alias("handlers"),
        )
    )

    # switch tables: the label in front names the table, the labels inside are the cases
    tables = F.regexp_extract_all("block", F.lit(_TABLE), F.lit(0))
    cases = (
        blocks_of(parsed).select("app_id", "method_key", F.explode(tables).alias("table"))
        .select(
            "app_id", "method_key", F.regexp_extract("table", "^(:\\w+)", 1).alias("label"),
            F.explode(F.regexp_extract_all("table", F.lit("\\n\\s+(?:-?0x[0-9a-fA-F]+ -> )?(:\\w+)"), F.lit(1))).alias("case"),
        )
        .join(labels.select("app_id", "method_key", F.col("label").alias("case"), F.col("off").alias("target")),
              ["app_id", "method_key", "case"])
    )
    switches = full.filter(F.col("op").endswith("-switch")).select(*key, "off").join(cases, key).select(
        "app_id", "method_key", "off", "target"
    )
    size = counted.groupBy("method_key").agg(F.max("seen").alias("code_size"))
    return {
        "insn": targeted, "label": labels, "try_range": ranges, "switch": switches,
        "line": _lines(counted, size), "local_var": live_ranges(_debug_events(counted, number), size),
    }


def blocks_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("app_id", "method_key", "block").filter(F.contains(F.col("block"), F.lit("-switch")))


def literal_value(op: Column, ops: Column) -> Column:
    """The number an instruction ends with: hexadecimal or decimal with any suffix, a truth value or a character.

    Hexadecimal digits are bits: ``0xffffffff`` is -1 to an instruction that is not wide.  A fraction has no value here.
    """
    last = F.regexp_extract(ops, r"(?:^|[,\s])([^,\s]+)$", 1)
    negative = last.startswith("-")
    digits = F.regexp_extract(last, r"^-?0[xX]([0-9a-fA-F]{1,16})[lLsStT]?$", 1)
    bits = F.conv(digits, 16, -10).cast("long")
    narrow = ~F.contains(op, F.lit("wide")) & ~F.lower(last).endswith("l")
    bits = F.when(narrow & bits.between(1 << 31, (1 << 32) - 1), bits - (1 << 32)).otherwise(bits)
    decimal = F.regexp_extract(last, r"^(-?\d+)[lLsStT]?$", 1).try_cast("long")
    char = F.regexp_extract(ops, r"(?:^|[,\s])'((?:[^'\\]|\\.[0-9a-fA-F]*))'$", 1)
    escaped = F.regexp_extract(char, r"^\\u([0-9a-fA-F]{4})$", 1)
    code = F.when(escaped != "", F.conv(escaped, 16, 10).cast("long"))
    for sign, number in {"\\n": 10, "\\t": 9, "\\r": 13, "\\'": 39, '\\"': 34, "\\\\": 92}.items():
        code = F.when(char == sign, F.lit(number).cast("long")).otherwise(code)
    code = F.coalesce(code, F.when(F.length(char) == 1, F.ascii(char).cast("long")))
    truth = F.when(last == "true", 1).when(last == "false", 0).cast("long")
    return (
        F.when(digits != "", F.when(negative & (bits != -(1 << 63)), -bits).otherwise(bits))
        .when(char != "", code)
        .otherwise(F.coalesce(decimal, F.when(op.startswith("const"), truth)))
    )


def _lines(counted: DataFrame, size: DataFrame) -> DataFrame:
    """(app_id, method_key, off, line): the source line from an instruction on; of several the last one counts."""
    said = F.regexp_extract("line", r"^\.line\s+(\S+)", 1)
    number = F.when(said.startswith("0x"), F.conv(F.substring(said, 3, 16), 16, 10)).otherwise(said).try_cast("int")
    rows = counted.filter(F.col("line").startswith(".line")).select("app_id", "method_key", "seen", "pos", number.alias("line"))
    return (
        rows.join(size, "method_key").withColumn("off", F.least("seen", F.col("code_size") - 1))
        .groupBy("app_id", "method_key", "off").agg(F.max_by("line", "pos").alias("line"))
    )


def _debug_events(counted: DataFrame, number) -> DataFrame:
    """Openings and ends of variables, in the shape that ``positions.live_ranges`` reads."""
    line = F.col("line")
    action = (
        F.when(line.startswith(".param"), "param").when(line.startswith(".local"), "start")
        .when(line.startswith(".restart"), "restart").when(line.startswith(".end local"), "end")
    )
    register = F.regexp_extract(line, r"^\.(?:end )?\w+(?: local)?\s+([vp]\d+)", 1)
    slot = F.substring(register, F.lit(2), F.length(register)).try_cast("int")
    name = _found(line, _quoted(r"^\.\w+\s+\w+\s*,\s*<name>"))
    declared = _found(line, r'^\.local\s+\w+\s*,\s*(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|null):([^,\s]+)')
    signature = _found(line, _quoted(r'^\.local\s+\w+\s*,\s*(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|null):[^,\s]+\s*,\s*<name>'))
    rows = counted.filter(action.isNotNull() & (line != ".locals") & ~line.rlike(r"^\.locals\b") & (register != ""))
    return rows.select(
        "app_id", "method_key", number(register).alias("reg"), F.col("pos").alias("seq"), F.col("seen").alias("addr"), action.alias("action"),
        name.alias("name"), F.when(action == "param", F.get("opened", slot)).otherwise(declared).alias("type"), signature.alias("signature"),
    ).filter(F.col("reg").isNotNull() & ~((F.col("action") == "param") & F.col("name").isNull()))


_OWNER = ["app_id", "owner_kind", "owner_key", "param", "ord"]
_TOKEN = rf'{_STRING}|{_CHAR}|\.end subannotation|\.[a-z]+[ \t]+[^\s{{}},]+|[{{}},=]|[^\s{{}},="\']++'


def _annotations(classes: DataFrame, fields: DataFrame, parsed: DataFrame) -> DataFrame:
    """Every annotation with its owner: a class, field, method, or a parameter (its register) of a method."""
    listed = lambda column: F.posexplode(F.regexp_extract_all(column, F.lit(_ANNOTATION), F.lit(0))).alias("ord", "text")
    none = F.lit(None).cast("string")
    own = lambda kind, key, param=none: ["app_id", F.lit(kind).alias("owner_kind"), key.alias("owner_key"), param.alias("param")]
    params = parsed.select(
        "app_id", "method_key", F.explode(F.regexp_extract_all("block", F.lit(_PARAM), F.lit(0))).alias("block")
    ).withColumn("param", F.regexp_extract("block", r"^\s*\.param(?:eter)?\s+(\w+)", 1))
    return (
        classes.select(*own("class", F.concat("app_id", F.lit("/"), "cls")), listed("head"))
        .unionByName(fields.select(*own("field", F.col("field_key")), listed("block")))
        .unionByName(parsed.select(*own("method", F.col("method_key")), listed(F.regexp_replace("block", _PARAM, ""))))
        .unionByName(params.select(*own("param", F.col("method_key"), F.col("param")), listed("block")))
    )


def _tokens(annotations: DataFrame) -> DataFrame:
    """The values of every annotation, one row each, with their place in the nest of blocks.

    Depth is a running sum over the tokens of one annotation.  A block takes part in its own level as a value and opens the level
    inside it, so the last opening at a token's level is the block it stands in, whatever the depth.  ``pos`` and ``parent`` are token
    numbers, ``top`` that of the element of the annotation itself; ``part`` is a name or, in a list, an index.
    """
    opens = F.regexp_extract("text", r"^\s*\.annotation\s+(\w+)\s+(\S+)", 0)
    inside = F.regexp_replace(F.substring(F.col("text"), F.length(opens) + 1, F.length("text")), r"\n[ \t]*\.end annotation\b[^\n]*$", "")
    rows = annotations.select(
        *_OWNER, F.regexp_extract(opens, r"\.annotation\s+(\w+)\s+(\S+)", 1).alias("visibility"),
        F.regexp_extract(opens, r"\.annotation\s+(\w+)\s+(\S+)", 2).alias("type"),
        F.posexplode_outer(F.regexp_extract_all(inside, F.lit(_TOKEN), F.lit(0))).alias("pos", "token"),
    )
    token = F.col("token")
    begins = (token == "{") | token.startswith(".subannotation")
    ends = (token == "}") | (token == ".end subannotation")
    # the tokens of an annotation come from one cell, so a group is what one task has held already
    whole = Window.partitionBy(*_OWNER).orderBy("pos")
    step = begins.cast("int") - ends.cast("int")
    depth = F.sum(step).over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - step
    named = (F.lag("token").over(whole) == "=") & F.lag("token", 2).over(whole).isNotNull()
    marked = rows.withColumns({
        "begins": begins, "level": depth, "comma": token == ",",
        "name": F.when(named, F.lag("token", 2).over(whole)),
        "is_value": ~ends & ~token.isin(",", "=") & (F.coalesce(F.lead("token").over(whole), F.lit("")) != "="),
    })
    places = F.array(F.struct(F.col("level").alias("at"), F.lit(False).alias("into")), F.struct((F.col("level") + 1).alias("at"), F.lit(True).alias("into")))
    placed = marked.filter(token.isNull() | F.col("is_value") | F.col("comma")).withColumn(
        "place", F.explode(F.when(F.col("begins"), places).otherwise(F.slice(places, 1, 1)))
    ).select("*", F.col("place.at").alias("at"), F.col("place.into").alias("into")).drop("place")
    level = Window.partitionBy(*_OWNER, "at").orderBy("pos", "into").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    commas = F.sum(F.col("comma").cast("int")).over(level)
    numbered = placed.withColumn("commas", commas).withColumns({
        "parent": F.last(F.when(F.col("into"), F.col("pos")), ignorenulls=True).over(level),
        "before": F.last(F.when(F.col("into"), F.col("commas")), ignorenulls=True).over(level),
    })
    values = numbered.filter(token.isNull() | (~F.col("into") & F.col("is_value")))
    elements = Window.partitionBy(*_OWNER).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind, value = _kind_and_value(token)
    return values.select(
        *_OWNER, "type", "visibility", "pos", "parent", F.col("at").alias("level"),
        F.last(F.when(F.col("at") == 0, F.col("pos")), ignorenulls=True).over(elements).alias("top"),
        F.coalesce("name", (F.col("commas") - F.coalesce("before", F.lit(0))).cast("string")).alias("part"),
        F.col("name").isNotNull().alias("named"), kind.alias("kind"), value.alias("value"),
    )


def _kind_and_value(token: Column) -> tuple[Column, Column]:
    inside = F.substring(token, F.lit(2), F.length(token) - 2)
    argument = F.regexp_extract(token, r"^\.\w+\s+(\S+)", 1)
    kind = (
        F.when(token.startswith('"'), "string").when(token.startswith("'"), "char").when(token == "{", "array")
        .when(token.startswith(".subannotation"), "annotation").when(token.startswith(".enum"), "enum")
        .when(token == "null", "null").when(token.isin("true", "false"), "boolean")
        .when(token.rlike(r"->[^(]*\("), "method").when(F.contains(token, F.lit("->")), "field")
        .when(token.startswith("("), "signature").when(token.rlike(r"^\[*(?:L[^;]*;|[VZBSCIJFD])$"), "type").otherwise("number")
    )
    value = F.when(token.rlike("^[\"']"), inside).when(token.startswith("."), argument).when(~token.isin("{", "null"), token)
    return F.when(token.isNotNull(), kind), value


def _values(tokens: DataFrame) -> DataFrame:
    """One row per annotation; ``values`` maps each element to its kind and value.

    Of an array or a nested annotation the value lists what is inside, at any depth, with commas between;
    ``annotation_values`` has one row for each.
    """
    leaf = ~F.col("kind").isin("array", "annotation")
    mine = F.col("pos") == F.col("top")
    elements = tokens.groupBy(*_OWNER, "type", "visibility", "top").agg(
        F.max(F.when(mine, F.struct("part", "kind", "value"))).alias("own"),
        F.array_sort(F.collect_list(F.when(leaf, F.struct("pos", F.coalesce("value", F.lit("null")).alias("value"))))).alias("inside"),
    )
    joined = F.array_join(F.transform("inside", lambda x: x["value"]), ",")
    shown = F.when(F.col("own.kind").isin("array", "annotation"), joined).otherwise(F.col("own.value"))
    # of elements with one name the last counts
    once = elements.groupBy(*_OWNER, "type", "visibility", F.col("own.part").alias("part")).agg(
        F.max_by(F.struct(F.col("own.kind").alias("kind"), shown.alias("value")), "top").alias("v")
    )
    entry = F.when(F.col("part").isNotNull(), F.struct(F.col("part").alias("key"), F.col("v").alias("value")))
    return once.groupBy(*_OWNER, "type", "visibility").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("values")
    )


def annotation_values(tokens: DataFrame) -> DataFrame:
    """Every plain value of the annotations with its ``path``, as in ``items[2].name``.

    ``tokens`` is the table ``annotation_token``.  Paths of blocks double their reach in each round, so rounds grow with the log of the depth.
    """
    step = F.when(F.col("named"), F.concat(F.lit("."), "part")).otherwise(F.concat(F.lit("["), "part", F.lit("]")))
    # tokens are read three times below, so they are written once
    tokens = cut(tokens)
    # a struct equals another whose nulls stand at the same places, as a method's owner has no parameter
    rows = tokens.filter("kind IS NOT NULL").withColumns(
        {"path": F.when(F.col("level") == 0, F.col("part")).otherwise(step), "owner": F.struct(*_OWNER)}
    )
    blocks = cut(rows.filter(F.col("kind").isin("array", "annotation")).select("owner", "pos", "parent", "path"))
    deepest = tokens.agg(F.max("level")).first()[0] or 0
    for _ in range(max(int(deepest) - 1, 0).bit_length()):
        upper = fresh(blocks).select("owner", F.col("pos").alias("parent"), F.col("parent").alias("upper"), F.col("path").alias("prefix"))
        blocks = cut(
            blocks.join(upper, ["owner", "parent"], "left").select(
                "owner", "pos", F.col("upper").alias("parent"), F.concat(F.coalesce("prefix", F.lit("")), "path").alias("path")
            )
        )
    leaves = rows.filter(~F.col("kind").isin("array", "annotation"))
    upper = blocks.select("owner", F.col("pos").alias("parent"), F.col("path").alias("prefix"))
    return leaves.join(upper, ["owner", "parent"], "left").select(
        *_OWNER, "type", "pos", F.concat(F.coalesce("prefix", F.lit("")), "path").alias("path"), "kind", "value"
    )


def declared_outers(annotations: DataFrame) -> DataFrame:
    """(app_id, cls, outer) that classes declare themselves: their enclosing class, or the class of their enclosing method."""
    kind = F.col("type")
    given = F.col("values")["value"]["value"]
    outer = F.when(kind == "Ldalvik/annotation/EnclosingClass;", given).when(
        kind == "Ldalvik/annotation/EnclosingMethod;", F.substring_index(given, "->", 1)
    )
    return (
        annotations.filter((F.col("owner_kind") == "class") & outer.isNotNull())
        .select("app_id", F.expr("substring(owner_key, length(app_id) + 2)").alias("cls"), binary_name(outer).alias("outer"))
        .distinct()
    )
