"""Positions, usage, members, search, scoring and resources on hand-made rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from symloom.functions import masks, text, values
from symloom.functions.verdicts import VERDICTS
from symloom.operators import positions, resources, scoring, search, shapes, xref
from symloom.plans import sieve

SYM = "struct<kind:string,owner:string,name:string,params:array<string>>"
ANNOT = f"unit string, off int, kind string, sym {SYM}"


def sym(kind, owner, name=""):
    return (kind, owner, name, [])


def test_enclosing(spark):
    rows = [
        ("u", 0, "end", None), ("u", 3, "def", sym("class", "A")), ("u", 10, "def", sym("method", "A", "m")),
        ("u", 18, "ref", sym("class", "B")), ("u", 26, "end", None), ("u", 28, "ref", sym("field", "B", "f")),
        ("u", 30, "end", None), ("u", 33, "ref", sym("class", "C")),
    ]
    got = {r.off: r.encl and r.encl.name for r in positions.enclosing(spark.createDataFrame(rows, ANNOT)).collect()}
    assert got == {0: None, 3: "", 10: "m", 18: "m", 26: "", 28: "", 30: None, 33: None}


def test_usage_index(spark):
    rows = [
        ("c.C", 2, "ref", sym("class", "x.X")),
        ("a.A", 0, "def", sym("class", "a.A")), ("a.A", 3, "ref", sym("class", "x.X")), ("a.A", 5, "def", sym("method", "a.A", "m")),
        ("a.A", 9, "ref", sym("method", "x.X", "go")), ("a.A", 10, "var", sym("variable", "v")), ("a.A", 11, "ref", sym("package", "x")),
        ("a.A", 12, "end", None), ("a.A", 14, "end", None),
    ]
    units = spark.createDataFrame([("a.A", "ab\ncd\nef\nghijklm\n"), ("c.C", "xyz")], "unit string, code string")
    got = [
        (r.target.owner, r.from_unit, r.from_member and r.from_member.name, r.off, r.line)
        for r in xref.usage_index(spark.createDataFrame(rows, ANNOT), units).orderBy("from_unit", "off").collect()
    ]
    assert got == [("x.X", "a.A", None, 3, 2), ("x.X", "a.A", "m", 9, 4), ("x.X", "c.C", None, 2, 1)]


def test_asof_directions(spark):
    left = spark.createDataFrame([("g", p) for p in (0, 5, 7)] + [("h", 1)], "g string, at int")
    right = spark.createDataFrame([("g", 5, "five"), ("g", 7, "seven"), ("g", 9, "nine")], "g string, r int, v string")

    def run(direction, strict):
        found = positions.asof(left, right, ["g"], "at", "r", ["v"], direction, strict)
        return [r.v for r in found.orderBy("g", "at").collect()]

    assert run("floor", False) == [None, "five", "seven", None]
    assert run("floor", True) == [None, None, "five", None]
    assert run("ceil", False) == ["five", "five", "seven", None]
    assert run("ceil", True) == ["five", "seven", "nine", None]
    assert run("exact", False) == [None, "five", "seven", None]


def test_live_ranges_and_scope(spark):
    events = [
        ("m", 1, 0, 0, "param", "p", "I"), ("m", 2, 1, 2, "start", "a", "J"), ("m", 2, 2, 5, "start", "b", "Z"),
        ("m", 2, 3, 8, "end", None, None), ("m", 2, 4, 10, "restart", None, None), ("m", 3, 5, 1, "end", None, None),
    ]
    ef = spark.createDataFrame(events, "method_key string, reg int, seq int, addr int, action string, name string, type string")
    size = spark.createDataFrame([("m", 20)], "method_key string, code_size int")
    ranges = positions.live_ranges(ef, size)
    got = sorted((r.reg, r.start_off, r.end_off, r.name, r.is_param) for r in ranges.collect())
    assert got == [(1, -1, 19, "p", True), (2, 2, 5, "a", False), (2, 5, 8, "b", False), (2, 10, 19, "b", False)]
    points = spark.createDataFrame([("m", 2, 3), ("m", 2, 9), ("m", 1, 0)], "method_key string, reg int, off int")
    found = positions.locals_in_scope(ranges, points)
    assert sorted((r.reg, r.off, r.name) for r in found.collect()) == [(1, 0, "p"), (2, 3, "a")]


def test_line_table(spark):
    rows = [("m", 0, 10 + 4, None, None), ("m", 1, 1, 3, None), ("m", 2, 3, None, 10), ("m", 3, 10 + 15 + 5, None, None), ("m", 4, 10 + 5, None, None), ("m", 5, 250, None, None)]
    df = spark.createDataFrame(rows, "method_key string, idx int, code int, advance_pc int, advance_line int")
    size = spark.createDataFrame([("m", 10)], "method_key string, code_size int")
    got = {r.off: r.line for r in positions.line_table(df, size).collect()}
    assert got == {0: 0, 4: 12, 9: 8}


def test_direct_throws(spark):
    writes = [
        ("m", 0, 0, "E", False, None), ("m", 2, 1, None, False, 0), ("m", 4, 2, None, False, 1),
        ("m", 6, 3, "T", True, None), ("m", 7, 4, None, False, 3), ("m", 9, 0, None, False, None),
    ]
    wf = spark.createDataFrame(writes, "method_key string, off int, reg int, type string, catch_all boolean, src_reg int")
    throws = spark.createDataFrame([("m", 5, 2), ("m", 8, 4), ("m", 10, 0), ("m", 11, 9)], "method_key string, off int, reg int")
    assert [tuple(r) for r in positions.direct_throws(wf, throws).collect()] == [("m", "E")]


def test_symbol_at(spark):
    code = "class Foo {\n  foo fooBar foo;\n}"
    rows = [("u", 6, "def", sym("class", "Foo")), ("u", 14, "ref", sym("class", "foo")), ("u", 18, "ref", sym("field", "x", "fooBar")), ("u", 25, "ref", sym("field", "x", "foo"))]
    clicks = [(1, "u", 2, "foo", None), (2, "u", 2, "foo", "field"), (3, "u", 1, "Foo", "method"), (4, "u", 2, "fooB", None), (5, "u", 9, "foo", None)]
    found = xref.symbol_at(
        spark.createDataFrame(rows, ANNOT), spark.createDataFrame([("u", code)], "unit string, code string"),
        spark.createDataFrame(clicks, "click int, unit string, line int, token string, hint string"),
    )
    assert {r.click: r.off for r in found.collect()} == {1: 14, 2: 25, 3: 6, 4: None, 5: None}


def test_symbols_on_words_that_nobody_clicks_go_no_further(spark, monkeypatch):
    """Of 1,000 symbols only those on clicked words are kept; a token that is more than a word looks at the code."""
    code = " ".join(f"w{i} x.y" for i in range(500))
    at, rows = 0, []
    for tok in code.split(" "):
        rows.append(("u", at, "ref", sym("field", tok, tok)))
        at += len(tok) + 1
    kept = []
    whole = xref.cut
    monkeypatch.setattr(xref, "cut", lambda df: kept.append(whole(df)) or kept[-1])
    clicks = [(1, "u", 1, "w7", None), (2, "u", 1, "w499", None), (3, "u", 1, "x.y", None), (4, "u", 1, "499", None)]
    found = xref.symbol_at(
        spark.createDataFrame(rows, ANNOT), spark.createDataFrame([("u", code)], "unit string, code string"),
        spark.createDataFrame(clicks, "click int, unit string, line int, token string, hint string"),
    )
    assert {r.click: r.off for r in found.collect()} == {1: code.index("w7 "), 2: code.index("w499"), 3: code.index("x.y"), 4: None}
    assert sorted(df.count() for df in kept) == [4, 502]


@pytest.mark.parametrize("sieved", [False, True])
def test_symbol_at_equals_a_search(spark, monkeypatch, sieved):
    """Places come from the code where it is: no scan over all annotations; words, parts of words, and tokens with other signs."""
    rng = random.Random(11)
    words = ["a", "aa", "ba", "foo", "\U0001d4d0a", "$x", "x1", ".", "->", "(", " ", " ", "\n", "\r\n", "é"]
    codes = {f"u{k}": "".join(rng.choice(words) for _ in range(rng.randrange(60))) for k in range(40)} | {"empty": "", "none": None}
    annots = [
        (u, at, rng.choice(["def", "ref", "ref", "end"]), sym(rng.choice(["class", "method", "field", "var"]), "o", str(at)))
        for u, code in codes.items() for at in sorted(rng.sample(range(len(code or "") + 3), (len(code or "") + 3) * 2 // 3))
    ]
    tokens = ["a", "aa", "a.", "foo", ".", "->", "(a", "a(", "x1", "\U0001d4d0a", "1", "", "nowhere", "\r", "a\r", "(foo", None]
    clicks = [(n, *c) for n, c in enumerate((u, line, t, rng.choice([None, "method", "class"])) for u in [*codes, "gone"] for line in (1, 2, 5) for t in rng.sample(tokens, 9))]

    def search(unit, line, token, hint):
        code = codes.get(unit)
        if not token or code is None or line > code.count("\n") + 1:
            return None
        start = len("\n".join(code.split("\n")[: line - 1])) + (line > 1)
        stop = start + len(code.split("\n")[line - 1])
        whole = lambda at: code[at : at + len(token)] == token and not re.match(r"[\w$]", code[at + len(token) : at + len(token) + 1])
        hits = [
            (hint is not None and s[0] != hint, at) for u, at, kind, s in annots
            if u == unit and start <= at <= stop and kind in ("def", "ref") and s[0] in xref.INDEXED_KINDS and whole(at)
        ]
        return min(hits)[1] if hits else None

    def refuse(*_):
        raise AssertionError("a scan over annotations")

    monkeypatch.setattr(positions, "floor_each", refuse)
    if sieved:
        monkeypatch.setattr(xref, "BROADCAST_ROWS", 0)
    found = xref.symbol_at(
        spark.createDataFrame(annots, ANNOT), spark.createDataFrame(list(codes.items()), "unit string, code string"),
        spark.createDataFrame(clicks, "click int, unit string, line int, token string, hint string"),
    )
    rows = found.collect()
    assert len(rows) == len(clicks) and {r.click: r.off for r in rows} == {n: search(*rest) for n, *rest in clicks}
    assert sum(r.off is not None for r in rows) > 40


def test_rows_that_cannot_meet_a_key_are_sifted(spark):
    many = spark.range(60_000).select((F.col("id") % 50).alias("unit"), F.col("id").alias("off"))
    keys = many.filter("off % 200 = 3")
    kept = {r["off"] for r in sieve.sifted(many, ["unit", "off"], keys, keys.count()).collect()}
    assert kept >= set(range(3, 60_000, 200)) and len(kept) < 9_000
    other = many.select(F.col("unit").cast("string").alias("unit"), "off")
    assert sieve.sifted(other, ["unit", "off"], keys, 300) is other


def test_pieces_of_lines_and_running_sums(spark):
    rows = [(k, None if k % 5 == 0 else list(range(k % 4))) for k in range(30)]
    summed = spark.createDataFrame(rows, "k int, v array<int>").select("k", text.running_sums(F.col("v")).alias("s")).collect()
    assert {r.k: r.s for r in summed} == {k: None if v is None else [sum(v[: i + 1]) for i in range(len(v))] for k, v in rows}
    units = spark.createDataFrame([("u", "ab é  c\n\nd "), ("w", None), ("x", "")], "unit string, code string")
    got = sorted(tuple(r) for r in positions.pieces(units, " ").select("unit", "line", "off", "tok").collect())
    assert got == [("u", 1, 0, "ab"), ("u", 1, 3, "é"), ("u", 1, 5, ""), ("u", 1, 6, "c"), ("u", 2, 8, ""), ("u", 3, 9, "d"), ("u", 3, 11, ""), ("x", 1, 0, "")]


def test_members(spark):
    classes = spark.createDataFrame([("a", "p.O", None, 0, 0), ("a", "p.O$In", "p.O", 0x1, 1), ("a", "p.O$1", "p.O", 0x1000, 2)], "app_id string, cls string, outer string, flags int, ord int")
    fields = spark.createDataFrame([("a", "p.O", "v", "I", 0x40, 0), ("a", "p.O", "syn", "I", 0x1000, 1)], "app_id string, cls string, name string, type string, flags int, ord int")
    methods = spark.createDataFrame(
        [("a", "p.O", "<init>", ["I", "[Ljava/util/Map;"], "V", 0x1, 0), ("a", "p.O", "<clinit>", [], "V", 0x8, 1), ("a", "p.O", "bridge", [], "V", 0x40, 2), ("a", "p.O", "run", [], "[J", 0x21, 3)],
        "app_id string, cls string, name string, params array<string>, ret string, flags int, ord int",
    )
    got = [(r.kind, r.signature, r.modifiers) for r in shapes.list_members(classes, fields, methods).orderBy("section", "ord").collect()]
    assert got == [
        ("field", "v: int", "volatile"), ("constructor", "O(int, Map[])", "public"), ("static_initializer", "static { … }", "static"),
        ("method", "run(): long[]", "public synchronized"), ("nested_class", "In", "public"),
    ]


def test_text_functions(spark):
    df = spark.createDataFrame([("aaaa", "a<b>&\"\x01\n")], "a string, b string")
    row = df.select(
        text.occurrences(F.col("a"), "aa").alias("n"), text.occurrences(F.col("a"), F.lit("aa")).alias("m"),
        text.occurrences(F.lit("x.y\\Ex.y"), ".y").alias("dots"), text.occurrences(F.lit("a\\Eb"), "\\E").alias("e"),
        text.escape_text(F.col("b")).alias("t"), text.escape_attr(F.col("b")).alias("q"),
        text.line_of(F.lit("a\nb\n"), F.lit(2)).alias("l"),
    ).first()
    assert (row.n, row.m, row.dots, row.e, row.l) == (3, 3, 2, 1, 2)
    assert row.t == 'a&lt;b&gt;&amp;"&#1;\n' and row.q == "a&lt;b&gt;&amp;&quot;&#1;&#10;"


def test_classify_content(spark):
    cases = [(b"", "text"), (b"\x89PNG\r\n\x1a\nxx", "image"), (b"RIFF0000WEBPxx", "image"), (b"RIFF0000WAVExx", "text"), (b"ab\x00cd", "hex"),
             (b"\x01" * 5 + b"x" * 95, "hex"), (b"\x01" * 4 + b"x" * 96, "text"), (b"\xff\xd8\xff\xe0", "image"), ("é" * 9000).encode() and (("é" * 9000).encode(), "text")]
    df = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(cases)], "i int, c binary")
    got = {r.i: r.k for r in df.select("i", text.classify_content(F.col("c")).alias("k")).collect()}
    assert got == {i: k for i, (_, k) in enumerate(cases)}


def test_search(spark):
    units = spark.createDataFrame([("a", 0, "x Foo\r\nbar\rfoo foo"), ("b", 1, None), ("c", 2, "foo"), ("d", 3, "food")], "unit string, ord int, code string")
    got = [(r.unit, r.line, r.snippet) for r in search.search_code(units, "foo", 3).collect()]
    assert got == [("a", 1, "x Foo"), ("a", 3, "foo foo"), ("c", 1, "foo")]
    assert tuple(search.search_summary(units, "foo", 3).first()) == (4, 4, 3, 1, True)
    assert tuple(search.search_summary(units, "foo", 4).first()) == (4, 4, 4, 1, False)
    assert tuple(search.search_summary(units, "foo", 1).first()) == (1, 4, 1, 0, True)
    assert tuple(search.search_summary(units, "  ").first()) == (0, 4, 0, 0, False)
    assert search.search_code(units, "(", regex=True).count() == 0
    assert search.search_code(units, "^foo$", regex=True, ignore_case=False).count() == 1
    assert search.search_code(units, "FOO", ignore_case=False).count() == 0
    assert tuple(search.search_summary(units, "foo").first()) == (4, 4, 4, 1, False)


def test_search_gives_all_lines(spark):
    units = spark.createDataFrame([("a", 0, "foo\n" * 1200)], "unit string, ord int, code string")
    assert search.search_code(units, "foo").count() == 1200
    assert search.search_code(units, "foo", 7).count() == 7
    members = spark.range(900).selectExpr("id AS ord", "'class' AS kind", "'foo' AS label", "'x' AS signature")
    assert search.search_members(members, "foo", ["class"]).count() == 900


def test_failing_search_is_raised(spark, monkeypatch):
    def lost(*_):
        raise RuntimeError("lost executor")

    units = spark.createDataFrame([("a", 0, "foo")], "unit string, ord int, code string")
    monkeypatch.setattr(type(spark), "range", lost)
    with pytest.raises(RuntimeError):
        search.search_code(units, "f.o", regex=True)


def test_content_beyond_leading_bytes_counts(spark):
    df = spark.createDataFrame([(bytearray(b"x" * 9000 + b"\x00" * 9000),)], "c binary")
    whole, head = df.select(text.classify_content(F.col("c")), text.classify_content(F.col("c"), 8192)).first()
    assert (whole, head) == ("hex", "text")


def test_match_spans(spark):
    units = spark.createDataFrame([("a", "aaaa b AA"), ("e", "xax")], "unit string, code string")

    def spans(*args, **kw):
        return sorted((r.unit, r.start, r.end) for r in search.match_spans(units, *args, **kw).collect())

    assert spans("aa") == [("a", 0, 2), ("a", 2, 4), ("a", 7, 9)]
    assert spans("aa", ignore_case=False) == [("a", 0, 2), ("a", 2, 4)]
    assert spans("a*", regex=True, ignore_case=False) == [("a", 0, 4), ("e", 1, 2)]
    assert spans("(?=b)b", regex=True) == [("a", 5, 6)]
    assert spans("[", regex=True) == []


def test_result_page(spark):
    df = spark.createDataFrame([(10, 60, False), (300, 60, True), (5, -1, False)], "n int, lim int, capped boolean")
    got = [tuple(r.p) for r in df.select(search.result_page(F.col("n"), F.col("lim"), F.col("capped")).alias("p")).collect()]
    assert got == [(10, False, "showing 10 of 10"), (60, True, "showing 60 of 300+"), (0, True, "showing 0 of 5")]


def test_token_profile(spark):
    code = '// c\n@Override public int x1 = 0x1F + 1.5e-3; /* a */ String s = "q\\"r"; char c = \'x\'; .5f _y'
    got = {r.kind: r.n for r in shapes.token_profile(spark.createDataFrame([("u", code)], "unit string, code string")).collect()}
    assert got == {"comment": 2, "annotation": 1, "keyword": 3, "identifier": 5, "number": 3, "string": 2, "punctuation": 7}


def test_manifest(spark):
    full = '<manifest a="1" package="com.x">\n<application android:label="l" android:name=".App"><activity android:name="Main"><intent-filter>android.intent.category.LAUNCHER'
    bare = '<manifest><activity-alias android:name="y.Z">android.intent.category.LAUNCHER</activity-alias>'
    df = spark.createDataFrame([(0, full), (1, bare), (2, "")], "i int, xml string")
    got = {r.i: (r.package, r.launcher, r.application) for r in shapes.manifest_components(df, "xml").collect()}
    assert got == {0: ("com.x", "com.x.Main", "com.x.App"), 1: (None, "y.Z", None), 2: (None, None, None)}


def test_masks(spark):
    b = masks.KIND_BITS
    pairs = [(b["int"], b["int"], "equal"), (b["int"], b["float"], "conflict"), (b["int"], b["int"] + b["float"], "narrower"),
             (b["int"] + b["float"], b["int"], "wider"), (b["int"] + b["float"], b["int"] + b["char"], "unrelated")]
    df = spark.createDataFrame([(x, y) for x, y, _ in pairs], "a int, b int")
    assert [r.k for r in df.select(masks.mask_relation(F.col("a"), F.col("b")).alias("k")).collect()] == [p[2] for p in pairs]
    cons = spark.createDataFrame([("v", b["int"] + b["float"]), ("v", b["float"] + b["long"]), ("w", b["int"]), ("w", b["char"])], "value string, mask int")
    assert {r.value: r.chosen for r in shapes.infer_types(cons).collect()} == {"v": "float", "w": "conflict"}


def test_scoring(spark):
    rows = [
        ("same", "c", (True, True, None), (True, True, None)), ("tied", "c", (False, False, None), (False, False, None)),
        ("mixed", "c", (True, False, None), (False, True, None)), ("exact", "d", (True, True, None), (False, True, None)),
        ("extra", "d", (True, True, None), (False, False, None)), ("better", "d", (False, True, None), (True, True, None)),
        ("exec", "d", (False, False, True), (False, False, False)), ("half", "d", (False, False, True), (False, False, None)),
    ]
    sig = "struct<no_error:boolean,recompiles:boolean,exec:boolean>"
    paired = spark.createDataFrame(rows, f"sample string, category string, ref {sig}, cand {sig}")
    allow = spark.createDataFrame([("exact", ["no-error"]), ("extra", ["no-error"]), ("better", ["no-error"]), ("gone", ["no-error"])], "sample string, signals array<string>")
    judged = scoring.judge(paired)
    final = scoring.apply_allowlist(judged, allow).cache()
    assert {r.sample: r.verdict for r in final.collect()} == {
        "same": "PARITY", "tied": "PARITY", "mixed": "REGRESSION", "exact": "EXPECTED_DIVERGENCE", "extra": "REGRESSION",
        "better": "IMPROVEMENT", "exec": "REGRESSION", "half": "PARITY",
    }
    assert [r.sample for r in scoring.stale_entries(judged, allow).collect()] == ["better"]
    board = {r.category: r.asDict() for r in scoring.scoreboard(final).collect()}
    assert board["c"]["evidenced_parity"] == 1 and board["c"]["tied_parity"] == 1 and board["c"]["regression"] == 1
    assert board["d"]["expected_divergence"] == 1 and board["d"]["tied_parity"] == 1
    assert scoring.verdict_table(final).columns == ["category", *VERDICTS]
    assert tuple(scoring.gate(final).first()) == (False, 3)
    assert {r.signal: (r.passed, r.evaluated) for r in scoring.signal_pass_counts(paired).collect()} == {"no-error": (4, 8), "recompiles": (4, 8), "exec-check": (2, 2)}


def test_no_error_signal(spark):
    units = [("ok", "fine", 0), ("marked", "x Code restructure failed y", 0), ("marked", "fine", 0), ("counted", "fine", 2), ("empty", None, 0)]
    got = {r.sample: r.no_error for r in scoring.no_error_signal(spark.createDataFrame(units, "sample string, code string, error_count int")).collect()}
    assert got == {"ok": True, "marked": False, "counted": False, "empty": False}


def test_values(spark):
    cases = [
        (0, 0, None, None, "@null"), (0, 1, None, None, "@empty"), (1, 0, None, None, "@null"), (1, 0x7F010000, None, "id/a", "@+id/a"),
        (2, -1, None, None, "?0xffffffff"), (3, 5, "txt", None, "txt"), (4, 0x3FC00000, None, None, "1.5"), (4, -0x40800000, None, None, "-1"),
        (4, 0x5F000000, None, None, "9223372036854775807"), (4, -0x21000000, None, None, "-9223372036854775808"), (4, 0x5A000000, None, None, "9007199254740992"),
        (4, 0x7F800000, None, None, "922337203685477.5807"), (4, -0x00800000, None, None, "-922337203685477.5807"), (4, 0x7FC00000, None, None, "NaN"),
        (5, 0x00100001, None, None, "16dp"), (5, 0x00001001, None, None, "0.0625dp"), (6, 0x00004030, None, None, "0%"),
        (0x10, -7, None, None, "-7"), (0x11, 255, None, None, "0xff"), (0x12, 3, None, None, "true"),
        (0x1C, -1, None, None, "#ffffffff"), (0x1D, 0x00ABCDEF, None, None, "#abcdef"), (0x1F, 0x5, None, None, "#005"), (5, 0x00010007, None, None, "1?d7"), (5, -0x100, None, None, "65535.9961px"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t int, d int, s string, r string, want string")
    rows = df.select("want", values.format_value(F.col("t"), F.col("d"), F.col("s"), F.col("r")).alias("got")).collect()
    assert [r.got for r in rows if r.got != r.want] == []


def test_resources(spark):
    res = spark.createDataFrame(
        [("a", 0x7F040000, "string", "app_name", "", 0), ("a", 0x7F040000, "string", "other", "de", 1), ("a", 0x7F020000, "id", "box", "", 2),
         ("b", 0x7F040000, "string", "title", "", 0)],
        "app_id string, id int, type string, name string, config string, ord int",
    )
    fw = spark.createDataFrame([(0x01010000, "attr/old", 0), (0x01010000, "attr/theme", 1)], "id int, name string, ord int")
    want = [("a", 0x7F040000, "@string/app_name"), ("a", 0x7F020000, "@+id/box"), ("a", 0x01010000, "@android:attr/theme"), ("a", 0x7FFFFFFF, "@0x7fffffff"),
            ("a", 0, "@null"), ("b", 0x7F040000, "@string/title"), ("b", 0x7F020000, "@0x7f020000"), ("b", 0x01010000, "@android:attr/theme")]
    refs = spark.createDataFrame([w[:2] for w in want], "app_id string, id int")
    assert sorted(tuple(r) for r in resources.resolve_refs(refs, res, fw).select("app_id", "id", "ref").collect()) == sorted(want)
    bags = spark.createDataFrame([("a", 1, "", 0, []), ("a", 2, "", 1, [(0x01010000, 0x10, 5), (99, 1, 0x7F040000)])], f"app_id string, id int, config string, ord int, bag {resources.BAG_ITEM}")
    shown = {r.id: r.text for r in resources.render_bags(bags, resources.symbolic_names(res, fw)).collect()}
    assert shown == {1: "[]", 2: "[android:attr.theme=5, @string/app_name]"}
    ids = spark.createDataFrame([(255, 1, 2), (127, 4, 0)], "p int, t int, e int")
    assert [r.id for r in ids.select(resources.resource_id(F.col("p"), F.col("t"), F.col("e")).alias("id")).collect()] == [-16711678, 0x7F040000]
