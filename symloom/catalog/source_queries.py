"""Sources and sinks over texts, archives and id maps that come from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.catalog.registry import query
from symloom.functions.text import classify_content
from symloom.operators import bodies
from symloom.session import scratch_folder
from symloom.sources import containers, disassembly


def disassembly_files(v):
    """Every part as the disassembly text of one class."""
    k, size = F.col("p_partkey"), F.col("p_size")
    key = k.cast("string")
    final = F.when(size % 2 == 0, "final ").otherwise("")
    base = F.when(k > 0, F.concat(F.lit(".super Lp/C"), F.floor((k - 1) / 3).cast("string"), F.lit(";\n"))).otherwise("")
    broken = F.when(
        size % 5 == 0, ".method public static bad([I)V\n    # <error rendering method: truncated>\n.end method\n"
    ).otherwise("")
    text = F.concat(
        F.lit(".class public "), final, F.lit("Lp/C"), key, F.lit(";\n"), base,
        F.lit(".implements Li/A"), (size % 3).cast("string"), F.lit(";\n.implements Li/B;\n.source \"C.java\"\n\n"),
        F.lit(".field private f"), key, F.lit(":[J\n.field public static final N:I = 0x1f\n\n"),
        F.lit(".method public constructor <init>(IJ)V\n    .registers 6\n    :try_start_0\n"),
        F.lit("    invoke-direct {p0}, Ljava/lang/Object;-><init>()V\n    const/16 v0, 0x"), F.lower(F.hex(size)),
        F.lit("\n    if-eqz v0, :cond_5\n    invoke-static/range {p1 .. p3}, Lp/C"), key, F.lit(";->run(IJ)V\n"),
        F.lit("    :try_end_9\n    .catch Ljava/io/IOException; {:try_start_0 .. :try_end_9} :catch_b\n"),
        F.lit("    :cond_5\n    return-void\n    :catch_b\n    move-exception v1\n    const-string v2, \"a v3, "), F.col("p_name"),
        F.lit("\"\n    throw v1\n.end method\n\n"), broken,
    )
    return v.table("part").select(F.lit("app").alias("app_id"), F.concat(F.lit("C"), key).alias("input_file"), text.alias("text"))


@query(
    """SELECT 'p.C' || p_partkey AS cls, CAST(1 + CASE WHEN p_size % 2 = 0 THEN 16 ELSE 0 END AS INTEGER) AS flags,
    CASE WHEN p_partkey > 0 THEN 'p.C' || (p_partkey - 1) // 3 END AS super, 'i.A' || (p_size % 3) || ',i.B' AS interfaces, 'C.java' AS source_file FROM part"""
)
def disassembly_classes(v):
    t = disassembly.parse_disassembly(disassembly_files(v))["class"]
    return t.select("cls", "flags", "super", F.array_join("interfaces", ",").alias("interfaces"), "source_file")


@query(
    """SELECT 'p.C' || p_partkey AS cls, 'f' || p_partkey AS name, '[J' AS type, 2 AS flags, NULL AS const FROM part
    UNION ALL SELECT 'p.C' || p_partkey, 'N', 'I', 25, '0x1f' FROM part"""
)
def disassembly_fields(v):
    return disassembly.parse_disassembly(disassembly_files(v))["field"].select("cls", "name", "type", "flags", "const")


@query(
    """SELECT 'p.C' || p_partkey AS cls, '<init>' AS name, 'I,J' AS params, 'V' AS ret, 65537 AS flags, 6 AS registers, TRUE AS has_handlers, NULL AS error FROM part
    UNION ALL SELECT 'p.C' || p_partkey, 'bad', '[I', 'V', 9, NULL, FALSE, 'truncated' FROM part WHERE p_size % 5 = 0"""
)
def disassembly_methods(v):
    t = disassembly.parse_disassembly(disassembly_files(v))["method"]
    return t.select("cls", "name", F.array_join("params", ",").alias("params"), "ret", "flags", "registers", "has_handlers", "error")


@query(
    """WITH m AS (SELECT 'app/p.C' || p_partkey || '-><init>(IJ)V' AS method_key, p_partkey, p_size, p_name FROM part)
    SELECT method_key, 0 AS off, 'invoke-direct' AS op, '2' AS regs, NULL AS literal, NULL AS target, 'Ljava/lang/Object;-><init>()V' AS ref FROM m
    UNION ALL SELECT method_key, 1, 'const/16', '0', CAST(p_size AS BIGINT), NULL, NULL FROM m
    UNION ALL SELECT method_key, 2, 'if-eqz', '0', NULL, 4, NULL FROM m
    UNION ALL SELECT method_key, 3, 'invoke-static/range', '3,4,5', NULL, NULL, 'Lp/C' || p_partkey || ';->run(IJ)V' FROM m
    UNION ALL SELECT method_key, 4, 'return-void', '', NULL, NULL, NULL FROM m
    UNION ALL SELECT method_key, 5, 'move-exception', '1', NULL, NULL, NULL FROM m
    UNION ALL SELECT method_key, 6, 'const-string', '2', NULL, NULL, '"a v3, ' || p_name || '"' FROM m
    UNION ALL SELECT method_key, 7, 'throw', '1', NULL, NULL, NULL FROM m"""
)
def disassembly_instructions(v):
    t = disassembly.parse_disassembly(disassembly_files(v))["insn"]
    return t.select("method_key", "off", "op", F.array_join("regs", ",").alias("regs"), "literal", "target", "ref")


@query(
    """SELECT 'app/p.C' || p_partkey || '-><init>(IJ)V' AS method_key, 0 AS start_off, 3 AS end_off, 'java.io.IOException' AS type, 5 AS handler_off FROM part"""
)
def disassembly_try_ranges(v):
    t = disassembly.parse_disassembly(disassembly_files(v))["try_range"]
    return t.select("method_key", "start_off", "end_off", F.explode("handlers").alias("h")).select(
        "method_key", "start_off", "end_off", "h.type", F.col("h.off").alias("handler_off")
    )


@query(
    """SELECT 'app/p.C' || p_partkey || '-><init>(IJ)V' AS method_key, src, dst, x AS exceptional FROM part,
    (VALUES (1, 2, FALSE), (1, 3, FALSE), (2, 3, FALSE), (1, 4, TRUE), (2, 4, TRUE)) t(src, dst, x)"""
)
def control_flow_of_text(v):
    """From the text of every part to the edges of its control flow."""
    t = disassembly.parse_disassembly(disassembly_files(v))
    edges = bodies.control_flow(t["insn"], t["try_range"], t["switch"])["edge"]
    return edges.select("method_key", F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "exceptional")


def annotated_files(v):
    """Every part as the text of a class with annotations, parameters, lines, variables and comments."""
    k, size, name = F.col("p_partkey").cast("string"), F.col("p_size"), F.col("p_name")
    n = size.cast("string")
    outer = F.when(
        size % 4 == 0,
        F.concat(F.lit(".annotation system Ldalvik/annotation/EnclosingClass;\n    value = Lp/D"), (F.col("p_partkey") - 1).cast("string"), F.lit(";\n.end annotation\n")),
    ).otherwise("")
    text = F.concat(
        F.lit("# made from "), name, F.lit("\n.class public Lp/D"), k, F.lit(";   # \"quoted\"\n.super Ljava/lang/Object;\n"), outer,
        F.lit(".field private list:Ljava/util/List;\n    .annotation runtime Lp/Tag;\n        names = {\n            \""), name, F.lit('", "b # '), n,
        F.lit('"\n        }\n        item = .subannotation Lp/Item;\n            size = 0x'), F.lower(F.hex(size)),
        F.lit("\n            level = .enum Lp/Level;->L"), (size % 3).cast("string"), F.lit(":Lp/Level;\n        .end subannotation\n    .end annotation\n.end field\n"),
        F.lit('.method public run(JI)V\n\t.locals 2\n    .param p1, "when"    # J\n    .param p3, "n"\n        .annotation build Lp/Size;\n            value = '), n,
        F.lit("\n        .end annotation\n    .end param\n    .prologue\n    .line "), (size + 100).cast("string"), F.lit("\n    const/4 v0, "), (size % 7).cast("string"),
        F.lit('\n    .local v0, "a'), n, F.lit('":I\n'), F.when(size % 2 == 1, "    nop  # odd\n").otherwise(""), F.lit("    .line "), (size + 200).cast("string"),
        F.lit('\n    .end local v0    # "a":I\n    const-string v1, "x # '), name, F.lit('"\n    .restart local v0\n    return-void\n.end method\n'),
    )
    return v.table("part").select(F.lit("app").alias("app_id"), F.concat(F.lit("D"), k).alias("input_file"), text.alias("text"))


@query(
    """WITH p AS (SELECT 'app/p.D' || p_partkey AS c, p_partkey, p_size, p_name FROM part)
    SELECT 'class' AS owner_kind, c AS owner_key, NULL AS param, 'Ldalvik/annotation/EnclosingClass;' AS type, 'value' AS path, 'type' AS kind, 'Lp/D' || (p_partkey - 1) || ';' AS value FROM p WHERE p_size % 4 = 0
    UNION ALL SELECT 'field', c || '->list:Ljava/util/List;', NULL, 'Lp/Tag;', 'names[0]', 'string', p_name FROM p
    UNION ALL SELECT 'field', c || '->list:Ljava/util/List;', NULL, 'Lp/Tag;', 'names[1]', 'string', 'b # ' || p_size FROM p
    UNION ALL SELECT 'field', c || '->list:Ljava/util/List;', NULL, 'Lp/Tag;', 'item.size', 'number', '0x' || lower(to_hex(p_size)) FROM p
    UNION ALL SELECT 'field', c || '->list:Ljava/util/List;', NULL, 'Lp/Tag;', 'item.level', 'enum', 'Lp/Level;->L' || (p_size % 3) || ':Lp/Level;' FROM p
    UNION ALL SELECT 'param', c || '->run(JI)V', 'p3', 'Lp/Size;', 'value', 'number', CAST(p_size AS VARCHAR) FROM p"""
)
def disassembly_annotations(v):
    """Values of the annotations of classes, fields and parameters, nested ones with their path."""
    tokens = disassembly.parse_disassembly(annotated_files(v))["annotation_token"]
    return disassembly.annotation_values(tokens).select("owner_kind", "owner_key", "param", "type", "path", "kind", "value")


@query(
    """WITH p AS (SELECT 'app/p.D' || p_partkey || '->run(JI)V' AS method_key, p_size, p_size % 2 AS odd FROM part)
    SELECT method_key, 3 AS reg, 'when' AS name, 'J' AS type, -1 AS start_off, CAST(2 + odd AS INTEGER) AS end_off, TRUE AS is_param FROM p
    UNION ALL SELECT method_key, 5, 'n', 'I', -1, CAST(2 + odd AS INTEGER), TRUE FROM p
    UNION ALL SELECT method_key, 0, 'a' || p_size, 'I', 1, CAST(1 + odd AS INTEGER), FALSE FROM p
    UNION ALL SELECT method_key, 0, 'a' || p_size, 'I', CAST(2 + odd AS INTEGER), CAST(2 + odd AS INTEGER), FALSE FROM p"""
)
def disassembly_locals(v):
    """Where variables and parameters live, from the directives among the instructions."""
    t = disassembly.parse_disassembly(annotated_files(v))["local_var"]
    return t.select("method_key", "reg", "name", "type", "start_off", "end_off", "is_param")


@query(
    """SELECT 'app/p.D' || p_partkey || '->run(JI)V' AS method_key, 0 AS off, CAST(p_size + 100 AS INTEGER) AS line FROM part
    UNION ALL SELECT 'app/p.D' || p_partkey || '->run(JI)V', CAST(1 + p_size % 2 AS INTEGER), CAST(p_size + 200 AS INTEGER) FROM part"""
)
def disassembly_lines(v):
    return disassembly.parse_disassembly(annotated_files(v))["line"].select("method_key", "off", "line")


@query(
    """SELECT 'app' AS app_id, 'p.D' || p_partkey AS cls, 'p.D' || (p_partkey - 1) AS outer FROM part WHERE p_size % 4 = 0"""
)
def declared_outers(v):
    """The outer class that a class names itself, as ``resolve_outer`` takes it."""
    return disassembly.declared_outers(disassembly.parse_disassembly(annotated_files(v))["annotation"])


@query(
    """WITH p AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, page_id % 6 AS k FROM pages)
    SELECT path, format FROM (
      SELECT host AS path, 'zip' AS f, bool_or(k = 0) AS plain, bool_or(k = 1) AS inner_apk, bool_or(k = 2) AS apkm, bool_or(k = 3) AS xapk FROM p GROUP BY host) q,
    LATERAL (SELECT CASE WHEN inner_apk AND NOT plain THEN CASE WHEN apkm THEN 'apkm' WHEN xapk THEN 'xapk' ELSE 'apks' END ELSE 'zip' END AS format)
    UNION ALL SELECT 'page' || page_id || CASE WHEN page_id % 4 = 1 THEN '.APK' WHEN page_id % 4 = 2 THEN '.dex' ELSE '.txt' END,
      CASE WHEN page_id % 5 = 0 THEN 'dex' WHEN page_id % 4 = 1 THEN 'zip' WHEN page_id % 4 = 2 THEN 'dex' END FROM pages"""
)
def route_inputs(v):
    """Hosts as archives of their pages; pages as loose files of several formats."""
    k = F.col("page_id")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    slot = k % 6
    entries = v.table("pages").select(
        host.alias("archive"),
        F.when(slot == 0, "AndroidManifest.xml").when(slot == 1, F.concat(F.lit("x/"), k.cast("string"), F.lit(".APK")))
        .when(slot == 2, "info.json").when(slot == 3, "manifest.json").otherwise("other.txt").alias("name"),
        F.when(slot == 2, '{"v": "apkm"}').when(slot == 3, '{"split_apks": []}').alias("text"),
    )
    zips = entries.select(F.col("archive").alias("path")).distinct().withColumn("content", F.unhex(F.lit("504B03040000")))
    ending = F.when(k % 4 == 1, ".APK").when(k % 4 == 2, ".dex").otherwise(".txt")
    body = F.encode("html", "UTF-8")
    loose = v.table("pages").select(
        F.concat(F.lit("page"), k.cast("string"), ending).alias("path"),
        F.when(k % 5 == 0, F.concat(F.unhex(F.lit("6465780A")), body)).otherwise(body).alias("content"),
    )
    return containers.route_inputs(zips.unionByName(loose), entries)


@query(
    """WITH @v_entry, e AS (SELECT archive, pos, usize, CASE WHEN pos % 50 = 7 THEN 'a/../b' WHEN pos % 50 = 8 THEN 'C:/x' ELSE 'd' || replace(name, '/', CASE WHEN pos % 2 = 0 THEN chr(92) ELSE '/' END) END AS name FROM v_entry),
    c AS (SELECT *, CASE WHEN pos % 50 IN (7, 8) THEN NULL ELSE replace(name, chr(92), '/') END AS clean,
      sum(usize) OVER (PARTITION BY archive ORDER BY pos) AS total, count(*) OVER (PARTITION BY archive) AS n,
      bool_or(pos % 50 IN (7, 8)) OVER (PARTITION BY archive) AS bad FROM e)
    SELECT archive, pos, clean, CASE WHEN n > 40 THEN 'too_many_entries' WHEN bad THEN 'unsafe_archive' WHEN usize > 9000 THEN 'entry_too_large' WHEN total > 30000 THEN 'archive_too_large' END AS refusal,
    CASE WHEN clean IS NULL THEN 'unsafe_name' END AS row_refusal FROM c"""
)
def guard_entries(v):
    pos = F.col("pos")
    slashed = F.when(pos % 2 == 0, F.replace("name", F.lit("/"), F.lit("\\"))).otherwise(F.col("name"))
    named = v.v_entry.withColumn(
        "name", F.when(pos % 50 == 7, "a/../b").when(pos % 50 == 8, "C:/x").otherwise(F.concat(F.lit("d"), slashed))
    )
    strict = containers.guard_entries(named, 40, 9000, 30000)
    loose = containers.guard_entries(named, reject_unsafe=False).select("archive", "pos", F.col("refusal").alias("row_refusal"))
    return strict.select("archive", "pos", "clean", "refusal").join(loose, ["archive", "pos"])


@query(
    """WITH @v_class SELECT cls, 0 AS load_order, 'a.apk' || CASE WHEN flags % 4 > 1 THEN '!' || (flags % 4) ELSE '' END AS part FROM v_class WHERE flags % 2 = 0
    UNION ALL SELECT cls, 1, 'a.apk' || CASE WHEN flags % 4 > 1 THEN '!' || (flags % 4) ELSE '' END FROM v_class WHERE flags % 2 <> 0"""
)
def merge_inputs(v):
    merged = containers.merge_inputs([v.v_class.filter("flags % 2 = 0"), v.v_class.filter("flags % 2 <> 0")])
    n = F.col("flags") % 4
    return merged.select("cls", "load_order", containers.part_name(F.lit("a.apk"), n, n).alias("part"))


@query(
    """SELECT CAST(16842752 + p_partkey AS INTEGER) AS id, 'attr/' || p_name AS name FROM part WHERE p_size % 6 <> 0 AND p_size % 6 <> 1"""
)
def parse_id_map(v):
    k, size = F.col("p_partkey"), F.col("p_size") % 6
    hex_id = F.lower(F.hex(16842752 + k))
    line = (
        F.when(size == 0, F.concat(F.lit("=attr/"), "p_name"))
        .when(size == 1, F.concat(F.lit("zz"), hex_id, F.lit("=attr/"), "p_name"))
        .otherwise(F.concat(hex_id, F.lit("=attr/"), "p_name"))
    )
    return containers.parse_id_map(v.table("part").select(line.alias("value")))


@query(
    """WITH @v_doc SELECT 'org/' || scope || '/D' || unit || '.java' AS path, 'org.' || scope AS package,
    md5(CASE WHEN n < 50 OR unit % 10 = 3 THEN '// could not export ''org.' || scope || '.D' || unit || ''': ' || CASE WHEN unit % 10 = 3 THEN 'boom' ELSE 'no output' END || chr(10) ELSE code END) AS text FROM v_doc
    UNION ALL SELECT 'resources/res/' || page_id || '.xml', 'resources', md5(html) FROM pages"""
)
def export_rows(v):
    u = F.col("unit")
    failed = u % 10 == 3
    units = v.v_doc.select(
        F.concat(F.lit("org."), "scope", F.lit(".D"), u.cast("string")).alias("full"),
        F.when(~((F.col("n") < 50) | failed), F.col("code")).alias("code"), F.when(failed, "boom").alias("error"),
    )
    extra = v.table("pages").select(
        F.concat(F.lit("res/"), F.col("page_id").cast("string"), F.lit(".xml")).alias("path"), F.col("html").alias("text")
    )
    return containers.export_rows(units, "java", extra).withColumn("text", F.md5("text"))


@query(
    """WITH @v_doc SELECT 'org.' || scope AS package, 'org/' || scope || '/D' || unit || '.kt' AS path,
    md5(CASE WHEN unit % 10 = 3 THEN '// could not export ''org.' || scope || '.D' || unit || ''': boom' || chr(10) ELSE code END) AS text FROM v_doc"""
)
def export_units(v):
    """Units written as files of one folder per package, and read back."""
    u = F.col("unit")
    failed = u % 10 == 3
    units = v.v_doc.select(
        F.concat(F.lit("org."), "scope", F.lit(".D"), u.cast("string")).alias("full"),
        F.when(~failed, F.col("code")).alias("code"), F.when(failed, "boom").alias("error"),
    )
    folder = scratch_folder(v.spark, "export")
    containers.export_units(units, folder, language="kotlin", by_package=True)
    return v.spark.read.parquet(folder).select("package", "path", F.md5("text").alias("text"))


_BODY_SQL = """b AS (SELECT doc_id AS unit, CASE doc_id % 8 WHEN 0 THEN 'GIF89a' || text WHEN 1 THEN 'BM' || text WHEN 2 THEN replace(text, 'e', chr(7))
      WHEN 3 THEN text || chr(127) WHEN 4 THEN 'RIFF1234WEBP' || text WHEN 5 THEN replace(text, 'z', chr(1)) WHEN 6 THEN '' ELSE text END AS t FROM documents),
    h AS (SELECT unit, t, hex(encode(t)) AS x FROM b),
    n AS (SELECT unit, t, length(x) // 2 AS lim, len(list_filter(range(0, length(x) // 2), lambda i: substr(x, 2 * i + 1, 2) IN ('07', '01', '7F'))) AS odd FROM h)"""


@query(
    f"""WITH {_BODY_SQL} SELECT unit, CASE WHEN t LIKE 'GIF8%' OR t LIKE 'BM%' OR t LIKE 'RIFF____WEBP%' THEN 'image'
    WHEN lim = 0 OR odd * 20 < lim THEN 'text' ELSE 'hex' END AS kind FROM n"""
)
def classify_content_kind(v):
    d, text = F.col("doc_id") % 8, F.col("text")
    body = (
        F.when(d == 0, F.concat(F.lit("GIF89a"), text)).when(d == 1, F.concat(F.lit("BM"), text))
        .when(d == 2, F.replace(text, F.lit("e"), F.lit("\x07"))).when(d == 3, F.concat(text, F.lit("\x7f")))
        .when(d == 4, F.concat(F.lit("RIFF1234WEBP"), text)).when(d == 5, F.replace(text, F.lit("z"), F.lit("\x01")))
        .when(d == 6, "").otherwise(text)
    )
    return v.table("documents").select(
        F.col("doc_id").alias("unit"), classify_content(F.encode(body, "UTF-8")).alias("kind")
    )
