"""Column functions: names, signatures, flags, text, values, masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.catalog.registry import query
from symloom.functions import masks, names, signatures, text, values
from symloom.operators import search, shapes


@query(
    """WITH @v_class, d AS (
    SELECT cls, CASE WHEN cls % 3 = 0 THEN '[I' WHEN cls % 3 = 1 THEN 'L' || replace("full", '.', '/') || ';'
                     ELSE 'L;' || name END AS descr FROM v_class)
    SELECT cls, CASE WHEN length(descr) > 2 AND descr LIKE 'L%;'
                     THEN replace(substr(descr, 2, length(descr) - 2), '/', '.') ELSE descr END AS binary_name FROM d"""
)
def binary_name(v):
    k = F.col("cls")
    desc = (
        F.when(k % 3 == 0, "[I")
        .when(k % 3 == 1, F.concat(F.lit("L"), F.translate("full", ".", "/"), F.lit(";")))
        .otherwise(F.concat(F.lit("L;"), F.col("name")))
    )
    return v.v_class.select("cls", names.binary_name(desc).alias("binary_name"))


@query(
    """WITH @v_class, n AS (
    SELECT cls, CASE WHEN cls % 4 = 0 THEN name WHEN cls % 4 = 1 THEN "full" || '$Inner$' || cls ELSE "full" END AS f
    FROM v_class)
    SELECT cls, CASE WHEN position('.' IN f) > 0 THEN substr(f, 1, length(f) - position('.' IN reverse(f))) ELSE '' END AS package,
    list_last(string_split(list_last(string_split(f, '.')), '$')) AS simple, replace(f, '$', '.') AS canonical FROM n"""
)
def package_and_simple_name(v):
    k = F.col("cls")
    full = (
        F.when(k % 4 == 0, F.col("name"))
        .when(k % 4 == 1, F.concat("full", F.lit("$Inner$"), k.cast("string")))
        .otherwise(F.col("full"))
    )
    return v.v_class.withColumn("f", full).select(
        "cls", names.package_of(F.col("f")).alias("package"), names.simple_name(F.col("f")).alias("simple"),
        names.canonical_class(F.col("f")).alias("canonical"),
    )


_SIGNATURE = """SELECT p_partkey AS cls, '(' || CASE WHEN p_size % 2 = 0 THEN 'I' ELSE 'J' END
    || 'Lp/' || replace(p_name, ' ', '_') || ';' || repeat('[', CAST(p_size % 4 AS BIGINT)) || 'D'
    || CASE WHEN p_size % 5 = 0 THEN 'D' ELSE '' END || ')'
    || CASE WHEN p_size % 3 = 0 THEN 'V' ELSE '[Lq/' || replace(p_brand, '#', '') || ';' END AS sig FROM part"""


def _signatures(v):
    size = F.col("p_size")
    sig = F.concat(
        F.lit("("), F.when(size % 2 == 0, "I").otherwise("J"), F.lit("Lp/"),
        F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(";"),
        F.expr("repeat('[', p_size % 4)"), F.lit("D"), F.when(size % 5 == 0, "D").otherwise(""), F.lit(")"),
        F.when(size % 3 == 0, "V").otherwise(
            F.concat(F.lit("[Lq/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(";"))
        ),
    )
    return v.table("part").select(F.col("p_partkey").alias("cls"), sig.alias("sig"))


@query(
    f"""WITH s AS ({_SIGNATURE}), t AS (
    SELECT cls, regexp_extract_all(regexp_extract(sig, '\\(([^)]*)\\)', 1), '(\\[*(?:[VZBSCIJFD]|L[^;]+;))', 1) AS p,
           split_part(sig, ')', 2) AS ret FROM s)
    SELECT cls, array_to_string(p, ' ') AS params, ret, CAST(len(p) AS BIGINT) AS n,
    CAST(len(p) + len(list_filter(p, lambda x: x IN ('J', 'D'))) AS BIGINT) AS slots,
    CAST(length(ret) - length(ltrim(ret, '[')) AS BIGINT) AS dims FROM t"""
)
def parse_signature(v):
    s = _signatures(v).withColumn("s", signatures.parse_signature(F.col("sig")))
    return s.select(
        "cls", F.array_join("s.params", " ").alias("params"), F.col("s.ret").alias("ret"),
        F.size("s.params").cast("long").alias("n"), F.col("s.slots").cast("long").alias("slots"),
        signatures.array_dims(F.col("s.ret")).cast("long").alias("dims"),
    )


@query(
    """WITH @v_class SELECT cls, CASE WHEN flags & 8192 <> 0 THEN 'annotation' WHEN flags & 16384 <> 0 THEN 'enum'
    WHEN flags & 512 <> 0 THEN 'interface' ELSE 'class' END AS kind FROM v_class"""
)
def class_kind(v):
    return v.v_class.select("cls", signatures.class_kind(F.col("flags")).alias("kind"))


_MODS = """concat_ws(' ', CASE WHEN flags & 1 <> 0 THEN 'public' END, CASE WHEN flags & 2 <> 0 THEN 'private' END,
    CASE WHEN flags & 4 <> 0 THEN 'protected' END, CASE WHEN flags & 8 <> 0 THEN 'static' END,
    CASE WHEN flags & 16 <> 0 THEN 'final' END, CASE WHEN flags & 1024 <> 0 THEN 'abstract' END{})"""
_MODS_FIELD = _MODS.format(
    ", CASE WHEN flags & 64 <> 0 THEN 'volatile' END, CASE WHEN flags & 128 <> 0 THEN 'transient' END"
)
_MODS_METHOD = _MODS.format(
    ", CASE WHEN flags & 32 <> 0 THEN 'synchronized' END, CASE WHEN flags & 256 <> 0 THEN 'native' END"
)


@query(
    f"""WITH @v_class SELECT cls, {_MODS.format('')} AS class_mods, {_MODS_FIELD} AS field_mods,
    {_MODS_METHOD} AS method_mods FROM v_class"""
)
def modifiers(v):
    def words(target):
        return F.array_join(signatures.modifiers(F.col("flags"), target), " ").alias(f"{target}_mods")

    return v.v_class.select("cls", words("class"), words("field"), words("method"))


@query(
    """WITH @v_class, m AS (SELECT cls, flags, CASE cls % 3 WHEN 0 THEN 'field' WHEN 1 THEN 'method' ELSE 'class' END AS kind FROM v_class)
    SELECT cls, kind, flags FROM m WHERE flags & 4096 = 0 AND NOT (kind = 'method' AND flags & 64 <> 0)"""
)
def drop_synthetic(v):
    k = F.col("cls") % 3
    kind = F.when(k == 0, "field").when(k == 1, "method").otherwise("class")
    return signatures.drop_synthetic(v.v_class.select("cls", kind.alias("kind"), "flags"))


@query(
    """WITH @v_doc, w AS (SELECT unit, unnest(regexp_extract_all(code, '[^ \\n]+')) AS word FROM v_doc)
    SELECT word, count(*) AS n FROM w
    WHERE length(word) <= 2 AND regexp_full_match(word, '[\\p{L}\\p{Nd}_$]+') GROUP BY word"""
)
def is_obfuscated(v):
    words = v.v_doc.select(F.explode(F.regexp_extract_all("code", F.lit("[^ \\n]+"), F.lit(0))).alias("word"))
    return words.filter(names.is_obfuscated(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_RESERVED = ", ".join(f"'{w}'" for w in names.RESERVED_WORDS)


@query(
    f"""WITH @v_doc, @v_class, c AS (
    SELECT CASE WHEN cls % 5 = 0 THEN '' WHEN cls % 5 = 1 THEN cls || name WHEN cls % 5 = 2 THEN 'new'
                WHEN cls % 5 = 3 THEN name || '-x' ELSE name END AS name FROM v_class
    UNION ALL SELECT unnest(string_split(code, ' ')) FROM v_doc)
    SELECT name, CASE WHEN name = '' THEN 'empty' WHEN NOT regexp_matches(name, '^[A-Za-z_]') THEN 'bad_start'
    WHEN NOT regexp_full_match(name, '[A-Za-z0-9_]+') THEN 'bad_char'
    WHEN name IN ({_RESERVED}) THEN 'reserved' END AS error, count(*) AS n FROM c GROUP BY 1, 2"""
)
def rename_error(v):
    k = F.col("cls") % 5
    made = (
        F.when(k == 0, "").when(k == 1, F.concat(F.col("cls").cast("string"), F.col("name")))
        .when(k == 2, "new").when(k == 3, F.concat("name", F.lit("-x"))).otherwise(F.col("name"))
    )
    words = v.v_doc.select(F.explode(F.split("code", " ")).alias("name"))
    candidates = v.v_class.select(made.alias("name")).unionByName(words)
    return candidates.groupBy("name", names.rename_error(F.col("name")).alias("error")).agg(
        F.count(F.lit(1)).alias("n")
    )


_SANITIZE = """CASE WHEN s IN ({r}) THEN s || 'Word' ELSE s END"""


@query(
    f"""WITH raw AS (SELECT p_partkey AS cls, CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN p_size || p_name WHEN 2 THEN 'class'
        WHEN 3 THEN p_brand ELSE p_name END AS n, lower(p_type) || '.' || p_brand || '.' || p_size || '.new' AS q FROM part),
    one AS (SELECT cls, n, q, CASE WHEN n = '' THEN '_' ELSE regexp_replace(n, '[^A-Za-z0-9_$]', '_', 'g') END AS a FROM raw),
    two AS (SELECT cls, q, CASE WHEN regexp_matches(a, '^[0-9]') THEN '_' || a ELSE a END AS s FROM one)
    SELECT cls, {_SANITIZE.format(r=_RESERVED)} AS identifier,
    array_to_string(list_transform(string_split(regexp_replace(q, '[^A-Za-z0-9_$.]', '_', 'g'), '.'),
      lambda s: CASE WHEN regexp_matches(s, '^[0-9]') THEN '_' || s WHEN s = 'new' THEN 'newWord' ELSE s END), '.') AS qualified FROM two"""
)
def sanitize_identifier(v):
    k = F.col("p_size") % 6
    size = F.col("p_size").cast("string")
    name = (
        F.when(k == 0, "").when(k == 1, F.concat(size, F.col("p_name"))).when(k == 2, "class")
        .when(k == 3, F.col("p_brand")).otherwise(F.col("p_name"))
    )
    qualified = F.concat_ws(".", F.lower("p_type"), "p_brand", size, F.lit("new"))
    return v.table("part").select(
        F.col("p_partkey").alias("cls"), names.sanitize_identifier(name).alias("identifier"),
        names.sanitize_qualified(qualified).alias("qualified"),
    )


_TYPES = "[0, 1, 2, 3, 4, 5, 6, 7, 8, 16, 17, 18, 28, 29, 30, 31, 40]"
_DATA = "CAST((p_partkey * 2654435 + p_size * 7919) % 4294967296 - 2147483648 AS INTEGER)"


@query(
    f"""WITH b AS (SELECT p_partkey AS cls, p_name, p_size, CAST(({_TYPES})[CAST(p_partkey % 17 AS INTEGER) + 1] AS INTEGER) AS t,
      CASE WHEN p_size = 1 THEN 0 WHEN p_size = 2 THEN 1 ELSE {_DATA} END AS d FROM part),
    u AS (SELECT *, CAST(CASE WHEN d < 0 THEN CAST(d AS BIGINT) + 4294967296 ELSE d END AS BIGINT) AS ud,
      CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'id/' || replace(p_name, ' ', '_')
           ELSE 'string/' || replace(p_name, ' ', '_') END AS ref,
      CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END AS str FROM b),
    e AS (SELECT *, printf('%x', ud) AS hx, (ud >> 23) & 255 AS ex, (ud & 8388607) / 8388608.0::DOUBLE AS ma,
      ([1.0::DOUBLE / 256, 1.0::DOUBLE / 32768, 1.0::DOUBLE / 8388608, 1.0::DOUBLE / 2147483648])[CAST((ud >> 4) & 3 AS INTEGER) + 1] AS rx FROM u),
    n AS (SELECT *, CASE
      WHEN t = 4 THEN CASE WHEN d < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN ex = 0 THEN pow(2.0::DOUBLE, -126) * ma
           WHEN ex = 255 THEN CASE WHEN ma = 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END
           ELSE pow(2.0::DOUBLE, CAST(ex AS INTEGER) - 127) * (1 + ma) END
      WHEN t = 5 THEN (ud >> 8) * rx WHEN t = 6 THEN (ud >> 8) * rx * 100 END AS num FROM e),
    f AS (SELECT *, CASE WHEN t NOT IN (4, 5, 6) OR isnan(num) OR isinf(num) OR abs(num) >= 9e13 OR num = floor(num) THEN NULL
          ELSE CAST(floor(abs(num) * 10000 + 0.5) AS BIGINT) END AS sc FROM n),
    g AS (SELECT *, CASE WHEN t NOT IN (4, 5, 6) THEN NULL
      WHEN isnan(num) THEN 'NaN' WHEN isinf(num) THEN CASE WHEN num < 0 THEN '-' ELSE '' END || '922337203685477.5807'
      WHEN num >= pow(2.0::DOUBLE, 63) THEN '9223372036854775807' WHEN num <= -pow(2.0::DOUBLE, 63) THEN '-9223372036854775808'
      WHEN num = floor(num) THEN CAST(CAST(num AS BIGINT) AS VARCHAR)
      ELSE CASE WHEN num < 0 AND sc <> 0 THEN '-' ELSE '' END || (sc // 10000) ||
           CASE WHEN sc % 10000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(sc % 10000 AS VARCHAR), 4, '0'), '0') END END AS txt FROM f)
    SELECT cls, t AS vtype, CASE
      WHEN t = 0 THEN CASE WHEN d = 1 THEN '@empty' ELSE '@null' END
      WHEN t IN (1, 7) THEN CASE WHEN ref LIKE 'id/%' THEN '@+' || ref WHEN ref IS NOT NULL THEN '@' || ref WHEN d = 0 THEN '@null' ELSE '@0x' || hx END
      WHEN t IN (2, 8) THEN '?' || coalesce(ref, '0x' || hx)
      WHEN t = 3 THEN coalesce(str, '')
      WHEN t = 4 THEN txt
      WHEN t = 5 THEN txt || coalesce((['px', 'dp', 'sp', 'pt', 'in', 'mm'])[CAST(ud & 15 AS INTEGER) + 1], '?d' || printf('%x', ud & 15))
      WHEN t = 6 THEN txt || coalesce((['%', '%p'])[CAST(ud & 15 AS INTEGER) + 1], '?f' || printf('%x', ud & 15))
      WHEN t = 16 THEN CAST(d AS VARCHAR)
      WHEN t = 18 THEN CASE WHEN d <> 0 THEN 'true' ELSE 'false' END
      WHEN t = 28 THEN '#' || printf('%08x', ud)
      WHEN t = 29 THEN '#' || printf('%06x', ud & 16777215)
      WHEN t = 30 THEN '#' || printf('%04x', ud & 65535)
      WHEN t = 31 THEN '#' || printf('%03x', ud & 4095)
      ELSE '0x' || hx END AS value FROM g"""
)
def format_value(v):
    kinds = F.array(*[F.lit(t) for t in (0, 1, 2, 3, 4, 5, 6, 7, 8, 16, 17, 18, 28, 29, 30, 31, 40)])
    size, key = F.col("p_size"), F.col("p_partkey")
    data = ((key * 2654435 + size * 7919) % 4294967296 - 2147483648).cast("int")
    word = F.replace("p_name", F.lit(" "), F.lit("_"))
    rows = v.table("part").select(
        key.alias("cls"), F.element_at(kinds, (key % 17 + 1).cast("int")).alias("vtype"),
        F.when(size == 1, 0).when(size == 2, 1).otherwise(data).alias("vdata"),
        F.when(size % 4 != 0, F.col("p_name")).alias("string"),
        F.when(size % 3 == 1, F.concat(F.lit("id/"), word)).when(size % 3 == 2, F.concat(F.lit("string/"), word)).alias("ref"),
    )
    shown = values.format_value(F.col("vtype"), F.col("vdata"), F.col("string"), F.col("ref"))
    return rows.select("cls", "vtype", shown.alias("value"))


@query(
    """WITH c AS (SELECT p_partkey AS cls, p_size % 3 * 100 AS mcc, p_size % 4 AS mnc,
      (['', 'en', 'de'])[CAST(p_partkey % 3 AS INTEGER) + 1] AS lang, (['', 'US'])[CAST(p_partkey % 2 AS INTEGER) + 1] AS region,
      p_size % 5 AS ori, ([0, 120, 160, 213, 240, 320, 480, 640, 65534, 65535, 400])[CAST(p_partkey % 11 AS INTEGER) + 1] AS den,
      CASE WHEN p_size > 20 THEN p_size ELSE 0 END AS sdk FROM part)
    SELECT cls, concat_ws('-', CASE WHEN mcc <> 0 THEN 'mcc' || mcc END, CASE WHEN mnc <> 0 THEN 'mnc' || mnc END,
      nullif(lang, ''), CASE WHEN lang <> '' AND region <> '' THEN 'r' || region END,
      CASE ori WHEN 1 THEN 'port' WHEN 2 THEN 'land' WHEN 3 THEN 'square' END,
      CASE den WHEN 0 THEN NULL WHEN 120 THEN 'ldpi' WHEN 160 THEN 'mdpi' WHEN 213 THEN 'tvdpi' WHEN 240 THEN 'hdpi'
        WHEN 320 THEN 'xhdpi' WHEN 480 THEN 'xxhdpi' WHEN 640 THEN 'xxxhdpi' WHEN 65534 THEN 'anydpi' WHEN 65535 THEN 'nodpi'
        ELSE den || 'dpi' END, CASE WHEN sdk <> 0 THEN 'v' || sdk END) AS qualifier FROM c"""
)
def config_qualifier(v):
    size, key = F.col("p_size"), F.col("p_partkey")

    def pick(options, n):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (key % n + 1).cast("int"))

    cfg = F.struct(
        (size % 3 * 100).alias("mcc"), (size % 4).alias("mnc"), pick(["", "en", "de"], 3).alias("lang"),
        pick(["", "US"], 2).alias("region"), (size % 5).alias("orientation"),
        pick([0, 120, 160, 213, 240, 320, 480, 640, 65534, 65535, 400], 11).alias("density"),
        F.when(size > 20, size).otherwise(0).alias("sdk"),
    )
    return v.table("part").select(key.alias("cls"), cfg.alias("cfg")).select(
        "cls", values.config_qualifier(F.col("cfg")).alias("qualifier")
    )


@query(
    """WITH t AS (SELECT page_id AS unit, html || chr(7) || chr(9) || chr(10) AS s FROM pages),
    x AS (SELECT unit, replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(7), '&#7;') AS a FROM t)
    SELECT unit, md5(a) AS as_text, md5(replace(replace(replace(replace(a, '"', '&quot;'), chr(10), '&#10;'), chr(13), '&#13;'), chr(9), '&#9;')) AS as_attr FROM x"""
)
def escape_markup(v):
    s = F.concat("html", F.lit("\x07\t\n"))
    return v.table("pages").select(
        F.col("page_id").alias("unit"), F.md5(text.escape_text(s)).alias("as_text"),
        F.md5(text.escape_attr(s)).alias("as_attr"),
    )


@query(
    """WITH @v_doc, r AS (SELECT unit, regexp_replace(code, '\\r\\n|\\r', chr(10), 'g') AS code FROM v_doc),
    l AS (SELECT unit, unnest(string_split(code, chr(10))) AS t, generate_subscripts(string_split(code, chr(10)), 1) AS line FROM r)
    SELECT unit, line, md5(regexp_replace(t, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS snippet FROM l"""
)
def explode_lines(v):
    lines = search.explode_lines(v.v_doc.select("unit", "code"))
    return lines.select("unit", F.col("line").cast("long").alias("line"), F.md5("snippet").alias("snippet"))


@query(
    """WITH @v_doc SELECT unit, n // 2 AS off, 1 + length(substr(code, 1, n // 2)) - length(replace(substr(code, 1, n // 2), chr(10), '')) AS line FROM v_doc"""
)
def line_of_offset(v):
    half = F.floor(F.col("n") / 2).cast("long")
    return v.v_doc.select(
        "unit", half.alias("off"), text.line_of(F.col("code"), half).cast("long").alias("line")
    )


@query(
    """WITH @v_doc SELECT unit,
    CAST((length(code) - length(replace(code, 'an', ''))) // 2 AS BIGINT) AS n_an,
    CAST(coalesce(list_sum([(length(m) - 1) // 2 for m in regexp_extract_all(code, 'a(?:na)+')]), 0) AS BIGINT) AS n_ana,
    CAST(coalesce(list_sum([length(m) - 1 for m in regexp_extract_all(code, 'ee+')]), 0) AS BIGINT) AS n_ee FROM v_doc"""
)
def occurrences(v):
    code = F.col("code")

    def count(needle):
        return text.occurrences(code, needle).cast("long").alias(f"n_{needle}")

    return v.v_doc.select("unit", count("an"), count("ana"), count("ee"))


@query(
    """SELECT cls, CASE WHEN a = b THEN 'equal' WHEN a & b = 0 THEN 'conflict' WHEN a & b = a THEN 'narrower'
    WHEN a & b = b THEN 'wider' ELSE 'unrelated' END AS relation
    FROM (SELECT p_partkey AS cls, p_size % 2048 AS a, p_partkey % 2048 AS b FROM part)"""
)
def mask_relation(v):
    a, b = F.col("p_size").cast("long") % 2048, F.col("p_partkey") % 2048
    return v.table("part").select(F.col("p_partkey").alias("cls"), masks.mask_relation(a, b).alias("relation"))


@query(
    """WITH m AS (SELECT page_id AS unit, '<manifest xmlns="x" package="' ||
        CASE WHEN page_id % 4 = 0 THEN '' ELSE 'com.' || regexp_extract(html, 'lang="([a-z]+)"', 1) END || '">' AS head,
      CASE page_id % 3 WHEN 0 THEN '.' || 'Main' || page_id WHEN 1 THEN 'Main' || page_id ELSE 'org.x.Main' || page_id END AS act, html FROM pages),
    p AS (SELECT unit, nullif(regexp_extract(head, 'package="([^"]*)"', 1), '') AS package, act, unit % 5 <> 0 AS has_app, unit % 7 <> 0 AS launches FROM m),
    q AS (SELECT unit, package, has_app, launches, CASE WHEN act LIKE '.%' THEN coalesce(package, '') || act
      WHEN position('.' IN act) = 0 AND package IS NOT NULL THEN package || '.' || act ELSE act END AS full_act FROM p)
    SELECT unit, package, CASE WHEN launches THEN full_act END AS launcher,
    CASE WHEN has_app THEN CASE WHEN package IS NULL THEN 'App' ELSE package || '.App' END END AS application FROM q"""
)
def manifest_components(v):
    k = F.col("page_id")
    pkg = F.when(k % 4 == 0, "").otherwise(
        F.concat(F.lit("com."), F.regexp_extract("html", 'lang="([a-z]+)"', 1))
    )
    main = F.concat(
        F.when(k % 3 == 0, ".Main").when(k % 3 == 1, "Main").otherwise("org.x.Main"), k.cast("string")
    )
    manifest = F.concat(
        F.lit('<manifest xmlns="x" package="'), pkg, F.lit('"><application '),
        F.when(k % 5 != 0, 'android:name="App" ').otherwise(""), F.lit("><activity-alias android:name=\""), main,
        F.lit('"><intent-filter>'), F.regexp_replace("html", "<[^>]*>", " "),
        F.when(k % 7 != 0, "android.intent.category.LAUNCHER").otherwise("none"), F.lit("</intent-filter></activity-alias>"),
    )
    docs = v.table("pages").select(k.alias("unit"), manifest.alias("xml"))
    return shapes.manifest_components(docs, "xml").drop("xml")


@query(
    """WITH @v_class, p AS (SELECT DISTINCT "full" AS path, string_split("full", '.') AS parts FROM v_class),
    e AS (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS depth FROM p)
    SELECT path, array_to_string(list_slice(parts, 1, depth), '.') AS ancestor, depth FROM e"""
)
def explode_ancestors(v):
    paths = v.v_class.select(F.col("full").alias("path")).distinct()
    return shapes.explode_ancestors(paths, "path").withColumn("depth", F.col("depth").cast("long"))


_TOKEN_SQL = """//[^\\n]*|/\\*[\\s\\S]*?(?:\\*/|\\z)|"(?:[^"\\\\\\n]|\\\\[\\s\\S])*"?|''(?:[^''\\\\\\n]|\\\\[\\s\\S])*''?|@[\\p{L}_$][\\p{L}\\p{Nd}_$]*|\\.?\\p{Nd}(?:[eE][+-]|[\\p{L}\\p{Nd}_$.])*|[\\p{L}_$][\\p{L}\\p{Nd}_$]*|[^ \\t\\r\\n]"""


@query(
    f"""WITH @v_doc, t AS (SELECT unit, unnest(regexp_extract_all(code, '{_TOKEN_SQL}')) AS t FROM v_doc)
    SELECT unit, CASE WHEN t LIKE '//%' OR (t LIKE '/*%') THEN 'comment' WHEN t LIKE '"%' OR t LIKE '''%' THEN 'string'
      WHEN regexp_matches(t, '^@[\\p{{L}}_$]') THEN 'annotation' WHEN regexp_matches(t, '^\\.?\\p{{Nd}}') THEN 'number'
      WHEN t <> '_' AND t IN ({_RESERVED}) THEN 'keyword' WHEN regexp_matches(t, '^[\\p{{L}}_$]') THEN 'identifier'
      ELSE 'punctuation' END AS kind, count(*) AS n FROM t GROUP BY 1, 2"""
)
def token_profile(v):
    return shapes.token_profile(v.v_doc.select("unit", "code"))
