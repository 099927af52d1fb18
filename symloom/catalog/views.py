"""The given tables read as a code corpus, once for Spark and once as SQL.

Every view covers the whole of its tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

THREE_DAYS = 3 * 86400


def floordiv(c: Column, n: int) -> Column:
    return F.floor(c / n).cast("long")


class Views:
    """Lazy views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def v_class(self) -> DataFrame:
        """Parts as classes: ``super`` makes a tree, ``itf`` one more edge; full names repeat."""
        k = F.col("p_partkey")
        pkg = F.concat(F.lower("p_type"), F.lit("."), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
        return self.table("part").select(
            k.alias("cls"),
            F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"),
            pkg.alias("pkg"),
            F.concat(pkg, F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("full"),
            (k * 37 % 65536).cast("int").alias("flags"),
            F.when(k > 0, floordiv(k - 1, 3)).alias("super"),
            F.when(k >= 10, floordiv(k, 10)).alias("itf"),
            k.alias("ord"),
        )

    @cached_property
    def v_ref(self) -> DataFrame:
        """Line items as references of a unit (order) to a target (part)."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("off"),
            F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("member"),
            F.col("l_returnflag").alias("kind"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"),
            F.col("l_quantity").cast("long").alias("qty"), F.col("l_shipdate").alias("shipped"),
        )

    @cached_property
    def v_doc(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("unit"), F.col("text").alias("code"), F.col("lang").alias("cat"),
            F.col("source").alias("scope"), F.col("n_chars").alias("n"), F.col("doc_id").alias("ord"),
        )

    @cached_property
    def v_sig(self) -> DataFrame:
        """Labelled documents as samples scored for two systems."""
        both = self.table("labels").join(self.table("documents"), "doc_id")
        d = F.col("doc_id")
        skipped = d % 3 == 0
        none = F.lit(None).cast("boolean")
        steady = d % 7 > 1
        ref = F.struct(
            (F.col("quality") == 1).alias("no_error"),
            ((F.col("toxic") == 0) & steady).alias("recompiles"),
            F.when(skipped, none).otherwise(d % 2 == 0).alias("exec"),
        )
        cand = F.struct(
            (F.col("n_chars") < 2000).alias("no_error"),
            (~F.contains(F.col("text"), F.lit("|")) & steady).alias("recompiles"),
            F.when(skipped, none).otherwise(d % 5 != 0).alias("exec"),
        )
        return both.select(d.alias("sample"), F.col("lang").alias("category"), ref.alias("ref"), cand.alias("cand"))

    @cached_property
    def v_step(self) -> DataFrame:
        """Events in order per user: ``at`` is the position in microseconds, ``idx`` the number."""
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").select(
            F.col("user_id").alias("method"), F.row_number().over(w).cast("long").alias("idx"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"),
            F.col("event_type").alias("op"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @cached_property
    def v_flow(self) -> DataFrame:
        """Events as the steps of small methods: one per user and three days."""
        day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / THREE_DAYS).cast("long")
        method = F.col("user_id") * 10000 + day
        base = self.table("events").select(
            method.alias("method_key"), "ts", "event_id", F.col("event_type").alias("op"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )
        w = Window.partitionBy("method_key").orderBy("ts", "event_id")
        return base.select(
            "method_key", F.row_number().over(w).cast("long").alias("idx"), "op", "k",
            F.lead("op").over(w).alias("next_op"),
        )

    @cached_property
    def v_edge(self) -> DataFrame:
        return self.v_flow.filter(F.col("next_op").isNotNull()).select(
            "method_key", F.col("op").alias("src"), F.col("next_op").alias("dst"),
            (F.col("next_op") == "error").alias("exceptional"),
        ).distinct()

    @cached_property
    def v_entry_block(self) -> DataFrame:
        return self.v_flow.filter(F.col("idx") == 1).select("method_key", F.col("op").alias("block"))

    @cached_property
    def v_call(self) -> DataFrame:
        """Orders as methods: each calls one of smaller number, urgent ones another one anywhere.

        Holds cycles, and callees that are no order.
        """
        o = F.col("o_orderkey")
        near = self.table("orders").select(o.alias("caller"), floordiv(o - 1, 3).alias("callee"))
        far = self.table("orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
            o.alias("caller"), (F.col("o_custkey") * 11).alias("callee")
        )
        return near.unionByName(far)

    @cached_property
    def v_range(self) -> DataFrame:
        """Orders as 30-day ranges (days since the epoch) of their customer."""
        day = F.unix_date(F.to_date("o_orderdate")).cast("long")
        return self.table("orders").select(
            F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"), day.alias("s"), (day + 30).alias("e")
        )

    @cached_property
    def v_edit(self) -> DataFrame:
        e = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("seq"), F.col("user_id").alias("sym"),
            F.when(e == "error", "").otherwise(F.concat(F.lit(" "), e)).alias("text"),
        )

    @cached_property
    def v_res(self) -> DataFrame:
        """Customers as resource rows of three apps; ids repeat within and across apps."""
        joined = self.table("customer").join(
            self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        slot = F.col("c_custkey") % 50
        return joined.select(
            F.concat(F.lit("app"), (F.col("c_custkey") % 3).cast("string")).alias("app_id"),
            (F.lit(2130706432) + F.col("c_nationkey") * 65536 + slot).cast("int").alias("id"),
            F.lower("n_name").alias("type"),
            F.concat(F.lit("e"), slot.cast("string"), F.lit("_"), (F.col("c_custkey") % 3).cast("string")).alias("name"),
            F.col("c_mktsegment").alias("config"),
            F.round(F.col("c_acctbal") * 100).cast("int").alias("cents"),
            F.col("c_custkey").alias("ord"),
        )

    @cached_property
    def v_entry(self) -> DataFrame:
        """Pages as archive entries."""
        return self.table("pages").select(
            F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("archive"),
            F.col("page_id").alias("pos"),
            F.regexp_extract("url", "^[a-z]+://[^/]+(.*)$", 1).alias("name"),
            F.length("html").cast("long").alias("usize"),
        )


# name -> (views it needs, SQL)
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_class": (
        (),
        """SELECT cls, name, pkg, pkg || '.' || name AS "full", flags, super, itf, cls AS ord FROM (
        SELECT p_partkey AS cls, replace(p_name, ' ', '_') AS name,
               lower(p_type) || '.' || lower(replace(p_brand, '#', '')) AS pkg,
               CAST((p_partkey * 37) % 65536 AS INTEGER) AS flags,
               CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 3 END AS super,
               CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS itf
        FROM part)""",
    ),
    "v_ref": (
        (),
        """SELECT l_orderkey AS unit, l_linenumber AS off, l_partkey AS target, l_suppkey AS member,
        l_returnflag AS kind, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
        CAST(l_quantity AS BIGINT) AS qty, l_shipdate AS shipped FROM lineitem""",
    ),
    "v_doc": (
        (),
        """SELECT doc_id AS unit, text AS code, lang AS cat, source AS scope, n_chars AS n, doc_id AS ord
        FROM documents""",
    ),
    "v_sig": (
        (),
        """SELECT d.doc_id AS sample, lang AS category,
        quality = 1 AS r_no, toxic = 0 AND d.doc_id % 7 > 1 AS r_re,
        CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.doc_id % 2 = 0 END AS r_ex,
        n_chars < 2000 AS c_no, position('|' IN text) = 0 AND d.doc_id % 7 > 1 AS c_re,
        CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.doc_id % 5 <> 0 END AS c_ex
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    ),
    "v_judged": (
        ("v_sig",),
        """SELECT *, concat_ws(',', CASE WHEN r_no AND NOT c_no THEN 'no-error' END,
                     CASE WHEN r_re AND NOT c_re THEN 'recompiles' END,
                     CASE WHEN r_ex AND NOT c_ex THEN 'exec-check' END) AS regressed,
        concat_ws(',', CASE WHEN c_no AND NOT r_no THEN 'no-error' END,
                     CASE WHEN c_re AND NOT r_re THEN 'recompiles' END,
                     CASE WHEN c_ex AND NOT r_ex THEN 'exec-check' END) AS improved,
        (r_no AND c_no) OR (r_re AND c_re) OR coalesce(r_ex AND c_ex, FALSE) AS evidenced,
        CASE WHEN (r_no AND NOT c_no) OR (r_re AND NOT c_re) OR coalesce(r_ex AND NOT c_ex, FALSE) THEN 'REGRESSION'
             WHEN (c_no AND NOT r_no) OR (c_re AND NOT r_re) OR coalesce(c_ex AND NOT r_ex, FALSE) THEN 'IMPROVEMENT'
             ELSE 'PARITY' END AS verdict FROM v_sig""",
    ),
    "v_step": (
        (),
        """SELECT user_id AS method, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx,
        epoch_us(ts) AS at, event_id AS id, event_type AS op,
        CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events""",
    ),
    "v_flow": (
        (),
        """SELECT method_key, row_number() OVER w AS idx, op, k, lead(op) OVER w AS next_op FROM (
        SELECT user_id * 10000 + epoch_us(ts) // 259200000000 AS method_key, ts, event_id, event_type AS op,
        CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events)
        WINDOW w AS (PARTITION BY method_key ORDER BY ts, event_id)""",
    ),
    "v_edge": (
        ("v_flow",),
        """SELECT DISTINCT method_key, op AS src, next_op AS dst, next_op = 'error' AS exceptional
        FROM v_flow WHERE next_op IS NOT NULL""",
    ),
    "v_entry_block": (("v_flow",), "SELECT method_key, op AS block FROM v_flow WHERE idx = 1"),
    "v_call": (
        (),
        """SELECT o_orderkey AS caller, CAST(floor((o_orderkey - 1) / 3) AS BIGINT) AS callee FROM orders
        UNION ALL
        SELECT o_orderkey, o_custkey * 11 FROM orders WHERE o_orderpriority = '1-URGENT'""",
    ),
    "v_range": (
        (),
        """SELECT o_custkey AS grp, o_orderkey AS id,
        CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s,
        CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 30 AS e FROM orders""",
    ),
    "v_edit": (
        (),
        """SELECT event_id AS seq, user_id AS sym,
        CASE WHEN event_type = 'error' THEN '' ELSE ' ' || event_type END AS text FROM events""",
    ),
    "v_res": (
        (),
        """SELECT 'app' || (c_custkey % 3) AS app_id, CAST(2130706432 + c_nationkey * 65536 + c_custkey % 50 AS INTEGER) AS id,
        lower(n_name) AS type, 'e' || (c_custkey % 50) || '_' || (c_custkey % 3) AS name, c_mktsegment AS config,
        CAST(round(c_acctbal * 100) AS INTEGER) AS cents, c_custkey AS ord
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "v_entry": (
        (),
        """SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS archive, page_id AS pos,
        regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1) AS name, length(html) AS usize FROM pages""",
    ),
}
