"""Differential scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from symloom.catalog.registry import query
from symloom.operators import scoring


def judged(v):
    return scoring.judge(v.v_sig)


_ALLOW_SQL = """allow AS (SELECT doc_id AS sample, CASE WHEN doc_id % 2 = 0 THEN 'no-error' ELSE 'no-error,exec-check' END AS signals
    FROM labels WHERE toxic = 0),
    final AS (SELECT j.*, CASE WHEN verdict = 'REGRESSION' AND a.signals = regressed THEN 'EXPECTED_DIVERGENCE' ELSE verdict END AS final_verdict
      FROM v_judged j LEFT JOIN allow a ON a.sample = j.sample)"""


def allowlist(v):
    d = F.col("doc_id")
    some = F.when(d % 2 == 0, F.array(F.lit("no-error"))).otherwise(F.array(F.lit("exec-check"), F.lit("no-error")))
    return v.table("labels").filter("toxic = 0").select(d.alias("sample"), some.alias("signals"))


def allowed(v):
    return scoring.apply_allowlist(judged(v), allowlist(v))


@query("WITH @v_judged SELECT sample, regressed, improved, evidenced, verdict FROM v_judged")
def verdicts(v):
    return judged(v).select(
        "sample", F.array_join("regressed", ",").alias("regressed"), F.array_join("improved", ",").alias("improved"),
        "evidenced", "verdict",
    )


@query(f"WITH @v_judged, {_ALLOW_SQL} SELECT sample, final_verdict AS verdict FROM final")
def apply_allowlist(v):
    return allowed(v).select("sample", "verdict")


@query(
    f"""WITH @v_judged, {_ALLOW_SQL} SELECT a.sample, a.signals FROM allow a JOIN v_judged j ON j.sample = a.sample
    WHERE len(list_filter(string_split(a.signals, ','), lambda s: NOT list_contains(string_split(j.regressed, ','), s))) > 0"""
)
def stale_entries(v):
    found = scoring.stale_entries(judged(v), allowlist(v))
    return found.select("sample", F.concat_ws(",", F.reverse(F.array_sort("signals"))).alias("signals"))


@query(
    f"""WITH @v_judged, {_ALLOW_SQL} SELECT category, count(*) AS samples,
    count(*) FILTER (WHERE final_verdict = 'PARITY' AND evidenced) AS evidenced_parity,
    count(*) FILTER (WHERE final_verdict = 'PARITY' AND NOT evidenced) AS tied_parity,
    count(*) FILTER (WHERE final_verdict = 'EXPECTED_DIVERGENCE') AS expected_divergence,
    count(*) FILTER (WHERE final_verdict = 'IMPROVEMENT') AS improvement,
    count(*) FILTER (WHERE final_verdict = 'REGRESSION') AS regression FROM final GROUP BY category"""
)
def scoreboard(v):
    return scoring.scoreboard(allowed(v))


@query(
    f"""WITH @v_judged, {_ALLOW_SQL} SELECT category, count(*) FILTER (WHERE final_verdict = 'EXPECTED_DIVERGENCE') AS "EXPECTED_DIVERGENCE",
    count(*) FILTER (WHERE final_verdict = 'IMPROVEMENT') AS "IMPROVEMENT", count(*) FILTER (WHERE final_verdict = 'PARITY') AS "PARITY",
    count(*) FILTER (WHERE final_verdict = 'REGRESSION') AS "REGRESSION" FROM final GROUP BY category"""
)
def verdict_table(v):
    return scoring.verdict_table(allowed(v))


@query(
    f"""WITH @v_judged, {_ALLOW_SQL} SELECT count(*) FILTER (WHERE final_verdict = 'REGRESSION') = 0 AS passes,
    count(*) FILTER (WHERE final_verdict = 'REGRESSION') AS regressions FROM final"""
)
def gate(v):
    return scoring.gate(allowed(v))


@query(
    """WITH @v_sig SELECT 'no-error' AS signal, count(*) FILTER (WHERE r_no) AS passed, count(r_no) AS evaluated FROM v_sig
    UNION ALL SELECT 'recompiles', count(*) FILTER (WHERE r_re), count(r_re) FROM v_sig
    UNION ALL SELECT 'exec-check', count(*) FILTER (WHERE r_ex), count(r_ex) FROM v_sig"""
)
def signal_pass_counts(v):
    return scoring.signal_pass_counts(v.v_sig)


@query(
    """WITH s AS (SELECT doc_id AS sample, quality, toxic FROM labels),
    c AS (SELECT doc_id AS sample, n_chars FROM documents WHERE doc_id % 5 <> 0)
    SELECT s.sample, 'paired' AS what, c.sample IS NOT NULL AND n_chars < 2000 AS cand_no_error FROM s LEFT JOIN c ON c.sample = s.sample WHERE toxic = 0
    UNION ALL SELECT sample, 'excluded', NULL FROM s WHERE toxic <> 0"""
)
def pair_scores(v):
    """Labels as the reference run, documents as the candidate run with gaps."""
    def score(ok):
        return F.struct(ok.alias("no_error"), ok.alias("recompiles"), F.lit(None).cast("boolean").alias("exec"))

    d = F.col("doc_id")
    reference = v.table("labels").select(
        d.alias("sample"), F.lit("c").alias("category"), (F.col("toxic") != 0).alias("failed"), score(F.col("quality") == 1).alias("score")
    )
    candidate = v.table("documents").select(
        d.alias("sample"), (d % 5 == 0).alias("failed"), score(F.col("n_chars") < 2000).alias("score")
    )
    paired, excluded = scoring.pair_scores(reference, candidate)
    return paired.select("sample", F.lit("paired").alias("what"), F.col("cand.no_error").alias("cand_no_error")).unionByName(
        excluded.select("sample", F.lit("excluded").alias("what"), F.lit(None).cast("boolean").alias("cand_no_error"))
    )


@query(
    """SELECT source || '/' || lang AS sample, sum(CASE WHEN n_chars > 9000 THEN 1 ELSE 0 END) = 0 AND NOT bool_or(contains(text, 'ring the tion') OR contains(text, 'password')) AS no_error
    FROM documents GROUP BY 1"""
)
def no_error_signal(v):
    units = v.table("documents").select(
        F.concat_ws("/", "source", "lang").alias("sample"), F.col("text").alias("code"),
        F.when(F.col("n_chars") > 9000, 1).otherwise(0).alias("error_count"),
    )
    return scoring.no_error_signal(units, ["ring the tion", "password"])


@query(
    """WITH @v_doc, n AS (SELECT unit, code, (length(code) - length(replace(code, 'the', ''))) // 3 AS the,
      (length(code) - length(replace(code, 'der', ''))) // 3 AS der, (length(code) - length(replace(code, '    def ', ''))) // 8 AS ind FROM v_doc)
    SELECT unit, the > 0 AS has_the, the = 1 AS one_the, the = 0 AS no_the, the + der = 1 AS one_of, ind = 1 AS one_line FROM n"""
)
def check_assertions(v):
    checks = {
        "has_the": {"needle": "the"},
        "one_the": {"needle": "the", "times": 1},
        "no_the": {"needle": "the", "times": 0},
        "one_of": {"needles": ["the", "der"], "times": 1},
        "one_line": {"needle": "def ", "indent": 1, "times": 1},
    }
    return scoring.check_assertions(v.v_doc.select("unit", "code"), checks)


@query(
    """WITH s AS (SELECT substr(o_orderpriority, 1, 1) AS p, o_orderstatus = 'P' AS flagged FROM orders)
    SELECT count(*) FILTER (WHERE p = '1') AS clean, count(*) FILTER (WHERE p = '2') AS warnings, count(*) FILTER (WHERE p = '3') AS errors,
    count(*) FILTER (WHERE p = '4') AS no_output, count(*) FILTER (WHERE p = '5') AS unavailable,
    count(*) FILTER (WHERE p IN ('1', '2')) AS passed, count(*) FILTER (WHERE p <> '5') AS measured,
    count(*) FILTER (WHERE p IN ('1', '2') AND NOT flagged) AS evidenced FROM s"""
)
def compile_tally(v):
    p = F.substring("o_orderpriority", 1, 1)
    status = (
        F.when(p == "1", "clean").when(p == "2", "warnings").when(p == "3", "errors")
        .when(p == "4", "no_output").otherwise("unavailable")
    )
    return scoring.compile_tally(
        v.table("orders").select(F.col("o_orderkey").alias("sample"), status.alias("status"), (F.col("o_orderstatus") == "P").alias("flagged"))
    )


