"""Streams run to their end over the given files, and user-defined functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.catalog.registry import query
from symloom.operators import plugins
from symloom.session import scratch_folder, stage
from symloom.streaming import flows

BATCHES = 3


def in_batches(v, folder, run):
    """``run(stream)`` over a folder to which a third of the documents is added before each run.

    Every run starts the stream anew from its checkpoint, as after a stop.
    """
    docs = v.table("documents")
    for b in range(BATCHES):
        docs.filter(F.col("doc_id") % BATCHES == b).write.mode("append").parquet(f"{folder}/in")
        run(v.spark.readStream.schema(docs.schema).parquet(f"{folder}/in"))


def scratch(v):
    """A new folder on the storage the cluster names for checkpoints."""
    return scratch_folder(v.spark, "flow")


@query(
    """WITH @v_doc, r AS (SELECT unit, regexp_replace(code, '\\r\\n|\\r', chr(10), 'g') AS code FROM v_doc),
    l AS (SELECT unit, unnest(string_split(code, chr(10))) AS t, generate_subscripts(string_split(code, chr(10)), 1) AS line FROM r)
    SELECT unit, line, md5(regexp_replace(t, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS snippet FROM l WHERE contains(lower(t), 'tion th')"""
)
def stream_search(v):
    folder = scratch(v)

    def run(docs):
        units = docs.select(F.col("doc_id").alias("unit"), F.col("text").alias("code"))
        flows.stream_search(units, "tion th", folder, f"{folder}/checkpoint").awaitTermination()

    in_batches(v, folder, run)
    found = v.spark.read.parquet(f"{folder}/matches")
    return found.select("unit", F.col("line").cast("long").alias("line"), F.md5("snippet").alias("snippet"))


@query(
    """WITH g AS (SELECT text, arg_min(doc_id, doc_id % 3 * 1000000000000 + doc_id) AS doc_id, count(*) - 1 AS dropped FROM documents GROUP BY text)
    SELECT doc_id, md5(text) AS text, (SELECT CAST(sum(dropped) AS BIGINT) FROM g) AS dropped FROM g"""
)
def stream_first_wins(v):
    """A copy that arrives in an earlier batch stays, and in one batch the one with the smallest id."""
    folder = scratch(v)

    def run(docs):
        rows = docs.select("doc_id", "text", "lang")
        flows.stream_first_wins(rows, ["text"], ["doc_id"], folder, f"{folder}/checkpoint").awaitTermination()

    in_batches(v, folder, run)
    dropped = v.spark.read.parquet(f"{folder}/dropped").agg(F.sum("dropped").alias("dropped"))
    return v.spark.read.parquet(f"{folder}/rows").select("doc_id", F.md5("text").alias("text"), dropped.scalar().alias("dropped"))


@query(
    """WITH @v_judged SELECT category, verdict, count(*) AS n, count(*) FILTER (WHERE evidenced) AS evidenced FROM v_judged GROUP BY 1, 2"""
)
def stream_scoreboard(v):
    """Documents arrive as a stream and meet the stored scores of their sample."""
    folder = scratch(v)
    scores = stage(v.v_sig, "scores")

    def put(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/board")

    def run(docs):
        board = flows.stream_scoreboard(docs.select(F.col("doc_id").alias("sample")).join(scores, "sample"))
        (
            board.writeStream.outputMode("complete").foreachBatch(put)
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        )

    in_batches(v, folder, run)
    return v.spark.read.parquet(f"{folder}/board")


@query(
    """SELECT doc_id AS path, CASE WHEN contains(text, '|') THEN 'table' WHEN lang <> 'en' THEN 'foreign' ELSE 'plain' END AS reader FROM documents
    WHERE contains(text, '|') OR lang <> 'en' OR n_chars > 100"""
)
def input_readers(v):
    """Three readers in order; an input none of them takes is not loaded."""
    readers = plugins.Readers()
    readers.register_reader("table", lambda files: files.filter(F.contains(F.col("text"), F.lit("|"))))
    readers.register_reader("foreign", lambda files: files.filter("lang <> 'en'"))
    readers.register_reader("plain", lambda files: files.filter("n_chars > 100"))
    files = v.table("documents").withColumnRenamed("doc_id", "path")
    return readers.load(files).select("path", "reader")


@query(
    """SELECT user_id AS method_key, count(*) AS n, max(CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT)) AS top FROM events GROUP BY 1"""
)
def map_methods(v):
    """A user function per method, after a whole-program transform."""
    rows = v.table("events").select(
        F.col("user_id").alias("method_key"), F.get_json_object("props", "$.k").cast("long").alias("k")
    )

    def summary(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"method_key": [group["method_key"].iloc[0]], "n": [len(group)], "top": [group["k"].max()]})

    whole = plugins.transform_app(rows, lambda df: df.filter("k IS NOT NULL"))
    return plugins.map_methods(whole, summary, "method_key long, n long, top long")


@query("""SELECT 'app' || (p_size % 2) AS app_id, p_brand AS cls, count(*) AS n, min(p_name) AS first FROM part GROUP BY 1, 2""")
def map_classes(v):
    """A user function per class of an app; brands occur in both apps."""
    rows = v.table("part").select(
        F.concat(F.lit("app"), (F.col("p_size") % 2).cast("string")).alias("app_id"), F.col("p_brand").alias("cls"), "p_name"
    )

    def summary(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"app_id": [group["app_id"].iloc[0]], "cls": [group["cls"].iloc[0]], "n": [len(group)], "first": [group["p_name"].min()]})

    return plugins.map_classes(rows, summary, "app_id string, cls string, n long, first string")


@query(
    """SELECT user_id, CASE WHEN user_id % 10 <> 0 THEN count(*) END AS n, CASE WHEN user_id % 10 = 0 THEN 'ValueError: bad user ' || user_id END AS error
    FROM events GROUP BY user_id"""
)
def guarded_apply(v):
    """Every tenth user makes the function fail; the others are not touched by that."""
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("n", T.LongType())])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        user = int(group["user_id"].iloc[0])
        if user % 10 == 0:
            raise ValueError(f"bad user {user}")
        return pd.DataFrame({"user_id": [user], "n": [len(group)]})

    return plugins.guarded_apply(v.table("events").select("user_id"), ["user_id"], count, schema)


