"""The incremental behaviours: search, first-wins ingest and a running scoreboard."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from symloom.operators.scoring import judge
from symloom.operators.search import explode_lines, matcher


def search_rows(units: DataFrame, query: str, ignore_case: bool = True, regex: bool = False) -> DataFrame:
    """Matching lines of a stream of units(unit, code); stateless, a unit is searched when it arrives."""
    pattern = matcher(units, query, ignore_case, regex)
    if pattern is None:
        return explode_lines(units.filter(F.lit(False)))
    return explode_lines(units).filter(F.col("text").rlike(pattern))


def stream_search(
    units: DataFrame, query: str, target: str, checkpoint: str, ignore_case: bool = True, regex: bool = False
) -> StreamingQuery:
    """Write the matches of each batch to ``target/matches`` and its counts to ``target/counts``.

    Units without code are counted as failed.  A batch that is run again overwrites its own folder.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        found = search_rows(batch, query, ignore_case, regex).select("unit", "line", "snippet")
        found.write.mode("overwrite").parquet(f"{target}/matches/batch={batch_id}")
        batch.agg(
            F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("code").isNull()).alias("failed")
        ).write.mode("overwrite").parquet(f"{target}/counts/batch={batch_id}")

    return (
        units.writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pc.unique(batch.column(0))], names=["key_digest"])


def stream_first_wins(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], target: str, checkpoint: str
) -> StreamingQuery:
    """Insert-if-absent: a key seen in an earlier batch, or earlier in the same batch, stays.

    Kept rows go to ``target/rows`` with a digest of their key, the number of dropped rows to ``target/dropped``, a folder
    a batch; a batch that is run again overwrites its own folder.  Keyed state of the stream (in ``checkpoint``) holds the digests
    that have been seen, so a batch looks up its own keys and reads nothing that earlier batches wrote.  A batch is its rows and
    a mark for each key that the state did not know; rows are combined per task before they are shuffled, keys per Arrow batch.
    Nulls are values of their own: null keys are equal to each other, a null in ``order`` comes first.  Of rows that are equal in
    keys and order any one is kept.  A batch is looked at twice, so the columns of ``stream`` must not differ between two readings.
    """
    keys, order = list(keys), list(order)
    digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256).alias("key_digest")
    # one source serves both: the rows of a batch and its keys are those of the same files
    rows = stream.select(digest, F.struct("*").alias("row"))
    unseen = stream.select(digest).mapInArrow(_distinct, "key_digest string").dropDuplicates(["key_digest"])
    decided = rows.unionByName(unseen, allowMissingColumns=True)
    came = F.col("row").isNotNull()

    def put(batch: DataFrame, batch_id: int) -> None:
        firsts = batch.groupBy("key_digest").agg(
            F.min_by("row", F.when(came, F.struct(*[F.col("row")[c] for c in order]))).alias("row"),
            F.count_if(came).alias("seen"), F.bool_or(~came).alias("fresh"),
        )
        # the state is asked once a batch; the folder is overwritten by the next one
        kept = F.when(F.col("fresh"), F.col("row")).alias("row")
        found = firsts.select("key_digest", kept, (F.col("seen") - F.col("fresh").cast("long")).alias("dropped"))
        found.write.mode("overwrite").parquet(f"{target}/decided")
        found = batch.sparkSession.read.schema(found.schema).parquet(f"{target}/decided")
        found.filter("row IS NOT NULL").select("row.*", "key_digest").write.mode("overwrite").parquet(f"{target}/rows/batch={batch_id}")
        found.agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped")).write.mode("overwrite").parquet(f"{target}/dropped/batch={batch_id}")

    return (
        decided.writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_scoreboard(stream: DataFrame) -> DataFrame:
    """Streaming (category, verdict, n, evidenced) of paired scores; run it in update or complete mode.

    State is one row per category and verdict.
    """
    judged = judge(stream)
    return judged.groupBy("category", "verdict").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("evidenced")).alias("evidenced")
    )
