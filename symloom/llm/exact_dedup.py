"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition makes one sorted run of digests.  Runs are then exchanged in binomial rounds: in a
round the nodes whose numbers differ in that round's bits form a group, and each member takes over the part
of the digest space that its own bits name, from all members.  A node merges the runs that reach it and keeps
one row per text: the winning identifier and the number of rows.  After the last round each node holds the
finished part of the digest space that its number names, so there is no single root.  A text that makes up a
third of all rows is one row per run from the first merge on.  Outcomes go back to the runs, and from a run to
its rows, so no join brings the rows of one text together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.session import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what two rows must share to be one text: SHA-256, an independent 64-bit hash and the length
PROOF = ["sha", "mark", "n_bytes"]


def normalised(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, proof, rank of the identifier): the first of each text, with the sum of ``n``."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held.cast(table.schema), table]).combine_chunks()
        if not table.num_rows:
            continue
        fresh = np.ones(table.num_rows, bool)
        same = np.ones(table.num_rows - 1, bool)
        for name in ("node", *PROOF):
            column = table.column(name).combine_chunks()
            same &= pc.equal(column.slice(1), column.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False)
        fresh[1:] = ~same
        first = np.flatnonzero(fresh)
        sums = np.add.reduceat(table.column("n").to_numpy(), first)
        merged = table.take(pa.array(first)).set_column(table.schema.get_field_index("n"), table.schema.field("n"), pa.array(sums))
        yield from merged.slice(0, merged.num_rows - 1).to_batches()
        held = merged.slice(merged.num_rows - 1)
    if held is not None:
        yield from held.to_batches()


def _merged(runs: DataFrame, largest: bool) -> DataFrame:
    rank = F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()
    ordered = runs.sortWithinPartitions("node", *PROOF, rank, "rid")
    return ordered.mapInArrow(_merge, runs.schema)


def winners(rows: DataFrame, largest: bool = False, fan_bits: int = 3) -> tuple[DataFrame, DataFrame]:
    """The runs of ``rows`` (id, rid, run, sha, mark, n_bytes) and one row per text over all runs.

    ``fan_bits`` sets how many runs meet in one merge: 2^fan_bits.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, (parts - 1).bit_length())
    nodes = 1 << bits
    first = rows.select(F.col("run").alias("node"), *PROOF, "id", "rid", F.lit(1).cast("long").alias("n"))
    runs = stage(_merged(first, largest), "dedup-runs")
    level = runs.withColumn("node", F.pmod("node", F.lit(nodes)).cast("long"))
    owner = F.col("mark").bitwiseAND(F.lit(nodes - 1).cast("long"))
    for low in range(0, bits, fan_bits):
        mask = ((1 << min(fan_bits, bits - low)) - 1) << low
        target = F.col("node").bitwiseAND(F.lit(nodes - 1 - mask).cast("long")).bitwiseOR(
            owner.bitwiseAND(F.lit(mask).cast("long"))
        )
        level = _merged(level.withColumn("node", target).repartition(nodes, "node"), largest)
    return runs, level


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest rows of all documents, written once: id, rid (unique), run, sha, mark, n_bytes."""
    clean = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), clean.alias("text")).select(
        "id",
        F.monotonically_increasing_id().alias("rid"),
        F.spark_partition_id().cast("long").alias("run"),
        F.unhex(F.sha2("text", 256)).alias("sha"),
        F.xxhash64("text").alias("mark"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )
    return stage(rows, "dedup-digests")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_bits: int = 3
) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept and text_sha256 of the normalised text.

    Texts are equal when identical after lower-casing A-Z; null is the empty text, which is a text like any
    other.  Of equal texts the row with the smallest (or ``keep="largest"``) id stays; a null id only stays if all
    ids of its text are null.  Of rows that share text and id exactly one is kept.  An empty table gives an empty
    result.  Other columns are not read, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    rows = digests(docs, id_col, text_col)
    runs, level = winners(rows, keep == "largest", fan_bits)
    final = level.select(*PROOF, F.col("id").alias("keep_id"), F.col("rid").alias("keep_rid"), F.col("n").alias("group_size"))
    back = runs.select(F.col("node").alias("run"), *PROOF).join(final, PROOF)
    return rows.join(back, ["run", *PROOF]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents without exact copies, all columns as they were."""
    sha, key = "__dedup_sha", "__dedup_id"
    stay = stage(
        exact_dedup(docs, id_col, text_col, keep).filter("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(sha)),
        "dedup-kept",
    )
    marked = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    on = marked[id_col].cast("long").eqNullSafe(stay[key]) & (marked[sha] == stay[sha])
    found = marked.join(stay.hint("shuffle_hash"), on, "left_semi")
    twice = docs.groupBy(F.col(id_col)).count().filter("count > 1")
    if twice.isEmpty():
        return found.drop(sha)
    # rows that share id and text: the join keeps all of them, so one is picked
    return found.dropDuplicates([id_col, sha]).drop(sha)
