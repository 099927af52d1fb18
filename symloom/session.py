"""Session settings the operators read.  Nothing here changes a session behind the caller's back:
``configure`` is called by the entry points, everything else only reads."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK_KEY = "spark.symloom.rowsPerTask"
ROWS_PER_TASK = 4_000_000
BROADCAST_ROWS = 200_000


#: most bytes of one Arrow batch that goes to a Python worker, however long its texts are
BATCH_BYTES = 8 << 20
PACKAGE_ZIP = "symloom-package.zip"


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every entry point wants: UTC timestamps, AQE with skew splitting, Arrow batches bounded in bytes.

    The package is sent to the Python workers too, which know neither the driver's folder nor its ``sys.path``.
    """
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a skewed join side even when the aggregate above then needs one more exchange
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    }.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Adds this package to what the workers of the session import from; once per session.

    The archive is written to the shared folder.  Where no such folder is named, workers have to find the package by themselves.
    """
    context = spark.sparkContext
    root = Path(__file__).resolve().parent
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if PACKAGE_ZIP in context._python_includes or not root.is_dir() or not (named or context.master.startswith("local")):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(file.relative_to(root.parent)))
    place = f"{scratch_folder(spark, 'package')}/{PACKAGE_ZIP}"
    path = context._jvm.org.apache.hadoop.fs.Path(place)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(place)


def rows_per_task(spark: SparkSession) -> int:
    """Most rows of one ordered group that a single task may be given."""
    return int(spark.conf.get(ROWS_PER_TASK_KEY, str(ROWS_PER_TASK)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a folder below the session's warehouse takes its place on a local master; a
    cluster has to name one.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is not None:
        return current
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder below the shared one, deleted when the driver's JVM ends."""
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives a lost executor."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to as many tasks as a shuffle has, for work that is heavy for the bytes it is read from."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_spread(df: DataFrame) -> DataFrame:
    """As ``cut``, for a table that many rounds read: evenly spread, so every task slot has a share."""
    return cut(spread(df))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives executor loss.

    It is a written table, not a checkpoint, because a checkpoint keeps the size that its plan was estimated to have.  Over the
    rounds of a fixpoint such estimates multiply, by doubling even square, until planning with them takes longer than the
    work.  A table's size is that of its files, so Spark also sees which sides are small.
    """
    return stage(df, "cut")
