"""Parquet tables written by the jobs, and the batch ledger that governs them.

Raw and clean tables are partitioned by batch. Nothing is deleted in place: a
batch counts while the ledger says so, which makes a rollback one small append
and lets lost executors re-read what they need.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.session import released_shuffles

# Stored rows hold long keys; it halves them.
COMPRESSION = "zstd"
ROLLED_BACK = "rolled_back"
STATUSES = (
    "uploaded", "raw_loaded", "clean_loaded", "completed", "cancel_requested", "cancelled", "failed", ROLLED_BACK,
)
LEDGER_SCHEMA = (
    "batch_id string, dataset_year int, dataset_type string, original_filename string, "
    "status string, status_no bigint, at timestamp"
)


def append_rows(df: DataFrame, path: str) -> None:
    """Store the rows of some batches; a batch that is stored again replaces itself.

    Other batches stay as they are, so a step that failed can simply run again.
    """
    rows = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", COMPRESSION)
    with released_shuffles(df.sparkSession):
        rows.partitionBy("batch_id").parquet(path)


def append_parts(spark: SparkSession, parts: Iterable[DataFrame], path: str) -> list[str]:
    """Store the rows of some batches that come in several frames, each worked out alone.

    What is shuffled for one frame is gone before the next. As in ``append_rows`` the batches
    that have rows replace themselves, when all frames have been written. Returns their names.
    """
    fresh = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    for part in parts:
        with released_shuffles(spark):
            part.write.mode("append").option("compression", COMPRESSION).partitionBy("batch_id").parquet(fresh)
    written = spark.read.schema("batch_id string").parquet(fresh).distinct().collect()  # one name per upload
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = folder(fresh).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder(path))
    for status in files.listStatus(folder(fresh)):
        if status.isDirectory():
            to = folder(folder(path), status.getPath().getName())
            files.delete(to, True)
            if not files.rename(status.getPath(), to):
                raise OSError(f"cannot put {status.getPath()} to {to}")
    files.delete(folder(fresh), True)
    return sorted(r["batch_id"] for r in written)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been stored at all."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_batch(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    """One batch; the filter on the partition column prunes the other folders."""
    return spark.read.parquet(path).filter(F.col("batch_id") == batch_id)


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


# --- ledger ---------------------------------------------------------------


def record_status(
    spark: SparkSession,
    path: str,
    batch_id: str,
    status: str,
    status_no: int,
    dataset_year: int | None = None,
    dataset_type: str | None = None,
    filename: str | None = None,
) -> None:
    """Append one status event of a batch."""
    if status not in STATUSES:
        raise ValueError(f"unknown batch status: {status}")
    row = [(batch_id, dataset_year, dataset_type, filename, status, status_no, None)]
    spark.createDataFrame(row, LEDGER_SCHEMA).withColumn("at", F.current_timestamp()).write.mode(
        "append"
    ).parquet(path)


def current_status(events: DataFrame, order: tuple[str, ...] = ("at", "status_no")) -> DataFrame:
    """Latest status of every batch. max_by over a struct combines map-side."""
    latest = F.max_by("status", F.struct(*order)).alias("status")
    return events.groupBy("batch_id").agg(latest, F.count("*").alias("n_events"))
