"""Uploads as a file stream into the raw tables.

The same header check, renaming and typing as the batch load. Each micro-batch
is one ledger batch whose id comes from the stream's name, the identity of its checkpoint
and the epoch. Its folder is overwritten, so a repeated epoch does not double its rows; a
stream that begins anew with a fresh checkpoint counts epochs from 0 again, under other names.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillworks.sources import files


def upload_stream(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """New CSV files of a folder, every column as text."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in files.headers_of(kind)])
    return (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("multiLine", kind == "reviews")
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(folder)
    )


def stream_to_raw(
    spark: SparkSession, folder: str, kind: str, raw_path: str, checkpoint: str, name: str = "uploads"
) -> StreamingQuery:
    """Load what has arrived since the last run, then stop."""
    stream: list[str] = []

    def load(rows: DataFrame, epoch: int) -> None:
        if not stream:  # Spark writes its id into a new checkpoint before the first epoch
            about = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"]
            stream.append(json.loads(about)["id"][:8])
        batch = files.raw_rows(rows, kind, f"{name}-{stream[0]}-{epoch}").withColumns(files.arrival())
        (
            batch.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(raw_path)
        )

    return (
        upload_stream(spark, folder, kind)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
