"""Shards by jump consistent hashing: a key and the number of shards decide, no ring is kept.

The published recurrence walks from one possible home of a key to the next; where it
leaves the range of shards, the last home holds. With one more shard the walk is the same
up to there, so a key either stays or moves into the new shard.

Placing rows needs no shuffle of the texts: a first pass works out size, checksum, key and
shard where a row is read. Only those narrow rows are range-sorted by identifier, and the
rows of each shard are numbered per range; the counts of the ranges before are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillworks.llm.common import staged, text_of

SHARDS = 24
ROW_BYTES = 8
LAW = "key"
PLACED = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"

# Fixed values of the published recurrence.
MULTIPLIER = 2862933555777941757
SHIFT, SCALE = 33, 1 << 31


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key among ``shards``, which must be at least one."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = keys.astype(np.uint64)
    home = np.zeros(len(state), np.int64)
    walking = np.arange(len(state))
    target = np.zeros(len(state), np.int64)
    while len(walking):
        home[walking] = target[walking]
        state[walking] = state[walking] * np.uint64(MULTIPLIER) + np.uint64(1)
        step = SCALE / ((state[walking] >> np.uint64(SHIFT)).astype(np.float64) + 1.0)
        target[walking] = np.floor((home[walking] + 1) * step).astype(np.int64)
        walking = walking[target[walking] < shards]
    return home


def stable_key(*columns: str) -> Column:
    """Sixteen bytes that depend on the values alone, the same in every engine and session; null is its own value."""
    if len(columns) == 1:
        return F.unhex(F.md5(F.coalesce(F.col(columns[0]).cast("string"), F.lit("")).cast("binary")))
    return F.unhex(F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)])).cast("binary")))


def _key_numbers(column: pa.Array) -> np.ndarray:
    """The first eight of sixteen bytes as an unsigned number, the highest byte first."""
    data = np.frombuffer(b"".join(column.to_pylist()), ">u8")
    return data[::2].astype(np.uint64)


def with_shard(df: DataFrame, key: list[str], shards: int, name: str = "shard", more: dict[str, int] | None = None) -> DataFrame:
    """All columns and the shard of each row; ``more`` names columns with other numbers of shards.

    Only the key's digest goes through Python. Repeated keys share a shard; a null key counts
    as an empty one. An empty table gives no rows; a column of the same name is replaced.
    """
    wanted = {name: shards, **(more or {})}

    @F.arrow_udf("struct<" + ", ".join(f"`{column}`: int" for column in wanted) + ">")
    def homes(digest: pa.Array) -> pa.Array:
        keys = _key_numbers(digest)
        return pa.StructArray.from_arrays([pa.array(jump(keys, n), pa.int32()) for n in wanted.values()], list(wanted))

    found = df.drop(*wanted).withColumn("_homes", homes(stable_key(*key)))
    return found.select("*", *[F.col(f"_homes.`{column}`").alias(column) for column in wanted]).drop("_homes")


def _numbered(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Number the rows of each shard in the order they come; the range is the task's."""
    seen = np.zeros(shards, np.int64)
    place = TaskContext.get().partitionId()
    for batch in batches:
        shard = batch.column(batch.schema.get_field_index("shard")).to_numpy(zero_copy_only=False)
        order = np.argsort(shard, kind="stable")
        counts = np.bincount(shard, minlength=shards)
        begins = np.cumsum(counts) - counts
        inside = np.empty(len(shard), np.int64)
        inside[order] = np.arange(len(shard)) - begins[shard[order]] + seen[shard[order]]
        seen += counts
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(shard), place, np.int64)), pa.array(inside)], [*batch.schema.names, "_range", "_inside"]
        )


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document.

    ``size`` is the UTF-8 bytes of the text and eight more; a null text counts as empty.
    Slots count the rows of a shard from 0 in the order of doc_id (null first), checksum and size.
    A null doc_id is a key of its own; rows that repeat a doc_id share its shard
    and have slots of their own. Extra columns are not read; an empty table gives no rows.
    """
    text = text_of("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = with_shard(rows, ["doc_id"], shards, more={"grown_shard": shards + 1})
    # The row number spreads an identifier that very many rows share over several ranges.
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    order = ["doc_id", "text_crc32", "size", "_row"]
    schema = f"{rows.schema.simpleString()[7:-1]},_range:bigint,_inside:bigint"
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = staged(sorted_rows.mapInArrow(partial(_numbered, shards=shards), schema), "shard-ranges")
    counts = ranges.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranges.join(counts, ["shard", "_range"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("_before") + F.col("_inside")).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, key: list[str], shards: int = SHARDS) -> None:
    """Write whole rows in one folder per shard. No shuffle: each task adds a file to the shards that it has rows of."""
    with_shard(docs, key, shards).write.partitionBy("shard").parquet(path)


def append_shards(spark: SparkSession, path: str, key: list[str], shards: int, more: int, grown: str) -> None:
    """Copy a shard folder of ``shards`` shards to ``grown`` with ``more`` shards appended.

    A row of an old shard stays in it or goes to one of the appended shards. The old folder
    stays as it is until the caller drops it, so an attempt that is broken off loses nothing.
    """
    old = spark.read.parquet(path)
    moved = with_shard(old.withColumnRenamed("shard", "_old"), key, shards + more)
    stays = (F.col("shard") == F.col("_old")) | (F.col("shard") >= shards)
    checked = moved.withColumn("shard", F.when(stays, F.col("shard")).otherwise(F.raise_error(F.lit("the folder was written with another key or count"))))
    checked.drop("_old").write.partitionBy("shard").parquet(grown)


def moving(docs: DataFrame, key: list[str], shards: int, more: int) -> DataFrame:
    """The rows that change their shard when ``more`` shards are appended, with ``shard`` and ``grown_shard``."""
    return with_shard(docs, key, shards, more={"grown_shard": shards + more}).where("shard <> grown_shard")
