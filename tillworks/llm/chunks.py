"""Whole texts in chunks that can ask for, and get back, figures about their n-grams.

A chunk is one row: some documents' identifiers and their texts, compressed. Chunks
are written once as a table bucketed by chunk, so that later steps bring answers to
the chunks without moving the texts again. A step that needs corpus-wide figures
sends each chunk's distinct keys, sorted, in one block per key range; the reducer of
a range meets the blocks of all chunks and answers each in the order it asked.
A key sends one entry per chunk, however often it occurs there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import steps, utf8
from tillworks.session import fresh_path

CHUNK_BYTES = 4 << 20
CHUNKS = "chunk long, ids binary, known binary, marks binary, sizes binary, texts binary"


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed block; sorted 64-bit keys take few bytes."""
    head = np.array([len(arrays), *(len(a) for a in arrays), *(a.dtype.itemsize for a in arrays)], np.int64).tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack_arrays(block: bytes, *types) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, 2 * n, 8)
    at, out = 8 * (1 + 2 * n), []
    for length, width, kind in zip(sizes[:n].tolist(), sizes[n:].tolist(), types):
        plane = np.frombuffer(data, np.uint8, length * width, at).reshape(width, length)
        out.append(np.ascontiguousarray(plane.T).view(kind).reshape(-1))
        at += length * width
    return out


def deltas(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys; cumsum brings them back."""
    out = keys.copy()
    out[1:] -= keys[:-1]
    return out


def _chunked(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    names = [part.split()[0] for part in CHUNKS.split(", ")]
    packer = zstandard.ZstdCompressor(level=3)
    held: list[pa.RecordBatch] = []
    size = 0

    def row() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, marks = table.column("doc_id").combine_chunks(), table.column("mark").combine_chunks()
        data, offsets = utf8(table.column("text").combine_chunks())
        values = [
            number,
            ids.fill_null(0).to_numpy().astype(np.int64).tobytes(),
            ids.is_valid().to_numpy(zero_copy_only=False).tobytes(),
            marks.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int8).tobytes(),
            np.diff(offsets).astype(np.int64).tobytes(),
            packer.compress(data.tobytes()),
        ]
        types = [pa.int64()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    for batch in steps(batches, "text", limit // 2):
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= limit or sum(b.num_rows for b in held) >= 100_000:
            yield row()
            held, size, number = [], 0, number + 1
    if held:
        yield row()


class Texts:
    """The documents of a chunk row: ids (null as 0, see known), marks, bytes and where each begins."""

    def __init__(self, row: dict):
        self.chunk = row["chunk"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        self.marks = np.frombuffer(row["marks"], np.int8)
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        data = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, int(self.offsets[-1])))
        self.data = np.frombuffer(data, np.uint8)

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, mask=~self.known)


def chunked(docs: DataFrame, mark, limit: int = CHUNK_BYTES) -> DataFrame:
    """Write ``doc_id, text`` and a small number ``mark`` per document as chunks, bucketed by chunk."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark.cast("int").alias("mark"))
    rows = narrow.mapInArrow(partial(_chunked, limit=limit), CHUNKS)
    name = f"llm_chunks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.write.format("parquet").option("path", fresh_path(spark, "chunks")).option("compression", "none")
    writer.bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name)


def asked(chunks: DataFrame, function, schema: str) -> DataFrame:
    """What every chunk asks: ``function(Texts)`` returns an Arrow table. Chunks stay where they are."""

    def one(table):
        (row,) = table.to_pylist()
        return function(Texts(row))

    return chunks.groupBy("chunk").applyInArrow(one, schema)


def answered(chunks: DataFrame, answers: DataFrame, function, schema: str) -> DataFrame:
    """Give every chunk its answer rows: ``function(Texts, answers as an Arrow table)`` returns a table."""

    def two(chunk, replies):
        (row,) = chunk.to_pylist()
        return function(Texts(row), replies)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(two, schema)


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted keys pass from one of ``buckets`` equal key ranges to the next."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
