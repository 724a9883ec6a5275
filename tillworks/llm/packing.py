"""Packing along a space-filling curve: neighbours in content share training sequences.

1. Words of a document are hashed to ``BUCKETS`` counts; the damped, normalised vector
   is projected to ``DIMENSIONS`` axes and placed on a Hilbert curve.
2. Documents are range-sorted by curve key and identifier. Copies share a key, so
   the identifier splits a key that very many documents have.
3. Each range is tokenised once, after the only shuffle, as one stream of documents
   along the curve, and cut into sequences. Documents are cut where a sequence is
   full. The last, partly filled sequence of a range is cut into powers of two,
   which need no padding.

The ids are those of the byte-level vocabulary file in ``tokenizers`` form; they are
worked out with tiktoken from the same vocabulary as ranks, which gives the same ids
in a fraction of the time. As with that file as loaded, a literal ``<|endoftext|>`` in a text is
the single id 50256.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import Scratch, lower_ascii, span_hashes, steps, utf8, word_spans

SEQUENCE = 2048
END_OF_TEXT = 1
BUCKETS = 256
DIMENSIONS, BITS = 3, 20
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the one special token of the vocabulary file.
SPECIAL = {"<|endoftext|>": 50256}
STEP = 1 << 20
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (n x d of unsigned integers below 2**bits) along the Hilbert curve.

    Follows Skilling's published transposed form: undo the rotations from the top
    bit down, Gray-encode across the axes, interleave the bits.
    """
    x = points.astype(np.uint64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for axis in range(axes):
            inverted = (x[axis] & bit) != 0
            swap = np.where(inverted, np.uint64(0), (x[0] ^ x[axis]) & below)
            x[axis] ^= swap
            x[0] ^= np.where(inverted, below, swap)
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(level)) & np.uint64(1), np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in range(axes):
            key = (key << np.uint64(1)) | ((x[axis] >> np.uint64(level)) & np.uint64(1))
    return key.astype(np.int64)


def _projection() -> np.ndarray:
    matrix = np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS))
    return matrix / np.linalg.norm(matrix, axis=0)


def curve_keys(column: pa.Array) -> np.ndarray:
    """Curve key of each text; texts with the same words in any order share one."""
    data, offsets = utf8(column)
    begins, ends, rows = word_spans(data, offsets)
    words = span_hashes(lower_ascii(data), begins, ends)
    place = rows * BUCKETS + (words % np.uint64(BUCKETS)).astype(np.int64)
    vectors = np.sqrt(np.bincount(place, minlength=len(column) * BUCKETS).reshape(len(column), BUCKETS))
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    axes = vectors @ _projection() / np.maximum(length, 1e-9)
    points = np.clip((axes + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
    return hilbert_keys(points, BITS)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", STEP):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve_keys(batch.column(1)))], ["doc_id", "text", "curve_key"])


_ENCODERS = Scratch()


def _encoder(ranks: str) -> tiktoken.Encoding:
    if ranks not in _ENCODERS:
        with open(public_tokenizers.path(ranks), "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[ranks] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=SPECIAL)
    return _ENCODERS[ranks]


def token_ids(text: str | None, ranks: str = RANKS, end: int = END_OF_TEXT) -> np.ndarray:
    """The ids of a text with the end id, as little-endian 32-bit numbers; null counts as empty."""
    return np.array([*_encoder(ranks).encode(text or "", allowed_special="all"), end], "<u4")


def powers_of_two(n: int) -> list[int]:
    return [1 << bit for bit in range(n.bit_length() - 1, -1, -1) if n >> bit & 1]


Part = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, tokens of the document


def laid_out(parts: list[Part], sizes: Iterator[int], first: int) -> tuple[list[tuple], list[Part]]:
    """Cut parts along sequences of the given sizes; the parts that no full sequence takes come back."""
    rows, number, size, used, open_parts = [], first, next(sizes, 0), 0, []
    held: list[tuple] = []
    for doc, start, ids, total in parts:
        at = 0
        while at < len(ids) and size:
            take = min(size - used, len(ids) - at)
            held.append((doc, start + at, ids[at : at + take], total, number, used))
            at, used = at + take, used + take
            if used == size:
                rows += [(d, s, len(x), zlib.crc32(x.tobytes()), t, q, o) for d, s, x, t, q, o in held]
                held, number, size, used = [], number + 1, next(sizes, 0), 0
        if at < len(ids):
            open_parts.append((doc, start + at, ids[at:], total))
    return rows, [(d, s, x, t) for d, s, x, t, _, _ in held] + open_parts


def _pack(batches: Iterator[pa.RecordBatch], ranks: str, sequence: int, end: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 40
    names = [part.split()[0] for part in PIECES.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*rows)], names)

    carried: list[Part] = []
    for batch in steps(batches, "text", STEP):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = token_ids(text, ranks, end)
            carried.append((doc, 0, ids, len(ids)))
        full = sum(len(part[2]) for part in carried) // sequence
        rows, carried = laid_out(carried, iter([sequence] * full), number)
        number += full
        if rows:
            yield batch_of(rows)
    rest = sum(len(part[2]) for part in carried)
    if rest:
        rows, _ = laid_out(carried, iter(powers_of_two(rest)), number)
        yield batch_of(rows)


def packed(docs: DataFrame, sequence: int = SEQUENCE, ranks: str = RANKS, end: int = END_OF_TEXT) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of all documents.

    Every id of every document lies in one piece; a null or empty text is its end id alone.
    Offsets of a sequence have no gaps. Sequences have ``sequence`` ids, or a smaller
    power of two at the end of a range. Repeated rows are packed each, a null doc_id stays
    null, an empty table gives no rows. Columns besides id and text are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = narrow.mapInArrow(_keyed, "doc_id long, text string, curve_key long")
    ranges = keyed.repartitionByRange("curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id", "text")
    return ranges.select("doc_id", "text").mapInArrow(partial(_pack, ranks=ranks, sequence=sequence, end=end), PIECES)
