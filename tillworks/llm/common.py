"""Written intermediates, whole-text batches and word spans shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.session import staged  # noqa: F401  the operators take it from here

# Bytes of text that one vectorised step works on; a longer text is one step of its own.
STEP_BYTES = 4 << 20


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: Column) -> Column:
    """crc32 of a number written as text; the fixed folds of the labelled queries use it."""
    return F.crc32(column.cast("string").cast("binary"))


def place_in_group(df: DataFrame, group: list[str], order: list[str], block: Column, name: str) -> DataFrame:
    """Number the rows of each group from 0 without sorting a whole group in one task.

    ``block`` must not decrease along ``order``. Rows are numbered inside a block,
    and the counts of the blocks before it, one row per block, are added.
    """
    cut = df.withColumn("_block", block)
    counts = cut.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_block").orderBy(*order)
    numbered = cut.withColumn("_inside", F.row_number().over(inside) - 1).alias("l")
    joined = numbered.join(
        counts.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_block"]]
    )
    return joined.select("l.*", (F.col("r._before") + F.col("l._inside")).cast("long").alias(name)).drop("_block", "_inside")


def keep_rows(df: DataFrame, keys: list[Column], wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose keys are among the rows of ``wanted``, null equal to null; all columns stay."""
    names = [f"_{uuid.uuid4().hex}" for _ in keys]  # clash with no column
    right = wanted.toDF(*names)
    same = reduce(Column.__and__, (key.eqNullSafe(F.col(name)) for key, name in zip(keys, names)))
    return df.join(right, same, "left_semi")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row begins; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), float))
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word ``[^\\x20\\x09-\\x0D]+`` and the row it belongs to; no word crosses rows."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~space
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True  # rows that are empty mark the next row's begin, or the end
    begin = word & first[:-1]
    begin[1:] |= word[1:] & space[:-1]
    end = np.empty_like(word)
    if len(data):
        end[:-1] = word[:-1] & (space[1:] | first[1:-1])
        end[-1] = word[-1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begins, ends, np.searchsorted(offsets, begins, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0], have = 1, 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out[:n]


class Scratch(dict):
    """What a worker keeps between batches; it travels empty."""

    def __reduce__(self):
        return Scratch, ()


_TABLE = Scratch()


def _powers_upto(base: int, n: int) -> np.ndarray:
    have = _TABLE.get(base)
    if have is None or len(have) < n:
        have = _powers(base, max(n, 1 << 20))
        if n <= STEP_BYTES + 1:
            _TABLE[base] = have
    return have[:n]


_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(keys: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys over all bits."""
    x = keys ^ (keys >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of bytes, from running sums; equal bytes give equal hashes anywhere."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers_upto(_ODD, len(data)), out=sums[1:])
    shift = _powers_upto(_INVERSE, len(data) + 1)
    size = (ends - begins).astype(np.uint64)
    return mix((sums[ends] - sums[begins]) * shift[begins] + size * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at every place where so many follow; not those of span_hashes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers_upto(_ODD, len(data)), out=sums[1:])
    out = sums[size:] - sums[:-size]
    out *= _powers_upto(_INVERSE, len(out))
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def runs_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin, and the length as the last entry."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))


def spread_ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0]+1, ... for every range, one after the other."""
    total = int(sizes.sum())
    out = np.ones(total, np.int64)
    at = np.cumsum(sizes) - sizes
    full = sizes > 0
    at, first, size = at[full], begins[full], sizes[full]
    if not total:
        return out
    out[at[0]] = first[0]
    out[at[1:]] = first[1:] - (first[:-1] + size[:-1] - 1)
    return np.cumsum(out)
