"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The n-grams of the benchmark items are counted over all documents.
2. Seeds are the locally rarest n-grams of each item: of every ``window`` n-grams in a
   row the one seen least in the corpus stays. Any intact stretch of
   ``window + n - 1`` words holds a seed, however common the passage is.
3. Documents join the seeds by hash. Hits on neighbouring diagonals are one candidate
   passage; the passage and the item are aligned word by word, and the score is
   the alignment's share of a perfect one.

The benchmark is a stated query set against all documents. It is taken in blocks of at
most ``BLOCK_BYTES`` of text, whose seeds are sent to the tasks; the corpus is read
once to count and once to align for each block, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import lower_ascii, mix, runs_of, span_hashes, spread_ranges, steps, utf8

N = 3
WINDOW = 2
MIN_SCORE = 0.4
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 2 << 20
# Bytes of text of one vectorised step.
STEP = 1 << 19
CELLS = 2_000_000
SCHEMA = "doc_id long, item_id long, score double, begin_byte long, end_byte long, item_words int"


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of words: letters and digits of ASCII and all bytes beyond it."""
    letter = np.zeros(256, bool)
    letter[48:58] = letter[65:91] = letter[97:123] = letter[128:] = True
    word = letter[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    begin = word & first[:-1]
    begin[1:] |= word[1:] & ~word[:-1]
    end = word.copy()
    if len(data):
        end[:-1] &= ~word[1:] | first[1:-1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begins, ends, np.searchsorted(offsets, begins, "right") - 1


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row of the same text, and where they begin."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    out = np.zeros(len(inside), np.uint64)
    for j in range(n):
        out = mix(out + hashes[inside + j] * np.uint64(2 * j + 3))
    return out, inside


@dataclass
class Items:
    """A block of benchmark items as word hashes, with the n-grams to look for."""

    ids: np.ndarray
    bounds: np.ndarray
    words: np.ndarray
    keys: np.ndarray  # sorted n-gram hashes, repeated for every place
    places: np.ndarray  # word place of each, in `words`

    def item_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, "right") - 1


def index_items(ids: list[int], texts: list[str | None], n: int = N) -> Items:
    data, offsets = utf8(folded(pa.array(texts, pa.string())))
    begins, ends, rows = plain_words(data, offsets)
    words = span_hashes(lower_ascii(data), begins, ends)
    keys, places = grams(words, rows, n)
    order = np.argsort(keys, kind="stable")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(ids))))).astype(np.int64)
    return Items(np.array(ids, np.int64), bounds, words, keys[order], places[order])


def folded(column: pa.Array) -> pa.Array:
    """Lower case, where that keeps the length in bytes, so that spans hold for the text itself."""
    lower = pc.utf8_lower(column)
    return pc.if_else(pc.equal(pc.binary_length(lower), pc.binary_length(column)), lower, column)


def _word_hashes(column: pa.Array):
    data, offsets = utf8(folded(column))
    begins, ends, rows = plain_words(data, offsets)
    return begins, ends, rows, span_hashes(lower_ascii(data), begins, ends), offsets


def _counted(batches: Iterator[pa.RecordBatch], distinct: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(len(distinct), np.int64)
    for batch in steps(batches, "text", STEP):
        _, _, rows, hashes, _ = _word_hashes(batch.column(batch.schema.get_field_index("text")))
        keys, _ = grams(hashes, rows, n)
        at = np.minimum(np.searchsorted(distinct, keys), len(distinct) - 1)
        counts += np.bincount(at[distinct[at] == keys], minlength=len(distinct))
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["gram", "n"])


def rare_seeds(docs: DataFrame, items: Items, n: int = N, window: int = WINDOW) -> Items:
    """Keep of every ``window`` n-grams in a row of an item the one that the documents have least often."""
    distinct = np.unique(items.keys)
    if not len(distinct):
        return items
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        partial(_counted, distinct=distinct, n=n), "gram long, n long"
    )
    counts = np.zeros(len(distinct), np.int64)
    for row in counted.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # one row per n-gram of the block
        counts[row["gram"]] = row["n"]
    seen = np.zeros(len(items.words), np.int64)
    has = np.zeros(len(items.words), bool)
    seen[items.places] = counts[np.searchsorted(distinct, items.keys)]
    has[items.places] = True
    keep = np.zeros(len(items.words), bool)
    for first, last in zip(items.bounds[:-1], items.bounds[1:]):
        places = np.arange(first, last)[has[first:last]]
        for at in range(max(1, len(places) - window + 1) if len(places) else 0):
            row = places[at : at + window]
            keep[row[np.argmin(seen[row])]] = True
    chosen = keep[items.places]
    return Items(items.ids, items.bounds, items.words, items.keys[chosen], items.places[chosen])


def smith_waterman(items: np.ndarray, item_sizes: np.ndarray, passages: np.ndarray, sizes: np.ndarray):
    """Best local alignment of each item (b x l hashes) with its passage (b x w): score and where it ends.

    Returns score, end in the item and end in the passage (exclusive). Padding never matches.
    """
    b, w = passages.shape
    ramp = np.arange(w, dtype=np.int32)
    inside = ramp[None, :] < sizes[:, None]
    above = np.zeros((b, w), np.int32)
    best, item_end, end = np.zeros(b, np.int32), np.zeros(b, np.int64), np.zeros(b, np.int64)
    for i in range(items.shape[1]):
        step = np.where((items[:, i, None] == passages) & inside & (i < item_sizes)[:, None], MATCH, MISMATCH).astype(np.int32)
        row = np.maximum(above + GAP, 0)
        row[:, 0] = np.maximum(row[:, 0], step[:, 0])
        row[:, 1:] = np.maximum(row[:, 1:], above[:, :-1] + step[:, 1:])
        row = np.maximum(np.maximum.accumulate(row - GAP * ramp, axis=1) + GAP * ramp, 0)
        at = row.argmax(1)
        top = row[np.arange(b), at]
        better = top > best
        best[better], end[better], item_end[better] = top[better], at[better] + 1, i + 1
        above = row
    return best, item_end, end


def _aligned(items: Items, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, hashes: np.ndarray, min_score: float):
    """Score and span of words for candidate passages [lo, hi) of ``hashes``."""
    size, length = (items.bounds[1:] - items.bounds[:-1])[item], hi - lo
    score, begin, end = np.zeros(len(item)), np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    order = np.lexsort((length, size))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop - at + 1) * int(length[order[at : stop + 1]].max()) * 8 <= CELLS:
            stop = min(len(order), at + max(2 * (stop - at), 2))
            if stop - at >= 2048:
                break
        some = order[at:stop]
        at = stop
        l, w = int(size[some].max()), int(length[some].max())
        left = np.zeros((len(some), l), np.uint64)
        right = np.ones((len(some), w), np.uint64)
        a = spread_ranges(items.bounds[item[some]], size[some])
        left[np.repeat(np.arange(len(some)), size[some]), spread_ranges(np.zeros(len(some), np.int64), size[some])] = items.words[a]
        p = spread_ranges(lo[some], length[some])
        right[np.repeat(np.arange(len(some)), length[some]), spread_ranges(np.zeros(len(some), np.int64), length[some])] = hashes[p]
        best, _, last = smith_waterman(left, size[some], right, length[some])
        share = best / (MATCH * size[some])
        score[some], end[some] = share, lo[some] + last
        sure = np.flatnonzero(share >= min_score)
        if len(sure):  # the begin, from the same alignment read backwards
            back_left = np.zeros((len(sure), l), np.uint64)
            back_right = np.ones((len(sure), w), np.uint64)
            for row, k in enumerate(sure):
                back_left[row, : size[some[k]]] = left[k, : size[some[k]]][::-1]
                back_right[row, : last[k]] = right[k, : last[k]][::-1]
            _, _, taken = smith_waterman(back_left, size[some[sure]], back_right, last[sure])
            begin[some[sure]] = end[some[sure]] - taken
    return score, begin, end


def _matches(column: pa.Array, seeds: Items, n: int, min_score: float):
    """Row, item, score and byte span of every aligned passage of a text column."""
    begins, ends, rows, hashes, offsets = _word_hashes(column)
    keys, places = grams(hashes, rows, n)
    empty = np.empty(0, np.int64)
    if not len(keys) or not len(seeds.keys):
        return empty, empty, np.empty(0), empty, empty
    lo, hi = np.searchsorted(seeds.keys, keys), np.searchsorted(seeds.keys, keys, "right")
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return empty, empty, np.empty(0), empty, empty
    times = (hi - lo)[hit]
    place = np.repeat(places[hit], times)
    at = seeds.places[spread_ranges(lo[hit], times)]
    item = seeds.item_of(at)
    row, diagonal = rows[place], place - (at - seeds.bounds[item])
    order = np.lexsort((diagonal, item, row))
    row, item, diagonal = row[order], item[order], diagonal[order]
    size = (seeds.bounds[1:] - seeds.bounds[:-1])[item]
    slack = np.maximum(size // 2, 4)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    row, item, slack, size = row[first], item[first], slack[first], size[first]
    count = np.bincount(rows, minlength=len(offsets) - 1)
    row_begin = np.concatenate(([0], np.cumsum(count)))
    low = np.maximum(diagonal[first] - slack, row_begin[row])
    high = np.minimum(diagonal[last] + size + slack, row_begin[row + 1])
    score, begin, end = _aligned(seeds, item, low, high, hashes, min_score)
    good = np.flatnonzero(score >= min_score)
    good = good[np.lexsort((begin[good], -score[good], item[good], row[good]))]
    pair = np.ones(len(good), bool)  # the best passage of each document and item
    pair[1:] = (row[good][1:] != row[good][:-1]) | (item[good][1:] != item[good][:-1])
    good = good[pair]
    base = offsets[row[good]]
    return row[good], item[good], score[good], begins[begin[good]] - base, ends[end[good] - 1] - base


def _match_batches(batches: Iterator[pa.RecordBatch], seeds: Items, n: int, min_score: float) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", STEP):
        row, item, score, begin, end = _matches(batch.column(1), seeds, n, min_score)
        words = (seeds.bounds[1:] - seeds.bounds[:-1])[item].astype(np.int32)
        columns = [batch.column(0).take(pa.array(row)), pa.array(seeds.ids[item]), pa.array(score), pa.array(begin), pa.array(end), pa.array(words)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "begin_byte", "end_byte", "item_words"])


def _clean_batches(batches: Iterator[pa.RecordBatch], seeds: Items, n: int, min_score: float) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", STEP):
        row, *_ = _matches(batch.column(batch.schema.get_field_index("text")), seeds, n, min_score)
        keep = np.ones(batch.num_rows, bool)
        keep[row] = False
        yield batch.filter(pa.array(keep))


def blocks(benchmark: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_bytes`` of text, each indexed on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL"
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        if rows:
            yield index_items([r["item_id"] for r in rows], [r["text"] for r in rows], n)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, n: int = N, window: int = WINDOW) -> DataFrame:
    """Rows ``doc_id, item_id, score, begin_byte, end_byte, item_words``: the best passage of each document and item.

    ``score`` is the alignment's share of a perfect match, ``min_score`` at least. Spans
    count UTF-8 bytes of the text. Null texts and texts or items of fewer than ``n``
    words match nothing; benchmark rows with a null id or text are left out; repeated
    rows, of either table, are rows of their own; a null doc_id stays null. Empty
    tables give no rows. Columns besides id and text are not read.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], SCHEMA)
    for items in blocks(benchmark, n):
        seeds = rare_seeds(narrow, items, n, window)
        found = found.unionByName(narrow.mapInArrow(partial(_match_batches, seeds=seeds, n=n, min_score=min_score), SCHEMA))
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, n: int = N, window: int = WINDOW) -> DataFrame:
    """The documents without any contaminated passage, with all their columns."""
    for items in blocks(benchmark, n):
        seeds = rare_seeds(docs, items, n, window)
        docs = docs.mapInArrow(partial(_clean_batches, seeds=seeds, n=n, min_score=min_score), docs.schema)
    return docs
