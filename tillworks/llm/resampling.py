"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Target text are the documents labelled as good, raw text are all documents. Words and
word pairs are hashed to ``BUCKETS``; a document's log weight is the sum of the
log ratios of its buckets, target over raw. Adding Gumbel noise, drawn from the
identifier, and keeping the k largest is a sample without replacement in
proportion to the weights.

Counts cover all documents: each task counts its rows, and the sums per bucket, a
bounded table, make the model. The target is a sample of at most ``MAX_TARGET``
labelled identifiers, chosen by hash. The k-th largest key is found exactly by
counting keys in ever narrower ranges, never by sorting all in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import lower_ascii, mix, span_hashes, staged, steps, utf8, word_spans

BUCKETS = 1 << 16
MAX_TARGET = 100_000
SMOOTHING = 1.0
BINS = 4096
SEED = 17


def hashed_ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word and word pair."""
    data, offsets = utf8(column)
    begins, ends, rows = word_spans(data, offsets)
    words = span_hashes(lower_ascii(data), begins, ends)
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    pairs = mix(words[pair] * np.uint64(3) + words[pair + 1])
    keys = np.concatenate([words, pairs]) & np.uint64(BUCKETS - 1)
    return keys.astype(np.int64), np.concatenate([rows, rows[pair]])


def _counted(batches: Iterator[pa.RecordBatch], target: np.ndarray) -> Iterator[pa.RecordBatch]:
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in steps(batches, "text"):
        buckets, rows = hashed_ngrams(batch.column(1))
        raw += np.bincount(buckets, minlength=BUCKETS)
        ids = batch.column(0)
        known = np.isin(ids.fill_null(0).to_numpy(), target) & ids.is_valid().to_numpy(zero_copy_only=False)
        good += np.bincount(buckets[known[rows]], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(good[seen])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, target: np.ndarray) -> np.ndarray:
    """Per bucket the log of its probability in target text over that in raw text."""
    counted = docs.mapInArrow(partial(_counted, target=target), "bucket long, raw long, target long")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in sums.collect():  # at most BUCKETS rows
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["target"]
    log = [np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS)) for x in (good, raw)]
    return log[0] - log[1]


def _weighted(batches: Iterator[pa.RecordBatch], ratios: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        buckets, rows = hashed_ngrams(batch.column(1))
        weight = np.bincount(rows, ratios[buckets], batch.num_rows).astype(float)  # whole numbers if there are no words
        count = np.bincount(rows, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(weight)], ["doc_id", "n_ngrams", "log_weight"])


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column without nulls, exact: counts in ever narrower ranges."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while True:
        inside = df.where(F.col(column).between(low, high))
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            return high
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)).alias("place")
        bins = inside.groupBy(place).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        for row in bins.orderBy(F.desc("place")).collect():  # at most BINS rows
            if k <= row["n"]:
                low, high, n = row["low"], row["high"], row["n"]
                break
            k -= row["n"]
        if low == high:
            return high
        if n <= BINS:
            values = df.where(F.col(column).between(low, high)).select(column).collect()
            return sorted((v[0] for v in values), reverse=True)[k - 1]


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> DataFrame:
    """The sampled documents: ``doc_id, n_ngrams, log_weight, sample_key, kept``.

    ``share`` of the documents is kept; without it the share of good labels among all
    labels (everything without labels). Null texts count as empty and weigh 0. Documents
    that tie with the last one kept are kept too, as repeated rows do. A null doc_id
    takes part with the noise of null. An empty table gives no rows, a table without
    good labels a sample by noise alone. Columns besides id and text are not read.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good = known.where("quality = 1")
    if share is None:
        of = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        share = 1.0 if of is None else of
    some = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TARGET).select("doc_id")
    target = np.array([r["doc_id"] for r in some.collect()], np.int64)  # at most MAX_TARGET
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ratios = log_ratios(narrow, target) if len(target) else np.zeros(BUCKETS)
    weighted = narrow.mapInArrow(partial(_weighted, ratios=ratios), "doc_id long, n_ngrams long, log_weight double")
    even = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    noise = -F.log(-F.log(even))
    keyed = staged(weighted.withColumn("sample_key", F.col("log_weight") + noise), "sample-keys")
    k = int(np.ceil(share * keyed.count()))
    if k <= 0:
        return keyed.limit(0).withColumn("kept", F.lit(True))
    return keyed.where(F.col("sample_key") >= F.lit(kth_largest(keyed, "sample_key", k))).withColumn("kept", F.lit(True))
