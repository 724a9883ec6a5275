"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text; both end
with the same base of ordinary text, so that they differ only in what they add.
Every window of a text is compressed with both, and the gap between the two
lengths says which dictionary knows it better. Thresholds on the gaps are
calibrated: the shares and counts of windows beyond each gap enter a logistic
regression fitted on the labelled sample.

Most windows of a toxic document are ordinary, so training goes in rounds: after each
one the toxic dictionary is trained anew on the windows of toxic documents with the
widest gaps, the ordinary one on the ordinary windows most easily mistaken.

The model is fitted on a bounded sample of labelled rows, ``MAX_TOXIC`` and
``MAX_ORDINARY`` documents and ``MAX_BYTES`` of text per class at most, chosen by a
hash of the identifier. The base and the first dictionaries are trained on at most
``TRAINING_WINDOWS`` windows of a class, drawn at random, later ones on the
``SHARE`` of windows with the widest gaps. Scoring reads every window of every whole text, in the task
that read it; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import fold, steps, utf8

WIDTH, STRIDE = 32, 16
LEVEL = 12
BASE_BYTES, OWN_BYTES = 65536, 6144
ROUNDS = 4
SHARE = 0.06
TRAINING_WINDOWS = 150_000
MAX_TOXIC, MAX_ORDINARY, MAX_BYTES = 2000, 3000, 16 << 20
LOW, HIGH = -6, 10
FOLDS = 5
STEP = 1 << 20
FIT_THREADS = 4
SAMPLES = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def windows(data: np.ndarray, offsets: np.ndarray) -> SAMPLES:
    """Folded bytes with a space after each row, and begin, length and row of every window; an empty row has one."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9:14] = 32
    size = np.diff(offsets)
    padded = np.full(len(data) + len(size), 32, np.uint8)
    rows = np.repeat(np.arange(len(size)), size)
    padded[np.arange(len(data)) + rows] = table[data]
    size = size + 1
    first = np.cumsum(size) - size
    count = np.maximum(-(-(size - (WIDTH - STRIDE)) // STRIDE), 1)
    row = np.repeat(np.arange(len(size)), count)
    begin = first[row] + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    length = np.minimum(begin + WIDTH, (first + size)[row]) - begin
    return padded, begin, length, row


def _lengths(compressor: zstandard.ZstdCompressor, text: bytes, begin: np.ndarray, length: np.ndarray, threads: int) -> np.ndarray:
    out = np.empty(len(begin), np.int32)
    for at in range(0, len(begin), 50_000):
        part = slice(at, at + 50_000)
        spans = np.stack([begin[part], length[part]], 1).astype(np.uint64).tobytes()
        packed = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(text, spans), threads=threads)
        out[part] = np.fromiter((len(x) for x in packed), np.int32, len(begin[part]))
    return out


def _trained(text: bytes, begin: np.ndarray, length: np.ndarray, size: int) -> bytes:
    """The content of a dictionary trained on windows; too few windows are taken as they are."""
    samples = [text[a : a + n] for a, n in zip(begin.tolist(), length.tolist())]
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    """Two dictionary contents, feature scales and weights; without dictionaries the score is the prior."""

    prior: float
    toxic: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def gaps(self, text: bytes, begin: np.ndarray, length: np.ndarray, threads: int = 1) -> np.ndarray:
        """How many bytes fewer the toxic dictionary needs for each window."""
        spans = (text, begin, length, threads)
        return _lengths(_compressor(self.ordinary), *spans) - _lengths(_compressor(self.toxic), *spans)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def _features(gaps: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per text: the share of windows at or beyond each gap, their count, and whether there is one."""
    kinds = HIGH - LOW + 1
    counts = np.bincount(row * kinds + np.clip(gaps, LOW, HIGH) - LOW, minlength=rows * kinds).reshape(rows, kinds)
    beyond = np.cumsum(counts[:, ::-1], 1)[:, ::-1].astype(float)
    positive = beyond[:, 1 - LOW :]
    return np.concatenate([beyond[:, 1:] / beyond[:, :1], np.log1p(positive), positive > 0], 1)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    z = np.c_[np.ones(len(x)), x]
    weights, ridge = np.zeros(z.shape[1]), penalty * np.eye(z.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ weights)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(toxic: list[str], ordinary: list[str], prior: float, rounds: int = ROUNDS, seed: int = 0) -> Model:
    """Train both dictionaries in rounds and calibrate the thresholds; ``prior``: the share of toxic rows."""
    if not toxic or not ordinary:
        return Model(prior)
    rng = np.random.default_rng(seed)
    sides = []
    for texts in (toxic, ordinary):
        padded, *spans = windows(*utf8(pa.array(texts, pa.string())))
        sides.append((padded.tobytes(), *spans))

    def content(side: int, size: int, chosen: np.ndarray | None = None) -> bytes:
        text, begin, length, _ = sides[side]
        if chosen is None:
            chosen = rng.choice(len(begin), min(len(begin), TRAINING_WINDOWS), replace=False)
        chosen = np.sort(chosen)
        return _trained(text, begin[chosen], length[chosen], size)

    base = content(1, BASE_BYTES)
    model = Model(prior, content(0, OWN_BYTES) + base, content(1, OWN_BYTES) + base)
    for _ in range(rounds):
        widest = []
        for text, begin, length, _ in sides:
            gaps = model.gaps(text, begin, length, FIT_THREADS) + rng.random(len(begin)) / 2  # equal gaps in random order
            widest.append(np.argsort(-gaps)[: max(16, int(SHARE * len(gaps)))])
        model = Model(prior, content(0, OWN_BYTES, widest[0]) + base, content(1, OWN_BYTES, widest[1]) + base)
    x = np.concatenate([_features(model.gaps(t, b, n, FIT_THREADS), row, len(texts)) for (t, b, n, row), texts in zip(sides, (toxic, ordinary))])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    model.weights = _logistic((x - model.mean) / model.scale, y)
    share = len(toxic) / len(y)  # the sample holds more toxic rows than the corpus
    model.weights[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share)) if 0 < prior < 1 else 0.0
    return model


def scores(model: Model, column: pa.Array) -> np.ndarray:
    """The score of each text, 0 to 1; null counts as empty."""
    if not model.toxic:
        return np.full(len(column), model.prior)
    padded, begin, length, row = windows(*utf8(column))
    x = _features(model.gaps(padded.tobytes(), begin, length), row, len(column))
    return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), (x - model.mean) / model.scale] @ model.weights, -500, 500)))


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", STEP):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, batch.column(1)))], ["doc_id", "score"])


def _clean_batches(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text", STEP):
        own = scores(model, batch.column(batch.schema.get_field_index("text")))
        yield batch.filter(pa.array(own < threshold))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the rows of ``labels`` (doc_id, toxic) outside the held-out fold, and their texts.

    Null identifiers and labels are left out; an identifier labelled twice is toxic if
    one label says so. Without labelled rows of both kinds the score is the share of
    toxic labels, 0 without any.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id")) % FOLDS != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(True, 0) / total if total else 0.0
    texts: list[list[str]] = []
    for toxic, most in ((True, MAX_TOXIC), (False, MAX_ORDINARY)):
        some = known.where((F.col("toxic") == 1) == F.lit(toxic)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = [r["doc_id"] for r in some.select("doc_id").collect()]  # at most `most`
        rows = docs.where(F.col("doc_id").isin(ids)).select("doc_id", F.col("text").cast("string").alias("text"))
        sizes = rows.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n")).collect() if ids else []
        room, taken, place = MAX_BYTES, [], {x: i for i, x in enumerate(ids)}
        for row in sorted(sizes, key=lambda r: place[r["doc_id"]]):
            if (row["n"] or 0) <= room:
                room -= row["n"] or 0
                taken.append(row["doc_id"])
        found = rows.where(F.col("doc_id").isin(taken)).groupBy("doc_id").agg(F.max("text").alias("text")).collect() if taken else []
        texts.append(list(dict.fromkeys(r["text"] or "" for r in sorted(found, key=lambda r: place[r["doc_id"]]))))
    return fit(texts[0], texts[1], prior)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted`` for every document.

    Only the text is scored: null and empty texts get the score of an empty window,
    equal texts equal scores. A null doc_id is not held out. Repeated rows are rows of
    their own, an empty table gives no rows, other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = narrow.mapInArrow(partial(_score_batches, model=fitted(docs, labels)), "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) % FOLDS == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    return docs.mapInArrow(partial(_clean_batches, model=fitted(docs, labels), threshold=threshold), docs.schema)
