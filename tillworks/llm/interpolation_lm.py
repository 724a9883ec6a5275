"""Deleted interpolation of word n-gram estimates.

Training documents are dealt to a main part and a small held-out fold. Bigram, unigram
and uniform estimates from the main part are mixed with weights per bucket of the
context's frequency; expectation-maximisation learns the weights on the held-out
counts. Texts are then scored with the counts of all training documents:

    P(w | v) = l2 * c(v, w) / c(v) + l1 * c(w) / N + l0 / (V + 1)

Counts are exact and cover every training token. Chunks of whole texts send their
distinct n-grams with counts to key ranges and get back the corpus-wide counts in the
order they asked (see ``chunks``), so an n-gram costs one entry per chunk. For the
mixture, held-out tokens are counted by bucket and by their two likelihood ratios,
rounded to a twentieth of a power of ten; only that table reaches the driver.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.chunks import Texts, answered, asked, chunked, cuts, deltas, pack_arrays, unpack_arrays
from tillworks.llm.common import fold, lower_ascii, mix, span_hashes, staged, word_spans

FOLDS, TEST_FOLD = 7, 2
HELD_OUT = 20  # one training document in so many learns the weights
TEST, MAIN, TUNING = 0, 1, 2
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
RESOLUTION = 20
NONE = -(1 << 20)
LEAST = 1e-6
DEFAULT = np.array([0.4, 0.5, 0.1])  # bigram, unigram, uniform, where no held-out token says more
ASKED = "bucket int, chunk long, block binary"
REPLY = "chunk long, bucket int, block binary, totals array<long>"
MIXED = "context int, pair int, single int, n long"
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def token_arrays(texts: Texts):
    """For every token its key, its context's key and its row; one end token closes each text."""
    begins, ends, rows = word_spans(texts.data, texts.offsets)
    words = span_hashes(lower_ascii(texts.data), begins, ends)
    docs = len(texts.offsets) - 1
    row = np.concatenate([rows, np.arange(docs)])
    order = np.argsort(row, kind="stable")  # an end comes after its row's words
    token = np.concatenate([words, np.full(docs, END)])[order]
    row = row[order]
    context = np.empty_like(token)
    context[1:] = token[:-1]
    first = np.ones(len(token), bool)
    first[1:] = row[1:] != row[:-1]
    context[first] = START
    return token, context, row


class Asked:
    """A chunk's distinct unigram and bigram keys in order, and where each token's are."""

    def __init__(self, texts: Texts):
        self.token, context, self.row = token_arrays(texts)
        self.words, self.word_at = np.unique(self.token, return_inverse=True)
        pairs = mix(context * np.uint64(3) + self.token)
        self.pairs, self.pair_at = np.unique(pairs, return_inverse=True)
        # a context's count is its word's count, and a text begins as often as one ends
        self.context_at = np.searchsorted(self.words, np.where(context == START, END, context))
        self.marks = texts.marks[self.row]

    def counts(self) -> list[np.ndarray]:
        """Main and held-out counts of the unigrams and of the bigrams."""
        out = []
        for at, n in ((self.word_at, len(self.words)), (self.pair_at, len(self.pairs))):
            out += [np.bincount(at[self.marks == mark], minlength=n).astype(np.uint32) for mark in (MAIN, TUNING)]
        return out


def _ask(texts: Texts, buckets: int) -> pa.Table:
    own = Asked(texts)
    word_main, word_tuning, pair_main, pair_tuning = own.counts()
    words, pairs = cuts(own.words, buckets), cuts(own.pairs, buckets)
    blocks = []
    for b in range(buckets):
        w, p = slice(words[b], words[b + 1]), slice(pairs[b], pairs[b + 1])
        blocks.append(
            pack_arrays(deltas(own.words[w]), word_main[w], word_tuning[w], deltas(own.pairs[p]), pair_main[p], pair_tuning[p])
        )
    columns = [pa.array(range(buckets), pa.int32()), pa.array([texts.chunk] * buckets, pa.int64()), pa.array(blocks, pa.binary())]
    return pa.Table.from_arrays(columns, ["bucket", "chunk", "block"])


def _totalled(keys: list[np.ndarray], main: list[np.ndarray], tuning: list[np.ndarray]):
    """Corpus counts for each chunk's keys: of all training tokens, and of the main part."""
    sizes = np.cumsum([len(k) for k in keys])[:-1]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    of_main = np.bincount(at, np.concatenate(main), len(distinct)).astype(np.int64)
    of_all = of_main + np.bincount(at, np.concatenate(tuning), len(distinct)).astype(np.int64)
    return np.split(of_all[at], sizes), np.split(of_main[at], sizes), of_all, of_main


def _answer(table):
    chunks = table.column("chunk").to_pylist()
    kinds = [np.uint64, np.uint32, np.uint32] * 2
    parts = [unpack_arrays(block.as_py(), *kinds) for block in table.column("block")]
    sides, totals = [], []
    for side in (0, 3):
        keys = [np.cumsum(part[side], dtype=np.uint64) for part in parts]
        every, main, of_all, of_main = _totalled(keys, [p[side + 1] for p in parts], [p[side + 2] for p in parts])
        sides.append((every, [m[p[side + 2] > 0] for m, p in zip(main, parts)]))
        totals += [int(of_all.sum()), int((of_all > 0).sum()), int(of_main.sum()), int((of_main > 0).sum())]
    blocks = [pack_arrays(sides[0][0][i], sides[0][1][i], sides[1][0][i], sides[1][1][i]) for i in range(len(chunks))]
    bucket = table.column("bucket")[0].as_py()
    columns = [
        pa.array([*chunks, None], pa.int64()),
        pa.array([bucket] * (len(chunks) + 1), pa.int32()),
        pa.array([*blocks, None], pa.binary()),
        pa.array([None] * len(chunks) + [totals], pa.list_(pa.int64())),
    ]
    return pa.Table.from_arrays(columns, ["chunk", "bucket", "block", "totals"])


def _replied(answers: pa.Table) -> list[np.ndarray]:
    """The four answers of a chunk, key ranges in order."""
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("block").to_pylist()))
    parts = [unpack_arrays(block, *[np.int64] * 4) for _, block in rows]
    return [np.concatenate([part[i] for part in parts]) for i in range(4)]


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then one bucket for each doubling."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def _ratio(p: np.ndarray, base: float) -> np.ndarray:
    return np.where(p > 0, np.round(RESOLUTION * np.log10(np.maximum(p, 1e-300) / base)), NONE).astype(np.int64)


def _tune(texts: Texts, answers: pa.Table, tokens: int, kinds: int) -> pa.Table:
    """Held-out tokens by context bucket and likelihood ratios, from the main part's counts."""
    own = Asked(texts)
    word_main, pair_main = np.zeros(len(own.words), np.int64), np.zeros(len(own.pairs), np.int64)
    _, word_tuning, _, pair_tuning = own.counts()
    _, word_main[word_tuning > 0], _, pair_main[pair_tuning > 0] = _replied(answers)
    held = own.marks == TUNING
    context = word_main[own.context_at[held]]
    pair = pair_main[own.pair_at[held]] / np.maximum(context, 1)
    single = word_main[own.word_at[held]] / max(tokens, 1)
    base = 1 / (kinds + 1)
    rows = np.stack([context_bucket(context), _ratio(pair, base), _ratio(single, base)], 1)
    rows, n = np.unique(rows, axis=0, return_counts=True)
    columns = [pa.array(rows[:, i], pa.int64()).cast(pa.int32()) for i in range(3)] + [pa.array(n, pa.int64())]
    return pa.Table.from_arrays(columns, ["context", "pair", "single", "n"])


def mixture(rows: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights (bigram, unigram, uniform) per context bucket by expectation-maximisation.

    ``rows``: context bucket, the two rounded ratios, count. Buckets without held-out tokens
    use the weights of all buckets together, unseen contexts no bigram.
    """
    buckets = 64
    p = np.stack([np.where(rows[:, i] == NONE, 0.0, 10.0 ** (rows[:, i] / RESOLUTION)) for i in (1, 2)] + [np.ones(len(rows))], 1)

    def learned(chosen: np.ndarray, start: np.ndarray) -> np.ndarray:
        weights, n = start, rows[chosen, 3].astype(float)
        for _ in range(rounds):
            share = p[chosen] * weights
            share /= share.sum(1, keepdims=True)
            new = np.maximum((share * n[:, None]).sum(0) / n.sum(), LEAST)
            new /= new.sum()
            if np.abs(new - weights).max() < 1e-9:
                break
            weights = new
        return weights

    together = learned(np.ones(len(rows), bool), DEFAULT) if len(rows) else DEFAULT
    out = np.tile(together, (buckets, 1))
    for bucket in range(buckets):
        chosen = rows[:, 0] == bucket
        if chosen.any():
            out[bucket] = learned(chosen, out[bucket])
    out[0, 0] = 0.0
    return out / out.sum(1, keepdims=True)


def _score(texts: Texts, answers: pa.Table, tokens: int, kinds: int, weights: np.ndarray) -> pa.Table:
    own = Asked(texts)
    words, _, pairs, _ = _replied(answers)
    count, context = words[own.word_at], words[own.context_at]
    mix_of = weights[context_bucket(context)]
    p = mix_of[:, 0] * pairs[own.pair_at] / np.maximum(context, 1) + mix_of[:, 1] * count / max(tokens, 1) + mix_of[:, 2] / (kinds + 1)
    docs = len(texts.offsets) - 1
    base = np.log10((count + 1) / (tokens + (kinds + 1)))
    columns = [
        texts.id_array(),
        pa.array(np.bincount(own.row, minlength=docs)),
        pa.array(np.bincount(own.row, count > 0, docs).astype(np.int64)),
        pa.array(np.bincount(own.row, base, docs)),
        pa.array(np.bincount(own.row, np.log10(p), docs)),
    ]
    return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def scored(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learned from documents whose crc32 of doc_id modulo 7 is not 2; a null doc_id is learned
    from too. Null texts count as empty and are one end token. Scores are log10
    probabilities of the whole text. Repeated rows count and are scored each. Without
    training documents every score is 0; an empty table gives no rows. Columns besides
    id and text are not read.
    """
    spark = docs.sparkSession
    remainder = fold(F.col("doc_id"))
    mark = F.when(remainder % FOLDS == TEST_FOLD, TEST).when(F.floor(remainder / FOLDS) % HELD_OUT == 0, TUNING).otherwise(MAIN)
    chunks = chunked(docs, mark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    requests = asked(chunks, partial(_ask, buckets=buckets), ASKED)
    replies = staged(requests.groupBy("bucket").applyInArrow(_answer, REPLY), "ngram-counts")
    sums = replies.where("totals IS NOT NULL").agg(*[F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in range(4)]).first()
    tokens, kinds, main_tokens, main_kinds = sums
    answers = replies.where("chunk IS NOT NULL").select("chunk", "bucket", "block")
    tuned = answered(chunks, answers, partial(_tune, tokens=main_tokens, kinds=main_kinds), MIXED)
    table = tuned.groupBy("context", "pair", "single").agg(F.sum("n").alias("n")).collect()  # bounded by the rounding
    weights = mixture(np.array([tuple(row) for row in table], np.int64).reshape(-1, 4))
    rows = answered(chunks, answers, partial(_score, tokens=tokens, kinds=kinds, weights=weights), SCORED)
    return rows.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) % FOLDS == TEST_FOLD, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
