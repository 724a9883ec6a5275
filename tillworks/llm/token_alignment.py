"""Links between the tokens of two tokenizers, by products of sparse incidence matrices.

For each piece of text, matrix A has a row per token of the first tokenizer and a column per
byte, B likewise; the row products of A times B transposed hold, for each pair of tokens,
how many bytes they share. Bytes where tokens of both end cut a text into groups; the products
of token-by-group matrices hold the pairs that share a group. The matrices are kept in
compressed rows and multiplied row by row (Gustavson's method), all rows of a step at once.

1. One pass reads each text once, works out everything that concerns the text alone, and
   stores it with the distinct linked pairs of ids and their counts. Rows are gathered into
   chunks of bounded text.
2. Each chunk sends its distinct pairs with counts, once. They are added up over the corpus, and
   the highest count of each second id is taken.
3. A chunk meets the totals of its own pairs and finishes its documents.

Texts are worked on in pieces that end before a single space between two other characters:
neither tokenizer has a token across such a place, so pieces give the ids of the whole text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import Scratch, runs_of, spread_ranges, staged, text_of

RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
STEP_BYTES = 1 << 20
PIECE_CHARS = 1 << 16
CHUNK_BYTES = 16 << 20
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_shared long"
)
CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")


# --- sparse matrices --------------------------------------------------------


class Csr:
    """Compressed rows: row i has columns ``columns[ends[i]:ends[i + 1]]`` with ``values`` beside them."""

    def __init__(self, ends: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.ends, self.columns, self.values, self.width = ends, columns, values, width

    @classmethod
    def of_spans(cls, ends: np.ndarray) -> Csr:
        """Token-by-byte incidence: token i covers the bytes between the ends before it and its own."""
        bytes_ = int(ends[-1]) if len(ends) else 0
        return cls(np.concatenate(([0], ends)).astype(np.int64), np.arange(bytes_), np.ones(bytes_, np.int64), bytes_)

    @classmethod
    def of_members(cls, groups: np.ndarray, width: int) -> Csr:
        """Token-by-group incidence: token i is in one group."""
        return cls(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int64), width)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))
        order = np.argsort(self.columns, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(self.columns, minlength=self.width))))
        return Csr(ends, rows[order], self.values[order], len(self.ends) - 1)

    def product_sizes(self, other: Csr) -> np.ndarray:
        """Terms that each row of the product adds up, without forming it."""
        sizes = np.concatenate(([0], np.cumsum(np.diff(other.ends)[self.columns])))
        return sizes[self.ends[1:]] - sizes[self.ends[:-1]]

    def times(self, other: Csr) -> Csr:
        """Row i of the product is the sum of other's rows that row i names, weighted; terms of a column are added."""
        sizes = np.diff(other.ends)[self.columns]
        at = spread_ranges(other.ends[:-1][self.columns], sizes)
        columns, values = other.columns[at], other.values[at] * np.repeat(self.values, sizes)
        row_sizes = self.product_sizes(other)
        key = np.repeat(np.arange(len(row_sizes)), row_sizes) * max(other.width, 1) + columns
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        first = runs_of(key)[:-1]
        key = key[first]
        values = np.add.reduceat(values, first) if len(first) else values
        rows, columns = np.divmod(key, max(other.width, 1))
        return Csr(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(row_sizes))))), columns, values, other.width)


# --- tokenizers -------------------------------------------------------------


class Side:
    """One tokenizer: ids of pieces, and the bytes of every id."""

    def __init__(self, name: str):
        self.pieces = name.endswith(".model")
        if self.pieces:
            self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
            spelled = [self._spelled(i) for i in range(self.model.get_piece_size())]
        else:
            with open(public_tokenizers.path(name), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            spelled = [b""] * (max(ranks.values()) + 1)
            for token, i in ranks.items():
                spelled[i] = token
        self.sizes = np.array([len(t) for t in spelled], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(spelled), np.uint8)

    def _spelled(self, i: int) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(self.model.id_to_piece(i)[3:-1], 16)])
        return self.model.id_to_piece(i).replace("▁", " ").encode()

    def ids(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of a space and each piece; the second kind of tokenizer adds that space itself."""
        if self.pieces:
            return [np.array(ids, np.int64) for ids in self.model.encode(pieces, num_threads=1)]
        return [np.array(self.model.encode_ordinary(" " + piece), np.int64) for piece in pieces]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread_ranges(self.begins[ids], self.sizes[ids])]


_SIDES = Scratch()


def side(name: str) -> Side:
    if name not in _SIDES:
        _SIDES[name] = Side(name)
    return _SIDES[name]


def cut(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of about ``limit`` characters; the space between two pieces is left to the second."""
    at = 0
    while len(text) - at > limit:
        found = CUT.search(text, at + limit)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


# --- one text ---------------------------------------------------------------

# Digits of every number below 100,000 from the left, filled up with zeros, and how many there are.
_WIDTH = 5


def _digits() -> tuple[np.ndarray, np.ndarray]:
    if "digits" not in _SIDES:
        numbers = np.arange(10**_WIDTH)
        size = np.maximum(1, np.ceil(np.log10(numbers + 1)).astype(np.int64))
        place = size[:, None] - 1 - np.arange(_WIDTH + 1)
        digits = np.where(place >= 0, numbers[:, None] // 10 ** np.maximum(place, 0) % 10 + 48, 0).astype(np.uint8)
        _SIDES["digits"] = digits, size
    return _SIDES["digits"]


def spelled_groups(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` as bytes, and where each group ends; every group ends with a semicolon."""
    digits, sizes = _digits()
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    count_a, count_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    before_a, before_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    last = np.full(len(ids), 44, np.uint8)
    ids[np.arange(len(ids_a)) + before_b[group_a]] = ids_a
    ids[np.arange(len(ids_b)) + (before_a + count_a)[group_b]] = ids_b
    last[before_a + before_b + count_a - 1] = 124
    ends = np.cumsum(count_a + count_b)
    last[ends - 1] = 59
    out = digits[ids]
    out[np.arange(len(ids)), sizes[ids]] = last
    data = out[np.arange(_WIDTH + 1) <= sizes[ids][:, None]]
    return data, np.cumsum(sizes[ids] + 1)[ends - 1]


class Step:
    """The links of several pieces, each covered by both tokenizers byte for byte."""

    def __init__(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], side_a: Side, side_b: Side):
        self.ids_a, self.ids_b = np.concatenate(ids_a), np.concatenate(ids_b)
        ends_a, ends_b = np.cumsum(side_a.sizes[self.ids_a]), np.cumsum(side_b.sizes[self.ids_b])
        bytes_ = int(ends_a[-1])
        both = np.zeros(bytes_ + 1, bool)
        both[ends_a] = True
        shared = np.zeros(bytes_ + 1, bool)
        shared[ends_b] = True
        both &= shared
        number = np.cumsum(both)
        self.group_a, self.group_b = number[ends_a - 1], number[ends_b - 1]
        groups = int(number[-1])
        # Overlap: token-by-byte times its counterpart transposed.
        links = Csr.of_spans(ends_a).times(Csr.of_spans(ends_b).transposed())
        self.link_a = np.repeat(np.arange(len(self.ids_a)), np.diff(links.ends))
        self.link_b, self.overlap = links.columns, links.values
        # Shared groups: how many terms each row of that product has; a large group's pairs are never formed.
        in_a, in_b = Csr.of_members(self.group_a, groups), Csr.of_members(self.group_b, groups).transposed()
        self.shared = in_a.product_sizes(in_b)
        self.data, self.group_end = spelled_groups(self.ids_a, self.ids_b, self.group_a, self.group_b)
        self.tokens_a = np.cumsum([0, *map(len, ids_a)])
        self.tokens_b = np.cumsum([0, *map(len, ids_b)])
        self.links = links.ends

    def piece(self, i: int) -> dict:
        """Figures of piece i, its pairs of ids as numbers (with repeats), and its groups as text."""
        a, b = self.tokens_a[i : i + 2], self.tokens_b[i : i + 2]
        low, high = self.group_a[a[0]], self.group_a[a[1] - 1] + 1
        links = slice(self.links[a[0]], self.links[a[1]])
        begin = self.group_end[low - 1] if low else 0
        return {
            "n_a": int(a[1] - a[0]),
            "n_b": int(b[1] - b[0]),
            "n_groups": int(high - low),
            "n_shared": int(self.shared[a[0] : a[1]].sum()),
            "codes": (self.ids_a[self.link_a[links]] << 16) | self.ids_b[self.link_b[links]],
            "text": self.data[begin : self.group_end[high - 1]],
        }


class Document:
    """Adds up the pieces of one text; a piece that the tokens do not cover byte for byte voids all."""

    def __init__(self, doc_id: int | None):
        self.doc_id, self.void, self.begun = doc_id, False, False
        self.figures = dict.fromkeys(("n_a", "n_b", "n_groups", "n_shared"), 0)
        self.hash, self.codes, self.counts = hashlib.sha256(), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, piece: dict) -> None:
        for name in self.figures:
            self.figures[name] += piece[name]
        # The last semicolon waits: it stands between groups only.
        self.hash.update((b";" if self.begun else b"") + piece["text"][:-1].tobytes())
        self.begun = True
        self.codes, self.counts = _added(np.concatenate((self.codes, piece["codes"])), np.concatenate((self.counts, np.ones(len(piece["codes"]), np.int64))))

    def row(self) -> dict:
        if self.void or not self.begun:
            none = np.empty(0, np.int64)
            return {"doc_id": self.doc_id, **dict.fromkeys(self.figures, 0), "groups_sha256": "", "codes": none, "counts": none}
        return {"doc_id": self.doc_id, **self.figures, "groups_sha256": self.hash.hexdigest(), "codes": self.codes, "counts": self.counts}


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with their counts added."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    first = runs_of(codes[order])[:-1]
    return codes[order][first], np.add.reduceat(counts[order], first)


def documents(rows: Iterator[tuple[int | None, bytes | None]], name_a: str, name_b: str) -> Iterator[tuple[dict, int]]:
    """Each document's own results and its size, in order; pieces of several documents are worked on together."""
    side_a, side_b = side(name_a), side(name_b)
    waiting: list[tuple[Document, int]] = []  # finished reading, pieces perhaps not yet worked on
    pieces: list[tuple[Document, str]] = []
    size = 0

    def work() -> None:
        covered, ids = [], ([], [])
        found = zip(pieces, side_a.ids([p for _, p in pieces]), side_b.ids([p for _, p in pieces]))
        for (doc, piece), a, b in found:
            wanted = np.frombuffer(b" " + piece.encode(), np.uint8)
            if doc.void or not all(np.array_equal(s.bytes_of(i), wanted) for s, i in ((side_a, a), (side_b, b))):
                doc.void = True
                continue
            covered.append(doc)
            ids[0].append(a)
            ids[1].append(b)
        if covered:
            step = Step(*ids, side_a, side_b)
            for i, doc in enumerate(covered):
                if not doc.void:
                    doc.add(step.piece(i))
        pieces.clear()

    for doc_id, text in rows:
        doc = Document(doc_id)
        try:
            text_ = (text or b"").decode()
        except UnicodeDecodeError:  # no text: the tokenizers take characters
            text_ = ""
        for piece in cut(text_) if text_ else ():
            pieces.append((doc, piece))
            size += len(piece)
            if size >= STEP_BYTES:
                work()
                size = 0
        waiting.append((doc, len(text or b"")))
        if not pieces:
            yield from ((d.row(), n) for d, n in waiting)
            waiting.clear()
    if pieces:
        work()
    yield from ((d.row(), n) for d, n in waiting)


# --- the corpus -------------------------------------------------------------

FIRST = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_shared long, groups_sha256 string, codes array<long>, counts array<long>"
_FIRST = pa.schema(
    [(n, pa.int64()) for n in ("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_shared")]
    + [("groups_sha256", pa.string()), ("codes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)
_LAST = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in re.findall(r"(\w+) (?:long|string)", RESULT)])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes | None]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def _read(batches: Iterator[pa.RecordBatch], name_a: str, name_b: str) -> Iterator[pa.RecordBatch]:
    """Documents with their own results; a chunk is closed after ``CHUNK_BYTES`` of text."""
    chunk, size, out, held = TaskContext.get().partitionId() << 32, 0, [], 0
    for row, n in documents(_texts(batches), name_a, name_b):
        out.append(row | {"chunk": chunk})
        size, held = size + n, held + n
        if size >= CHUNK_BYTES:
            chunk, size = chunk + 1, 0
        if held >= STEP_BYTES or len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, _FIRST)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, _FIRST)


PAIRS = "chunk long, code long, n long"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of the chunks of a batch with their counts; Spark adds the rest."""
    for batch in batches:
        chunks = np.repeat(np.asarray(batch.column(0)), np.asarray(batch.column(1).value_lengths()))
        codes, counts = (np.asarray(batch.column(i).flatten()) for i in (1, 2))
        for chunk in np.unique(chunks):
            own = chunks == chunk
            distinct, total = _added(codes[own], counts[own])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), chunk)), pa.array(distinct), pa.array(total)], ["chunk", "code", "n"])


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(np.asarray(c.flatten()) for c in column.chunks)])


def _finish(key: tuple, docs: pa.Table, totals: pa.Table) -> pa.Table:
    """Look the totals of a chunk's pairs up and add them over the links of each of its documents."""
    codes, counts = _flat(docs["codes"]), _flat(docs["counts"])
    sizes = np.concatenate([np.empty(0, np.int64), *(np.asarray(c.value_lengths()) for c in docs["codes"].chunks)]).astype(np.int64)
    known = np.asarray(totals["code"])
    order = np.argsort(known)
    at = order[np.searchsorted(known[order], codes)] if len(known) else np.empty(0, np.int64)
    total, best = np.asarray(totals["total"])[at], np.asarray(totals["best"])[at]
    ends = np.concatenate(([0], np.cumsum(sizes)))

    def summed(values: np.ndarray) -> pa.Array:
        running = np.concatenate(([0], np.cumsum(values)))
        return pa.array(running[ends[1:]] - running[ends[:-1]], pa.int64())

    found = {"n_links": summed(counts), "n_best": summed(counts * best), "count_sum": summed(counts * total)}
    return pa.table([found[n] if n in found else docs[n] for n in _LAST.names], schema=_LAST)


def first_pass(docs: DataFrame, name_a: str = RANKS, name_b: str = PIECES) -> DataFrame:
    """What each text gives on its own, stored: ``FIRST``. Codes are ``a * 65536 + b``, distinct per document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").cast("binary").alias("text"))
    return staged(rows.mapInArrow(partial(_read, name_a=name_a, name_b=name_b), FIRST), "token-links")


def pair_counts(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs per chunk, and ``code, total, best`` of the corpus: links of each pair of ids, and whether its second id has none more often."""
    per_chunk = staged(first.select("chunk", "codes", "counts").where("size(codes) > 0").mapInArrow(_pairs, PAIRS), "pairs-of-chunks")
    totals = staged(per_chunk.groupBy("code").agg(F.sum("n").alias("total")), "pair-totals")
    most = totals.groupBy((F.col("code") % 65536).alias("b")).agg(F.max("total").alias("most"))
    best = totals.join(most, F.col("code") % 65536 == F.col("b"))
    return per_chunk, best.select("code", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))


def aligned(docs: DataFrame, name_a: str = RANKS, name_b: str = PIECES) -> DataFrame:
    """Rows ``RESULT`` of every document; ``n_shared`` counts the pairs of tokens that share a group.

    Null and empty texts, and texts whose tokens do not spell a space and the text (a text that holds
    U+2581, for example), have no tokens: zeros and an empty hash. Repeated rows count each time.
    A null doc_id is kept. Extra columns are not read; an empty table gives no rows. A text without
    any single space between other characters is one piece, and bounds the memory of its task.
    """
    first = first_pass(docs, name_a, name_b)
    per_chunk, totals = pair_counts(first)
    answers = per_chunk.select("chunk", "code").distinct().join(totals, "code").select("chunk", "code", "total", "best")
    return first.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_finish, RESULT)


LINKS = "doc_id long, a_index long, a_id long, b_index long, b_id long, shared_bytes long"


def _links(batches: Iterator[pa.RecordBatch], name_a: str, name_b: str) -> Iterator[pa.RecordBatch]:
    side_a, side_b = side(name_a), side(name_b)
    for doc_id, text in _texts(batches):
        before, out = [0, 0], []
        try:
            pieces = list(cut(text.decode())) if text else []
        except UnicodeDecodeError:
            pieces = []
        for piece in pieces:
            a, b = side_a.ids([piece])[0], side_b.ids([piece])[0]
            wanted = np.frombuffer(b" " + piece.encode(), np.uint8)
            if not (np.array_equal(side_a.bytes_of(a), wanted) and np.array_equal(side_b.bytes_of(b), wanted)):
                out = []
                break
            step = Step([a], [b], side_a, side_b)
            columns = [np.full(len(step.link_a), 0), step.link_a + before[0], a[step.link_a], step.link_b + before[1], b[step.link_b], step.overlap]
            out.append(columns[1:])
            before = [before[0] + len(a), before[1] + len(b)]
        for columns in out:
            ids = pa.array([doc_id] * len(columns[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], [c.split()[0] for c in LINKS.split(", ")])


def links(docs: DataFrame, name_a: str = RANKS, name_b: str = PIECES) -> DataFrame:
    """The links themselves: a row per pair of token occurrences that share bytes, ``LINKS``. Nothing is shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").cast("binary").alias("text"))
    return rows.mapInArrow(partial(_links, name_a=name_a, name_b=name_b), LINKS)
