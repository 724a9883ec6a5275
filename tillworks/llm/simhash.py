"""SimHash near-duplicates through postings of positional fingerprint bytes.

A fingerprint has eight bytes. Fingerprints that differ in at most ``max_bits`` bits
differ in at most ``max_bits`` bytes, so they agree in 8 - max_bits positions at
least: the guaranteed minimum of matches. Single (position, byte) postings would hold
1/256 of all documents each, so the index posts every set of that many positions
with their bytes at once; a posting is then as rare as the match it guarantees,
and its lists stay short at any size. For a pair in one posting the shared positional
bytes are tallied; the pair is taken at the first set it shares only, and verified
by its differing bits.

Copies share one fingerprint and are one node. A posting list of more than
``PAIRWISE`` fingerprints is not compared pair by pair: two of them are linked if and
only if both reach a common midpoint by flipping at most half the bits each, so
fingerprints are grouped by midpoint, and each group is tied to its least member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import lower_ascii, runs_of, staged, steps, utf8, word_spans
from tillworks.llm.components import components

WORDS = 4
MAX_BITS = 4
SEED = 42
PAIRWISE = 256
MIDPOINTS_AT_ONCE = 4_000_000


def shingle_spans(begins, ends, rows, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of every run of ``words`` words; a shorter row is one run."""
    if not len(begins):
        return begins, ends, rows
    bounds = runs_of(rows)
    first, count = bounds[:-1], np.diff(bounds)
    size = np.maximum(count - words + 1, 1)
    starts = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    last = np.minimum(starts + words, np.repeat(bounds[1:], size)) - 1
    return begins[starts], ends[last], np.repeat(rows[first], size)


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each row; 0 without words."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    begins, ends, rows = word_spans(data, offsets)
    if not len(begins):
        return out
    lower = lower_ascii(data)
    sizes = ends - begins
    gap_one = (begins[1:] - ends[:-1] == 1) | (rows[1:] != rows[:-1])
    if gap_one.all():
        lower[(lower == 32) | ((lower >= 9) & (lower <= 13))] = 32
    else:  # words and single spaces only
        at = np.cumsum(sizes + 1) - sizes - 1
        joined = np.full(int(at[-1] + sizes[-1]), 32, np.uint8)
        step = np.ones(int(sizes.sum()), np.int64)
        heads = np.cumsum(sizes) - sizes
        for target, source in ((at, "to"), (begins, "from")):
            step[:] = 1
            step[heads[0]] = target[0]
            step[heads[1:]] = target[1:] - target[:-1] - sizes[:-1] + 1
            if source == "to":
                to = np.cumsum(step)
            else:
                joined[to] = lower[np.cumsum(step)]
        lower, begins, ends = joined, at, at + sizes
    starts, stops, owner = shingle_spans(begins, ends, rows, words)
    text, digest = lower.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], seed) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, len(starts))
    bounds = runs_of(owner)
    at, limit = 0, 1 << 18
    while at < len(bounds) - 1:  # bits are counted for some rows at a time; a long row in pieces
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        lo, hi = bounds[at], bounds[stop]
        counts = np.zeros((stop - at, 64), np.int64)
        for piece in range(lo, hi, limit):
            end = min(piece + limit, hi)
            bits = np.unpackbits(hashes[piece:end].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            inner = np.maximum(bounds[at:stop], piece) - piece
            inside = (bounds[at:stop] < end) & (bounds[at + 1 : stop + 1] > piece)
            counts[inside] += np.add.reduceat(bits, inner[inside], axis=0, dtype=np.int64)
        over = counts * 2 > np.diff(bounds[at : stop + 1])[:, None]
        out[owner[bounds[at:stop]]] = np.packbits(over, axis=1).reshape(-1).view(">u8")
        at = stop
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        data, offsets = utf8(batch.column(1))
        values = fingerprints(data, offsets, words, seed).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])


def fingerprint_rows(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(partial(_fingerprint_batches, words=words, seed=seed), "doc_id long, fp long")


def _postings(batches: Iterator[pa.RecordBatch], matches: int) -> Iterator[pa.RecordBatch]:
    sets = list(combinations(range(8), matches))
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            fps = batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
            octets = fps.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.uint64)
            keys = []
            for number, places in enumerate(sets):
                key = np.full(len(fps), number, np.uint64)
                for place in places:
                    key = (key << np.uint64(8)) | octets[:, place]
                keys.append(key)
            keys = np.concatenate(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(fps.view(np.int64), len(sets)))], ["posting", "fp"])


def _least_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least place connected with each of n places."""
    least = np.arange(n)
    while len(u):
        low = np.minimum(least[u], least[v])
        old = least.copy()
        np.minimum.at(least, u, low)
        np.minimum.at(least, v, low)
        np.minimum.at(least, old[u], low)
        np.minimum.at(least, old[v], low)
        least = least[least]
        if np.array_equal(old, least):
            break
    return least


def _first_shared(x: np.ndarray, matches: int) -> np.ndarray:
    """Of differences, the number of the first set of positions that are equal in all; -1 if too few are."""
    same = np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8) == 0
    code = np.packbits(same, axis=1)[:, 0]
    table = np.full(256, -1, np.int64)
    numbers = {places: i for i, places in enumerate(combinations(range(8), matches))}
    for bits in range(256):
        places = tuple(p for p in range(8) if bits >> (7 - p) & 1)
        if len(places) >= matches:
            table[bits] = numbers[places[:matches]]
    return table[code]


def _pairwise(keys: np.ndarray, fps: np.ndarray, bounds: np.ndarray, matches: int, bits: int):
    """Star links inside lists of at most PAIRWISE fingerprints."""
    size = np.diff(bounds)
    left = np.repeat(bounds[1:], size) - np.arange(bounds[0], bounds[-1]) - 1  # rows that follow in the same list
    rows = np.flatnonzero(left > 0)
    us, vs = [], []
    d = 1
    while len(rows):
        x = fps[rows] ^ fps[rows + d]
        near = np.bitwise_count(x) <= bits
        hit, x = rows[near], x[near]
        if len(hit):
            first = _first_shared(x, matches) == (keys[hit] >> np.uint64(8 * matches)).astype(np.int64)
            us.append(hit[first])
            vs.append(hit[first] + d)
        d += 1
        rows = rows[left[rows] >= d]
    if not us:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    u, v = np.concatenate(us), np.concatenate(vs)
    least = _least_of(len(fps), u, v)
    moved = np.flatnonzero(least != np.arange(len(fps)))
    return moved, least[moved]


def midpoint_links(fps: np.ndarray, bits: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that differ only in the ``free`` bits, by common midpoints."""
    half = -(-bits // 2)
    masks = [0]
    for flips in range(1, half + 1):
        masks += [sum(1 << int(b) for b in chosen) for chosen in combinations(free, flips)]
    masks = np.array(masks, np.uint64)
    parts = max(1, -(-len(fps) * len(masks) // MIDPOINTS_AT_ONCE))
    us, vs = [], []
    for part in range(parts):
        points, owners = [], []
        for at in range(0, len(masks), 64):
            mid = fps[:, None] ^ masks[None, at : at + 64]
            own = np.broadcast_to(np.arange(len(fps))[:, None], mid.shape)
            take = (mid * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts) == part
            points.append(mid[take])
            owners.append(own[take])
        points, owners = np.concatenate(points), np.concatenate(owners)
        order = np.lexsort((owners, points))
        points, owners = points[order], owners[order]
        bounds = runs_of(points)
        least = np.repeat(owners[bounds[:-1]], np.diff(bounds))
        moved = owners != least
        # the midpoint is within `half` of both, so an odd limit needs the distance itself
        pairs = np.unique(np.stack([owners[moved], least[moved]], 1), axis=0)
        if bits % 2:
            raise ValueError("an even number of bits")
        us.append(pairs[:, 0])
        vs.append(pairs[:, 1])
    u, v = np.concatenate(us), np.concatenate(vs)
    least = _least_of(len(fps), u, v)
    moved = np.flatnonzero(least != np.arange(len(fps)))
    return moved, least[moved]


def _links(batches: Iterator[pa.RecordBatch], matches: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted postings; the list at the end of a batch waits for the next one."""
    sets = list(combinations(range(8), matches))

    def linked(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = runs_of(keys)
        size = np.diff(bounds)
        small = np.repeat((size > 1) & (size <= PAIRWISE), size)
        found = []
        if small.any():
            k, f = keys[small], fps[small]
            u, v = _pairwise(k, f, runs_of(k), matches, bits)
            found.append((f[u], f[v]))
        for i in np.flatnonzero(size > PAIRWISE):
            part = fps[bounds[i] : bounds[i + 1]]
            places = sets[int(keys[bounds[i]] >> np.uint64(8 * matches))]
            free = np.array([8 * p + b for p in range(8) if p not in places for b in range(8)])
            u, v = midpoint_links(part, bits, free)
            found.append((part[u], part[v]))
        for u, v in found:
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    keys, fps = np.empty(0, np.uint64), np.empty(0, np.uint64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        waiting.append((k, f))
        if k[0] == k[-1] or sum(len(x[0]) for x in waiting) < 50_000:
            continue
        keys, fps = (np.concatenate(x) for x in zip(*waiting))
        cut = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1], "left"))
        yield from linked(keys[:cut], fps[:cut])
        waiting = [(keys[cut:], fps[cut:])]
    if waiting:
        keys, fps = (np.concatenate(x) for x in zip(*waiting))
        yield from linked(keys, fps)


def near_links(nodes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links ``u, v`` that connect all fingerprints within ``bits`` of each other; ``nodes``: distinct ``fp``."""
    if bits % 2 or not 0 < bits < 8:
        raise ValueError("two, four or six bits")
    matches = 8 - bits
    postings = nodes.select("fp").mapInArrow(partial(_postings, matches=matches), "posting long, fp long")
    lists = postings.repartition("posting").sortWithinPartitions("posting", "fp")
    return lists.mapInArrow(partial(_links, matches=matches, bits=bits), "u long, v long")


def near_components(docs: DataFrame, words: int = WORDS, bits: int = MAX_BITS) -> DataFrame:
    """For every row of ``doc_id, text``: ``doc_id, fingerprint, component_id``.

    The component is named by the smallest doc_id that links reach, the document's
    own included. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Texts without
    words, null included, have fingerprint zero and link like any other; a text with
    fewer words than a shingle is one shingle. Repeated rows are rows of their own.
    Documents with null ids link others but name no component, unless no id is left:
    then it is null. An empty table gives no rows; other columns are not read.
    """
    rows = staged(fingerprint_rows(docs, words), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    stars = components(near_links(nodes, bits))
    members = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    members = staged(members.join(nodes, members["node"] == nodes["fp"]).select("fp", "root", "least"), "members")
    named = staged(members.groupBy("root").agg(F.min("least").alias("component_id")), "component-names")
    linked = staged(members.join(named, "root").select("fp", "component_id"), "component-members")
    alone = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(staged(alone, "components"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
