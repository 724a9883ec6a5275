"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tillworks.llm import components, exact_dedup, simhash, suffix_dedup


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def plain_exact(rows):
    groups = defaultdict(list)
    normal = {}
    for doc, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        normal[(doc, text)] = key
        groups[key].append(doc)
    out = []
    for doc, text in rows:
        same = groups[normal[(doc, text)]]
        keep = min((d for d in same if d is not None), default=None)
        out.append((doc, keep, len(same), doc == keep, hashlib.sha256(normal[(doc, text)].encode()).hexdigest()))
    return ordered(out)


def test_exact_groups(tricky, corpus):
    for docs in (tricky, corpus):
        rows = rows_of(docs.select("doc_id", "text"))
        assert ordered(rows_of(exact_dedup.exact_groups(docs))) == plain_exact(rows)


@pytest.mark.parametrize("runs, fan_in", [(1, 2), (5, 2), (64, 8), (9, 3)])
def test_every_tree_shape_gives_the_same_groups(corpus, runs, fan_in):
    rows = exact_dedup.digest_rows(corpus)
    merged = exact_dedup.merge_runs(rows, runs, fan_in)
    expected = {(r[4], r[1], r[2]) for r in plain_exact(rows_of(corpus.select("doc_id", "text")))}
    assert {(r["text_sha256"], r["keep_id"], r["group_size"]) for r in merged.collect()} == expected


def test_exact_keeps_all_columns(tricky):
    kept = exact_dedup.keep_first(tricky)
    assert kept.columns == tricky.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 7, 8, 9, 10, 11, 12]


def test_exact_runs_no_python(corpus):
    plan = exact_dedup.merge_runs(exact_dedup.digest_rows(corpus))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    name = list(range(len(rows)))

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                name[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return ordered([(rows[i][0], f"{prints[i]:016x}", least[find(i)]) for i in range(len(rows))])


def test_near_components(tricky, corpus):
    for docs in (tricky, corpus):
        rows = rows_of(docs.select("doc_id", "text"))
        assert ordered(rows_of(simhash.near_components(docs))) == plain_components(rows)


def clustered(seed, centres=30, each=25, most=8):
    rng = np.random.default_rng(seed)
    out = set()
    for centre in rng.integers(0, 1 << 63, centres):
        for _ in range(each):
            value = int(centre)
            for bit in rng.choice(64, rng.integers(0, most), replace=False):
                value ^= 1 << int(bit)
            out.add(value)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("bits", [2, 4, 6])
def test_links_connect_all_close_fingerprints(spark, bits):
    fps = clustered(bits, most=bits * 2)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r["node"]: r["root"] for r in components.components(simhash.near_links(nodes, bits)).collect()}
    u, v = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits)
    least = simhash._least_of(len(fps), u, v)
    group = defaultdict(set)
    for x, at in zip(fps.view(np.int64).tolist(), least.tolist()):
        group[at].add(x)
    mine = defaultdict(set)
    for x in fps.view(np.int64).tolist():
        mine[found.get(x, x)].add(x)
    assert sorted(map(sorted, group.values())) == sorted(map(sorted, mine.values()))


def test_long_postings_use_midpoints_with_the_same_result():
    fps = clustered(5, centres=1, each=600, most=5)
    keep = fps & ~np.uint64(0xFFFFFFFF) == np.bincount([0])[0]  # nothing: the centre differs in the high half
    fps = np.unique((fps & np.uint64(0xFFFFFFFF)) | (fps[0] & ~np.uint64(0xFFFFFFFF))) if not keep.all() else fps
    u, v = simhash.midpoint_links(fps, 4, np.arange(32))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    assert (simhash._least_of(len(fps), u, v) == simhash._least_of(len(fps), a, b)).all()


def test_components_of_a_path_a_star_and_nothing(spark):
    path = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(50)] + [(None, 3), (7, 7), (1, 0)]
    links = spark.createDataFrame(path, "u long, v long")
    found = dict(rows_of(components.components(links)))
    assert found == {i: 0 for i in range(1, 41)} | {1000 + i: 1000 for i in range(1, 50)}
    assert rows_of(components.components(links.limit(0))) == []


def plain_repeats(rows, length=50):
    first = {}
    big = 1 << 63
    data = [(big if d is None else d, d, (t or "").encode()) for d, t in rows]
    for order, _, text in sorted(data, key=lambda r: r[0]):
        for a in range(len(text) - length + 1):
            first.setdefault(text[a : a + length], order)
    out = []
    for order, doc, text in data:
        gone = np.zeros(len(text), bool)
        for a in range(len(text) - length + 1):
            if first[text[a : a + length]] < order:
                gone[a : a + length] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(text) else 0
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out.append((doc, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return ordered(out)


def test_repeated_passages(tricky, corpus):
    for docs in (tricky, corpus.limit(80)):
        rows = rows_of(docs.select("doc_id", "text"))
        again = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
        assert ordered(rows_of(suffix_dedup.without_repeats(again))) == plain_repeats(rows)


def test_passages_that_many_chunks_share(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_CHUNKS", 2)
    common = "x" * 30 + " the same passage in very many documents of this table " + "yz" * 20
    rows = [(i, f"{i * 7919 % 1000:05d} head {i}" * 3 + common + f" tail {i}" * 4) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert ordered(rows_of(suffix_dedup.without_repeats(docs))) == plain_repeats(rows)


def test_whole_copies_and_many_key_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 64 << 10)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 4 << 10)
    rng = np.random.default_rng(11)
    parts = ["".join(rng.choice(list("abcdé "), 90)) for _ in range(12)]
    texts = ["".join(parts[i] for i in rng.choice(12, 3)) for _ in range(25)] + [None, "", "short", "x" * 49, "x" * 50]
    ids = [*range(40), None, None, None, 7, 7]
    rows = [(i, texts[int(rng.integers(len(texts)))]) for i in ids] + [(100 + i, texts[3]) for i in range(40)]
    rows += [(None, "only without an identifier " * 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ordered(rows_of(suffix_dedup.without_repeats(docs))) == plain_repeats(rows)


@pytest.mark.parametrize("length, gram", [(50, 20), (50, 50), (21, 20), (30, 7)])
def test_hot_anchors_at_other_lengths(spark, monkeypatch, length, gram):
    monkeypatch.setattr(suffix_dedup, "HOT_CHUNKS", 1)
    rng = np.random.default_rng(length + gram)
    words = ["".join(rng.choice(list("abc"), 6)) for _ in range(9)]
    rows = [(i, " ".join(words[int(w)] for w in rng.integers(0, 9, 40)) * 2) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert ordered(rows_of(suffix_dedup.without_repeats(docs, length, gram))) == plain_repeats(rows, length)


def test_a_text_longer_than_a_chunk(spark):
    rng = np.random.default_rng(5)
    long = rng.integers(97, 123, 5 << 20).astype(np.uint8).tobytes().decode()
    rows = [(3, long), (1, "head " + long[4_000_000:4_000_200] + " tail"), (9, long[:70])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.without_repeats(docs).collect()}
    assert found == {3: (5 << 20, 200, 1), 1: (210, 0, 0), 9: (70, 70, 1)}


def test_interval_expansion_finds_short_prefixes():
    rng = np.random.default_rng(3)
    for length in (1, 2, 5, 9):
        size = rng.integers(length, 40, 30)
        text = rng.integers(97, 99, int(size.sum())).astype(np.uint8)
        least = rng.integers(0, 1000, 30)
        found = suffix_dedup.least_owner(text, size, least, length)
        begin = np.cumsum(size) - size
        want, best = [], {}
        for b, n, owner in zip(begin, size, least):
            for a in range(b, b + n - length + 1):
                key = text[a : a + length].tobytes()
                best[key] = min(best.get(key, 1 << 40), owner)
                want.append(key)
        assert found.tolist() == [best[k] for k in want]


def test_empty_tables(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.keep_first(nothing).count() == 0
    assert simhash.near_components(nothing).count() == 0
    assert suffix_dedup.without_repeats(nothing).count() == 0


def test_pieces_of_one_key_are_sorted_in_bounded_batches(monkeypatch):
    rng = np.random.default_rng(5)
    length, gram, common = 50, 20, rng.integers(97, 123, 20, np.uint8)
    key = np.uint64(7)

    def pieces(n):
        """Windows around one passage; few bytes differ, so some windows are equal and some are not."""
        size = rng.integers(length, 2 * length - gram + 1, n)
        text = [np.concatenate((rng.integers(97, 99, 30, np.uint8), common, rng.integers(97, 99, 30, np.uint8)))[30 - min(30, k - length) :][:k] for k in size.tolist()]
        return np.full(n, key), rng.integers(0, 10**6, n), size, np.concatenate(text)

    parts = [pieces(n) for n in (900, 1, 700)]
    plain = {}
    for _, least, size, text in parts:
        for one, a, n in zip(least.tolist(), (np.cumsum(size) - size).tolist(), size.tolist()):
            for w in range(a, a + n - length + 1):
                s = text[w : w + length].tobytes()
                plain[s] = min(one, plain.get(s, one))
    seen = []
    plain_owner = suffix_dedup.least_owner
    monkeypatch.setattr(suffix_dedup, "least_owner", lambda text, *rest: (seen.append(len(text)), plain_owner(text, *rest))[1])
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 4096)
    found = suffix_dedup._owners(parts, length, gram)
    for (_, _, size, text), owners in zip(parts, found):
        windows = [text[w : w + length].tobytes() for a, n in zip((np.cumsum(size) - size).tolist(), size.tolist()) for w in range(a, a + n - length + 1)]
        assert owners.tolist() == [plain[s] for s in windows]
    assert max(seen) <= 2 * 4096  # before, all pieces of the key: over 100,000 bytes
