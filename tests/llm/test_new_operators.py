"""Sharding, turn repair and token alignment against plain re-computations."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillworks.llm import sharding, token_alignment, turn_repair

# --- sharding ---------------------------------------------------------------


def plain_jump(key: int, shards: int) -> int:
    home, target = -1, 0
    while target < shards:
        home = target
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        target = int((home + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return home


def plain_key(doc_id) -> int:
    return int.from_bytes(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).digest()[:8], "big")


def test_jump_equals_the_plain_walk():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2)
    for shards in (1, 2, 7, 24, 25, 1000):
        assert sharding.jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_placed_rows_equal_plain(tricky):
    rows = sharding.placed(tricky).collect()
    want = Counter()
    for r in tricky.select("doc_id", "text").collect():
        text = (r["text"] or "").encode()
        want[r["doc_id"], len(text) + 8, zlib.crc32(text), plain_jump(plain_key(r["doc_id"]), 24), plain_jump(plain_key(r["doc_id"]), 25)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows) == want
    assert {r["law"] for r in rows} == {"key"}
    for shard in {r["shard"] for r in rows}:
        mine = sorted((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"]) for r in rows if r["shard"] == shard)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert mine == sorted(mine, key=lambda m: m[1:])


def test_slots_over_many_ranges_are_gapless(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ids = spark.range(5000).select((F.col("id") % 1700).alias("doc_id"), F.lit("x").alias("text"))
        hot = ids.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, 9).otherwise(F.col("doc_id")))
        rows = sharding.placed(hot).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 5000
    for shard in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows)


def test_no_shard_of_nothing(nothing):
    assert sharding.placed(nothing).collect() == []


def test_appended_shards_take_rows_only_into_themselves(spark, tricky, tmp_path):
    first, second = str(tmp_path / "four"), str(tmp_path / "six")
    sharding.write_shards(tricky, first, ["doc_id", "text"], 4)
    sharding.append_shards(spark, first, ["doc_id", "text"], 4, 2, second)
    old, new = spark.read.parquet(first), spark.read.parquet(second)
    assert old.drop("shard").count() == new.drop("shard").exceptAll(old.select(new.drop("shard").columns)).count() + old.count()
    assert new.count() == tricky.count()
    moved = sharding.moving(tricky, ["doc_id", "text"], 4, 2).collect()
    assert all(r["grown_shard"] >= 4 for r in moved)
    assert len(moved) == new.where("shard >= 4").count()
    with pytest.raises(Exception, match="another key or count"):
        sharding.append_shards(spark, first, ["text"], 4, 2, str(tmp_path / "wrong"))


# --- turn repair ------------------------------------------------------------

AUTOMATON = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def plain_repair(rows: list[tuple[str, str, str]]) -> tuple[int, str, list[str]]:
    """Least (cost, audit) over every sequence of edits of rows (fault, role, text), by exhaustive dynamic programming on strings."""
    ways = {0: (0, "", ())}

    def better(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserted(ways):
        ways = dict(ways)
        for _ in range(3):
            for state, (cost, audit, out) in list(ways.items()):
                for role in ("user", "assistant"):
                    if role[0] in AUTOMATON[state]:
                        better(ways, AUTOMATON[state][role[0]], (cost + 3, audit + "I", (*out, f"{role}:")))
        return ways

    for fault, role, text in rows:
        after = {}
        for state, (cost, audit, out) in inserted(ways).items():
            better(after, state, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            late = 3 * (fault == "truncated")
            if role[:1] in AUTOMATON[state]:
                better(after, AUTOMATON[state][role[:1]], (cost + late, audit + "K", (*out, f"{role}:{text}")))
            for other in ("user", "assistant"):
                if other[0] in AUTOMATON[state]:
                    better(after, AUTOMATON[state][other[0]], (cost + 3 + late, audit + "R", (*out, f"{other}:{text}")))
        ways = after
    ways = inserted(ways)
    return min(ways[s] for s in (0, 3) if s in ways)


def plain_conversations(rows: list[tuple]) -> dict:
    groups = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        groups.setdefault(conv, [])
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        groups[conv] += [(turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return {conv: plain_result(turns) for conv, turns in groups.items()}


def plain_result(turns: list[tuple]) -> dict:
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    seen, rows = set(), []
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        rows.append((fault, role, text))
    cost, audit, out = plain_repair(rows)
    known = [t for t, _, _ in turns if t is not None]
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        **{f: sum(r[0] == f for r in rows) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
        "lines": list(out),
    }


def drill(seed: int, conversations: int, most: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for i in range(rng.randint(1, most)):
            turn = rng.choice([None, i, i, i, rng.randint(0, 5)])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool", "User"])
            text = rng.choice(["Yes.", "No!", "Why?", "cut", "  ", "", None, " x. \n", f"long {i}.", "ä\u0085"])
            rows.append((conv, turn, role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def collected(frame) -> dict:
    return {r["conv_id"]: r.asDict() for r in frame.collect()}


def test_repair_equals_exhaustive_search(spark):
    rows = drill(3, 300, 12)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit("clash")).withColumn("draw", F.lit(1))
    found, want = collected(turn_repair.repaired_conversations(df)), plain_conversations(rows)
    assert found.keys() == want.keys()
    for conv, row in want.items():
        assert {k: v for k, v in found[conv].items() if k != "conv_id"} == {k: v for k, v in row.items() if k != "lines"}, conv


def test_chains_of_blocks_equal_whole_conversations(spark, monkeypatch):
    """Small blocks and many ranges: every longer conversation is a chain."""
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = drill(4, 60, 30) + [(900, t % 400, ("user", "assistant", "tool")[t % 3], f"{t % 7}.") for t in range(700)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        found, want = collected(turn_repair.repaired_conversations(df)), plain_conversations(rows)
        for conv, row in want.items():
            assert {k: v for k, v in found[conv].items() if k != "conv_id"} == {k: v for k, v in row.items() if k != "lines"}, conv
        turns = turn_repair.repaired_turns(turn_repair.damaged(df)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = {}
    for r in sorted(turns, key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["place"])):
        assert r["place"] == len(lines.setdefault(r["conv_id"], []))
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert lines == {conv: row["lines"] for conv, row in want.items() if row["lines"]}


def test_one_turn_repeated_very_often_and_nothing(spark):
    rows = [(1, 0, "user", "Hello."), *[(1, 1, "assistant", "Hi.")] * 300]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = plain_conversations(rows)[1]
    found = collected(turn_repair.repaired_conversations(df))[1]
    assert (found["cost"], found["audit"], found["duplicate"]) == (want["cost"], want["audit"], want["duplicate"])
    assert turn_repair.repaired_conversations(df.limit(0)).collect() == []


def test_tables_of_the_grammar():
    """Every stack with the same top goes on in the same way, so merging by top loses nothing."""
    accepted = re.compile("(s?(ua)+)?")
    for word in ("", "s", "ua", "sua", "uaua", "suaua", "a", "uu", "ss", "us", "uas"):
        stack = (0,)
        for symbol in word:
            stack = stack and turn_repair.LR.shift(stack, symbol)
        assert bool(stack and turn_repair.LR.accepts(stack)) == bool(accepted.fullmatch(word))
    reached, todo = {(0,)}, [(0,)]
    while todo:
        stack = todo.pop()
        for to in (turn_repair.LR.shift(stack, s) for s in "sua"):
            if to and to not in reached:
                reached.add(to)
                todo.append(to)
    futures = {}
    for stack in reached:
        ways = tuple((s, turn_repair.LR.shift(stack, s) is not None) for s in "sua")
        futures.setdefault(stack[-1], set()).add((ways, turn_repair.LR.accepts(stack)))
    assert all(len(kinds) == 1 for kinds in futures.values())


# --- token alignment --------------------------------------------------------


def plain_alignment(rows: list[tuple]) -> list[tuple]:
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    docs = []
    for doc_id, text in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False)
        b = second.encode(text or "")
        bytes_a = [bytes(byte_of[c] for c in t) for t in a.tokens]
        pieces = [second.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in bytes_a]).tolist(), np.cumsum([len(t) for t in bytes_b]).tolist()
        links = []
        for i, (low, high) in enumerate(zip([0, *ends_a], ends_a)):
            links += [(i, j) for j, (l2, h2) in enumerate(zip([0, *ends_b], ends_b)) if l2 < high and low < h2]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = []
        for low, high in zip([0, *cuts], cuts):
            groups.append(([a.ids[i] for i, e in enumerate(ends_a) if low < e <= high], [b[j] for j, e in enumerate(ends_b) if low < e <= high]))
        docs.append((doc_id, a.ids, b, groups, [(a.ids[i], b[j]) for i, j in links]))
    count = Counter(pair for d in docs for pair in d[4])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for doc_id, a, b, groups, links in docs:
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if groups else ""
        best, total = sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links)
        out.append((doc_id, len(a), len(b), len(groups), len(links), best, total, digest, sum(len(x) * len(y) for x, y in groups)))
    return out


ODD = [
    (50, "a <|endoftext|> b </s><s> <0x41>"),
    (51, "x ▁ y"),
    (52, "  two  spaces \n\n\t tabs and 　more  "),
    (53, "日本語のテキスト 한국어 🙂👩‍👩‍👧 ́e é"),
    (54, "zero \x00 byte"),
    (55, "'s 're don't 123456 a.b,c;d"),
    (56, "a" * 3000),
    (57, " "),
    (57, " "),
]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def test_alignment_equals_plain(spark, tricky, monkeypatch):
    short = tricky.where("doc_id IS NULL OR doc_id <> 10").unionByName(
        spark.createDataFrame(ODD, "doc_id long, text string"), allowMissingColumns=True
    )
    want = plain_alignment([(r["doc_id"], r["text"]) for r in short.collect()])
    assert ordered(token_alignment.aligned(short).collect()) == ordered(want)
    monkeypatch.setattr(token_alignment, "PIECE_CHARS", 7)
    monkeypatch.setattr(token_alignment, "STEP_BYTES", 50)
    monkeypatch.setattr(token_alignment, "CHUNK_BYTES", 100)
    assert ordered(token_alignment.aligned(short).collect()) == ordered(want)


def test_alignment_of_the_smallest_documents(corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.where("length(text) < 2500").collect()]
    assert ordered(token_alignment.aligned(corpus.where("length(text) < 2500")).collect()) == ordered(plain_alignment(rows))


def test_pieces_give_the_ids_of_the_whole_text(corpus):
    texts = [r["text"] for r in corpus.collect()] + [t for _, t in ODD]
    whole_json = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole_json.encode_special_tokens = True
    a, b = token_alignment.side(token_alignment.RANKS), token_alignment.side(token_alignment.PIECES)
    assert not [p for p in map(b.model.id_to_piece, range(b.model.get_piece_size())) if "▁" in p.lstrip("▁")]
    for text in texts:
        pieces = list(token_alignment.cut(text, 40))
        assert " ".join(pieces) == text
        assert np.concatenate(a.ids(pieces)).tolist() == whole_json.encode(" " + text, add_special_tokens=False).ids
        assert np.concatenate(b.ids(pieces)).tolist() == b.model.encode(text)


def test_links_are_the_overlapping_occurrences(corpus):
    few = corpus.where("doc_id < 5")
    found = token_alignment.links(few).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("shared_bytes").alias("bytes"))
    sizes = {r["doc_id"]: len(r["text"].encode()) + 1 for r in few.collect()}
    counts = {r["doc_id"]: r["n_links"] for r in token_alignment.aligned(few).collect()}
    assert {r["doc_id"]: (r["n"], r["bytes"]) for r in found.collect()} == {d: (counts[d], sizes[d]) for d in sizes}


def test_products_of_rows_equal_dense_products():
    rng = np.random.default_rng(5)
    for _ in range(20):
        dense = [rng.integers(0, 3, shape) * rng.integers(0, 2, shape) for shape in ((6, 9), (9, 4))]
        sparse = []
        for m in dense:
            rows, columns = np.nonzero(m)
            sparse.append(token_alignment.Csr(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(m))))), columns, m[rows, columns], m.shape[1]))
        product = sparse[0].times(sparse[1])
        out = np.zeros((6, 4), int)
        for i in range(6):
            at = slice(product.ends[i], product.ends[i + 1])
            out[i, product.columns[at]] = product.values[at]
        assert (out == dense[0] @ dense[1]).all()


def test_alignment_of_nothing(nothing):
    assert token_alignment.aligned(nothing).collect() == []
