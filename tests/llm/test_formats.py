"""Packing, archives, preference pairs, and the pipeline."""

import base64
import gzip
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tillworks.llm import decontamination, exact_dedup, packing, preferences, toxicity, warc

from .test_near_copies import plain_groups


def grid(axes, bits):
    return np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)


@pytest.mark.parametrize("axes, bits", [(2, 1), (2, 5), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(axes, bits):
    points = grid(axes, bits)
    keys = packing.hilbert_keys(points, bits)
    order = np.argsort(keys)
    assert keys[order].tolist() == list(range(len(points)))
    assert (np.abs(np.diff(points[order], axis=0)).sum(1) == 1).all()


def check_pieces(docs, sequence):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    ids = {}
    for doc, text in rows:
        own = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        ids.setdefault(doc, []).append(own)
    pieces = packing.packed(docs, sequence).collect()
    assert sum(p["length"] for p in pieces) == sum(len(x) for own in ids.values() for x in own)
    starts = {}
    for p in pieces:
        fits = [x for x in ids[p["doc_id"]] if len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]]
        assert fits
        starts.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for doc, own in ids.items():
        if len(own) == 1:
            cut = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == doc)
            assert [a for a, _ in cut] == [0, *np.cumsum([n for _, n in cut])[:-1].tolist()]
            assert sum(n for _, n in cut) == len(own[0])
    for parts in starts.values():
        parts.sort()
        size = sum(n for _, n in parts)
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
        assert size == sequence or size & (size - 1) == 0 and size < sequence


@pytest.mark.parametrize("sequence", [2048, 100])
def test_every_id_is_packed_once(corpus, tricky, sequence):
    check_pieces(corpus.limit(60), sequence)
    check_pieces(tricky, sequence)


def test_copies_are_neighbours(spark):
    a, b = "alpha beta gamma delta " * 30, "un deux trois quatre cinq " * 30
    docs = spark.createDataFrame([(i, a if i % 2 else b) for i in range(20)], "doc_id long, text string").repartition(5)
    order = packing.packed(docs).orderBy("sequence_id", "offset").collect()
    sides = [r["doc_id"] % 2 for r in order]
    assert sum(x != y for x, y in zip(sides, sides[1:])) <= 1


def test_special_tokens_in_a_text_are_those_of_the_file_as_loaded(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext|", " <|endoftext|>\n", "<|ENDOFTEXT|>"]
    for text in texts:
        assert packing.token_ids(text).tolist() == library.encode(text, add_special_tokens=False).ids + [1]
    assert packing.token_ids(texts[0]).tolist() == [64, 220, 50256, 275, 1]
    check_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2048)


def test_packing_nothing(nothing):
    assert packing.packed(nothing).count() == 0


PAGES = [
    (1, "http://a/1", "<p>same</p>"),
    (2, "http://a/2", "<p>same</p>"),
    (3, None, None),
    (4, "http://a/4", ""),
    (5, "http://a/5", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nünï" * 50),
    (6, "http://a/6\r\nX: y", "é" * 100_000),
    (None, "http://a/7", "<p>same</p>"),
    (None, "http://a/8", "only without id"),
    (9, "http://a/9", "\0 zero \0"),
    (9, "http://a/9", "\0 zero \0"),
]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1)).withColumn("target", F.lit(7))


@pytest.mark.parametrize("min_bytes", [0, 12])
def test_archives_round_trip(spark, pages, min_bytes):
    records = warc.read_archives(spark, warc.deduplicated_archives(pages, min_bytes)).collect()
    assert len(records) == len(PAGES)
    groups = {}
    for page, _, html in PAGES:
        groups.setdefault((html or "").encode(), []).append(page)
    want = []
    for page, _, html in PAGES:
        body = (html or "").encode()
        known = [p for p in groups[body] if p is not None]
        revisit = len(body) >= min_bytes and len(groups[body]) > 1 and known and page != max(known)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((page, len(body), digest, "revisit" if revisit else "response", max(known) if revisit else None, None if revisit else body))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in records]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_archive_files_are_cut_by_bytes(spark, tmp_path):
    rng = np.random.default_rng(1)
    given = [(i, f"http://a/{i}", rng.bytes(n // 2).hex()) for i, n in enumerate([200_000] * 12 + [3_000_000, 10, 10])]
    pages = spark.createDataFrame(given, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "warc")
    warc.write_archives(warc.resolved(pages).coalesce(1), path, file_bytes=500_000)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "warc").rglob("part-*"))
    assert len(sizes) > 3 and sizes[-2] <= 500_000 < sizes[-1]
    records = warc.read_archives(spark, path).collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in records) == [(i, t) for i, _, t in given]


def test_members_are_plain_gzip():
    small, large = b"x" * 1000, np.random.default_rng(0).bytes(17 << 20)
    for data in (small, large, b""):
        member = warc.gzip_member(data)
        assert member[-1] == 0 and gzip.decompress(member) == data


def test_a_damaged_record_is_refused():
    record = warc.record_bytes(1, "u", hashlib.sha1(b"body").hexdigest(), 4, None, b"body")
    list(warc.parse_records(warc.gzip_member(record)))
    with pytest.raises(ValueError):
        list(warc.parse_records(warc.gzip_member(record.replace(b"Content-Length: 4", b"Content-Length: 3"))))


def test_archives_of_nothing(spark, pages):
    assert warc.read_archives(spark, warc.deduplicated_archives(pages.limit(0))).count() == 0


TURNS = "pair_id long, turn long, role string, text string"


def formatted(spark, chosen, rejected):
    frames = [spark.createDataFrame(rows, TURNS).withColumn("place", F.lit("clash")).withColumn("part", F.lit(0)) for rows in (chosen, rejected)]
    rows = preferences.format_preferences(*frames).collect()
    answers = [r["rendered"][r["train_from"] :] for r in rows if r["train"]]
    assert all(r["rendered"] == f"<|assistant|>\n{a}" for r, a in zip((r for r in rows if r["train"]), answers))
    assert all(r["train_from"] is None for r in rows if not r["train"])
    return sorted((r["pair_id"], r["part"], r["place"], r["rendered"], r["train"]) for r in rows)


def turn(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def test_preferences_share_a_prompt(spark):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "thanks")]
    rejected = [(1, 0, "user", "hi"), (1, 5, "assistant", "bad")]
    assert formatted(spark, chosen, rejected) == [
        (1, "chosen", 1, turn("assistant", "good"), True),
        (1, "chosen", 2, turn("user", "thanks"), False),
        (1, "prompt", 0, turn("user", "hi"), False),
        (1, "rejected", 1, turn("assistant", "bad"), True),
    ]


def test_preferences_prefixes_nulls_and_unpaired(spark):
    chosen = [(1, 0, "user", None), (1, None, "system", "s"), (2, 0, "user", "x"), (3, 0, None, ""), (None, 0, "user", "x"), (4, 0, "user", "a"), (4, 0, "user", "a")]
    rejected = [(1, None, "system", "s"), (1, 0, "user", None), (1, 1, "assistant", "more"), (3, 0, "", ""), (4, 0, "user", "a")]
    assert formatted(spark, chosen, rejected) == [
        (1, "prompt", 0, turn("system", "s"), False),
        (1, "prompt", 1, turn("user", ""), False),
        (1, "rejected", 2, turn("assistant", "more"), True),
        (3, "chosen", 0, turn("", ""), False),
        (3, "rejected", 0, turn("", ""), False),
        (4, "chosen", 1, turn("user", "a"), False),
        (4, "prompt", 0, turn("user", "a"), False),
    ]


def plain_echo_pairs(rows):
    """Parts of every conversation by lists."""
    order = lambda r: [(x is not None, x if x is not None else 0) for x in r]
    talks = {}
    for conv, *turn_row in rows:
        if conv is not None:
            talks.setdefault(conv, []).append(tuple(turn_row))
    out = []
    for conv, turns in talks.items():
        turns.sort(key=order)
        replies = [t for t, role, _ in turns if role == "assistant"]
        other = turns
        if replies:
            reply = replies[-1]
            other = [r for r in turns if order(r[:1]) < order((reply,))] + [(reply, "assistant", turns[0][2])]
        same = 0
        while same < min(len(turns), len(other)) and turns[same][1:] == other[same][1:]:
            same += 1
        show = lambda part, place, r: (conv, part, place, turn(r[1] or "", r[2] or ""), part != "prompt" and r[1] == "assistant")
        out += [show("prompt" if i < same else "chosen", i, r) for i, r in enumerate(turns)]
        out += [show("rejected", i, r) for i, r in enumerate(other) if i >= same]
    return sorted(out)


def test_every_conversation_has_rows(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"),
        (2, 0, "user", "only a question"), (2, 1, "system", None),  # no answer: all prompt
        (3, None, "user", "first"), (3, 1, "assistant", "x"), (3, 1, "assistant", "y"), (3, 1, "user", "z"),
        (4, None, "assistant", "an answer without a turn"), (4, None, None, None), (4, 3, "user", "u"),
        (5, 2, None, None), (5, 2, "assistant", None),
        (6, 1, "assistant", "same"), (6, 1, "assistant", "same"),
        (7, None, None, "x"),
        (None, 0, "user", "of no conversation"),
    ]
    talks = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = preferences.format_preferences(*preferences.echo_pairs(talks)).collect()
    assert sorted((r["pair_id"], r["part"], r["place"], r["rendered"], r["train"]) for r in got) == plain_echo_pairs(rows)
    assert {r["pair_id"] for r in got} == {1, 2, 3, 4, 5, 6, 7}

    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = preferences.format_preferences(*preferences.echo_pairs(given)).collect()
    assert sorted((r["pair_id"], r["part"], r["place"], r["rendered"], r["train"]) for r in got) == plain_echo_pairs([tuple(r) for r in given.collect()])


def test_long_conversations_are_counted_in_blocks(spark):
    n = 5000
    chosen = [(1, i, "user", str(i)) for i in range(n)]
    rejected = chosen[:3210] + [(1, 3210, "assistant", "other")]
    rows = formatted(spark, chosen, rejected)
    assert sum(r[1] == "prompt" for r in rows) == 3210 and sum(r[1] == "chosen" for r in rows) == n - 3210
    assert [r for r in rows if r[1] == "rejected"] == [(1, "rejected", 3210, turn("assistant", "other"), True)]


def test_preferences_run_no_python_and_take_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    frame = preferences.format_preferences(empty, empty)
    assert frame.count() == 0
    plan = frame._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan


def test_pipeline_equals_its_operators_on_plain_rows(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], folder).cache())
        assert kept[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert ids[1] == {d for d in rows if scores[d] < 0.5}
    groups = exact_dedup.exact_groups(kept[1]).collect()
    assert ids[2] == {r["doc_id"] for r in groups if r["kept"]}
    groups = plain_groups(sorted((d, rows[d]) for d in ids[2]))
    assert ids[3] == {min(d for d, _ in group) for group in groups}
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert ids[4] == ids[3] - {r["doc_id"] for r in decontamination.contaminated(kept[3], benchmark).collect()}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p["doc_id"] for p in pieces} == ids[4]
    assert all(rows[d] is not None for d in ids[4])
