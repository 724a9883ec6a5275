"""Text jobs against small brute-force references."""

import math
import random
import re

import numpy as np
import pytest

from tillworks.functions import lookups, scalars
from tillworks.operators import text

# Inputs and what cleaning leaves of them, worked out by hand.
CLEANED = [
    ("See https://a.b/c?d=1 NOW!  it's   great", "see now it's great"),
    ("www.x.y", ""),
    ("http alone, httpx tail", "http alone tail"),
    ("Crème brûlée & co.", "cr me br l e co"),
    ("\tTabs\r\nand\x0blines end ", "tabs and lines end"),
    ("", ""),
    (None, ""),
    ("''quoted''  'word' word'", "''quoted'' 'word' word'"),
]


def test_clean_text(spark):
    df = spark.createDataFrame([(t,) for t, _ in CLEANED], "t string")
    assert [r[0] for r in df.select(scalars.clean_text("t")).collect()] == [want for _, want in CLEANED]


def random_reviews(n=60, seed=3):
    rng = random.Random(seed)
    words = ["good", "bad", "fine", "very", "not", "but", "kind", "of", "barely", "never", "the", "soup", "isn't", "x", "'good"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(n)]


LEXICON = {"good": 1.9, "bad": -2.5, "fine": 0.8, "kind": 2.4, "never": -0.5}


def squash(total):
    return float(np.round(total / math.sqrt(total * total + 15), 4))


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame(random_reviews(), "review_id int, review_text string")


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "token string, valence double")


def test_lexicon_sentiment(spark, reviews, lexicon):
    expected = {i: squash(sum(LEXICON.get(w, 0.0) for w in t.split(" "))) for i, t in random_reviews()}
    for check in (True, False):
        scored = text.with_sentiment(reviews.select("review_id"), text.sentiment_scores(reviews, lexicon, check_size=check))
        assert {r.review_id: r.sentiment_score for r in scored.collect()} == expected


def rules(value):
    """Straight reading of the rules, one text at a time."""
    words = [w for w in value.split(" ") if len(w) > 1]
    words = [re.sub(r"^'([a-z0-9]{2,})$|^([a-z0-9]{2,})'$", lambda m: m.group(1) or m.group(2), w) for w in words]
    turn = words.index("but") if "but" in words else None
    boost = {w: b for w, b, n in text.modifier_rows() if b}
    negations = {w for w, b, n in text.modifier_rows() if n}
    total = 0.0
    for place, w in enumerate(words):
        i = words.index(w)
        v = LEXICON.get(w, 0.0)
        if w in boost or (w == "kind" and words[i + 1 : i + 2] == ["of"]):
            v = 0.0
        elif v:
            for k, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
                if i < k or words[i - k] in LEXICON:
                    continue
                before = words[i - k]
                step = boost.get(before, 0.0) * fade
                v += -step if v < 0 else step
                if before in negations or "n't" in before:
                    v *= -0.74
        total += v * (1.0 if turn is None or place == turn else 0.5 if place < turn else 1.5)
    return squash(total)


def test_rule_sentiment(spark, reviews, lexicon):
    for check in (True, False):
        scores = text.rule_sentiment_scores(reviews, lexicon, check_size=check)
        got = {r.review_id: r.sentiment_score for r in text.with_sentiment(reviews.select("review_id"), scores).collect()}
        expected = {i: rules(t) for i, t in random_reviews()}
        assert {i: s for i, s in got.items() if abs(s - expected[i]) > 1.01e-4} == {}


def topic_frame(spark):
    rows = [(i, name, [1.0 if d == i else 0.0 for d in range(7)]) for i, name in enumerate(lookups.TOPICS)]
    return spark.createDataFrame(rows, "topic_no int, topic string, vector array<double>")


def test_topics(spark):
    rows = [
        (1, "some text", [0.9, 0.4, 0.0, 0.0, 0.0, 0.0, 0.0]),
        (2, "none above", [1.0] * 7 + []),
        (3, "", [1.0, 0, 0, 0, 0, 0, 0]),
        (4, "four above", [0.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0]),
        (5, "no direction", [0.0] * 7),
    ]
    df = spark.createDataFrame([(i, t, [float(x) for x in v]) for i, t, v in rows], "review_id int, t string, v array<float>")
    ranked = text.rank_topics(df, topic_frame(spark), "v", df.t == "", threshold=0.38)
    got = {r.review_id: [(t.topic, t.score) for t in r.topics] for r in ranked.collect()}
    assert got[1] == [("Price", 0.9138), ("Quality", 0.4061)]
    assert got[2] == got[3] == got[5] == [("Other", 0.0)]
    assert got[4] == [("Quality", 0.5), ("Delivery", 0.5), ("Packaging", 0.5)]


def test_topic_columns_and_explode(spark):
    df = spark.createDataFrame([(1, [("Price", 0.5), ("Quality", 0.4)]), (2, [("Other", 0.0)])], f"review_id int, topics {text.TOPIC_TYPE}")
    flat = df.withColumns(text.topic_columns()).collect()
    assert (flat[0].topics_text, flat[0].topic_scores_text, flat[0].topic_count) == ("Price, Quality", "0.5, 0.4", 2)
    assert (flat[1].primary_topic, flat[1].primary_topic_score) == ("Other", 0.0)
    assert text.explode_topics(df).count() == 3


def test_dominant_topic_breaks_ties_by_name(spark):
    rows = [("a", "Quality", 3), ("a", "Price", 1), ("a", "Price", 2), ("b", "Usability", 1)]
    df = spark.createDataFrame(rows, "category string, topic string, topic_review_count bigint")
    assert {r.category: r.dominant_topic for r in text.dominant_topics(df).collect()} == {"a": "Price", "b": "Usability"}


def test_encoder_runs_in_batches(spark):
    def encoder():
        return lambda texts: [[len(t), 1] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, "")], "review_id int, clean_review_text string")
    got = {r.review_id: list(r.embedding) for r in text.encode_texts(df, encoder).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_enriched_reviews_follow_the_rules(spark, lexicon):
    rows = [(1, "this is not good", [1.0, 0.0], None, "a"), (2, "good", [0.0, 1.0], None, "a")]
    df = spark.createDataFrame(rows, "review_id int, review_text string, embedding array<float>, review_date date, category string")
    topics = spark.createDataFrame([(0, "t", [1.0, 0.0])], "topic_no int, topic string, vector array<double>")
    labels = {r.review_id: r.sentiment_label for r in text.enrich_reviews(df, topics, lexicon).collect()}
    assert labels == {1: "Negative", 2: "Positive"}
    plain = {r.review_id: r.sentiment_label for r in text.enrich_reviews(df, topics, lexicon, rules=False).collect()}
    assert plain == {1: "Positive", 2: "Positive"}


def test_similarity_has_every_topic(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "review_id int, embedding array<float>")
    topics = spark.createDataFrame([(i, f"t{i}", [1.0, float(i)]) for i in range(9)], "topic_no int, topic string, vector array<double>")
    assert text.topic_similarity(df, topics).count() == 18


def test_topics_of_odd_vectors_equal_plain_cosines(spark):
    rng = np.random.default_rng(4)
    vectors = [list(map(float, rng.normal(size=3))) for _ in range(40)] + [None, [0.0, 0.0, 0.0], [1.0], [None, 1.0, 0.0], []]
    topics = [(2, "C", [0.0, 0.0, 0.0]), (0, "A", [1.0, 2.0, 0.5]), (1, "B", [1.0, 2.0, 0.5])]
    df = spark.createDataFrame(list(enumerate(vectors)), "review_id int, embedding array<double>")
    frame = spark.createDataFrame(topics, "topic_no int, topic string, vector array<double>")
    got = {r.review_id: [tuple(t) for t in r.topics] for r in text.rank_topics(df, frame, threshold=-2.0, top_n=None).collect()}
    for i, v in enumerate(vectors):
        if v is None or len(v) != 3 or None in v:
            continue
        want = []
        for _, name, t in sorted(topics):
            lengths = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in t))
            want.append((name, round(sum(a * b for a, b in zip(v, t)) / lengths, 4) if lengths else 0.0))
        assert got[i] == sorted(want, key=lambda w: -w[1]), i
    assert all(got[i] == [("Other", 0.0)] for i in (40, 42, 44))
    none = text.rank_topics(df, frame.limit(0)).select("topics").distinct().collect()
    assert [tuple(t) for t in none[0].topics] == [("Other", 0.0)] and len(none) == 1


def test_no_text_meets_an_exchange(spark, sf_dir):
    """With broadcasts off every join shuffles, and none of them carries a text."""
    from tillworks.plans import catalog_reviews

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = catalog_reviews.figured(spark, sf_dir)
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\n\(\d+\) Exchange[^\n]*\nInput[^\n]*", plan)
    assert moved and not [m for m in moved if "text#" in m.replace("has_text#", "").replace("empty_text#", "")]


def test_scorer_equals_the_join_on_odd_texts(spark, lexicon):
    texts = [None, "", "  ", "good", "but", "x y z", "good but bad", "kind of", "kind", "of kind of", "'good' 'bad", "very", "isn't good " * 300, "a" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id int, review_text string")
    for scorer in (text.sentiment_scores, text.rule_sentiment_scores):
        small, joined = ({r.review_id: r.sentiment_score for r in scorer(df, lexicon, check_size=c).collect()} for c in (True, False))
        assert small == joined and small
    assert text.small_lexicon(lexicon.limit(0)) == []
    assert text.sentiment_scores(df, lexicon.limit(0)).collect() == []


def documents_only(spark, tmp_path, texts):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    return str(tmp_path)


def test_sentiment_rules_score_every_word_of_the_texts(spark, tmp_path):
    from tillworks.plans import catalog_reviews

    # no word is one of the literal lexicon; lengths 5, 9 and 8 give -1.8, 1.8 and 0.9
    texts = ["abcde", "abcdefghi", "en abcdefgh", "that abcde abcde", None, "of"]
    folder = documents_only(spark, tmp_path, texts)
    scores = {r.review_id: r.sentiment_score for r in catalog_reviews.sentiment_rules(spark, folder).collect()}
    # "that" has four letters: 1.8, and uses after it weigh one and a half
    assert scores == {0: squash(-1.8), 1: squash(1.8), 2: squash(0.9 * lookups.NEGATION_FACTOR), 3: squash(1.8 - 1.5 * 1.8 * 2)}


def test_recommendations_hear_every_word_of_the_texts(spark, sf_dir, tmp_path):
    import os

    from pyspark.sql import functions as F

    from tillworks.plans import catalog_reviews

    for name in os.listdir(sf_dir):
        if name != "documents.parquet":
            os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    heads = catalog_reviews.review_heads(spark, sf_dir).select("review_id", "category")
    sad = sorted(r.category for r in heads.select("category").distinct().collect())[:1]
    # "abcde" counts -1.8, "abcdefghi" 1.8; neither is in the fixed lexicon, so all were neutral before
    text_of = F.when(F.col("category").isin(sad), "abcde").otherwise("abcdefghi")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").drop("text").join(heads.select(F.col("review_id").alias("doc_id"), text_of.alias("text")), "doc_id")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalog_reviews.report_recommendations(spark, str(tmp_path)).collect()
    keys = {k.lower() for k in sad}
    assert {r.category in keys for r in rows} == {True, False}
    assert all(("unhappy" in r.issue) == (r.category in keys) for r in rows)


def test_a_large_lexicon_is_asked_for_the_words_of_chunks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    words = ["ab", "abc", "that", "de", "en", "kind", "of", "'quoted'", "isn't", "x", "good", "bad", "dull", "http://ab.c", "ÄÖ"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "en", "dull", "dull en", "dull bad"]
    reviews = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "review_id long, review_text string").repartition(3)
    # "good" is listed twice, "dull" has no valence, "de" is a modifier with a valence of its own
    known = [("ab", 1.9), ("abc", -2.3), ("good", 1.8), ("good", 0.9), ("bad", -1.8), ("de", 0.9), ("kind", 0.9), ("quoted", -0.9), ("dull", None), ("that", 1.8), (None, 1.0)]
    lexicon = spark.createDataFrame(known, "token string, valence double")
    mods, how = [("de", 0.293, False), ("of", 0.293, False), ("en", 0.0, True)], ("that", "review_id", "review_text")
    joined = sorted(text._scores_by_join(reviews, lexicon, mods, *how).collect())
    monkeypatch.setattr(text, "CHUNK_BYTES", 500)
    scores = text.rule_sentiment_scores(reviews, lexicon, mods, "that", check_size=False)
    assert sorted(scores.collect()) == joined and len(joined) > 250 and any(r.sentiment_score is None for r in joined)
    # before, every word of every text passed through two exchanges with its neighbours
    assert "Generate" not in scores._jdf.queryExecution().optimizedPlan().toString()
    # texts that share an id, a null one too, are one text
    again = reviews.union(reviews.where("review_id % 3 = 0")).union(reviews.where("review_id < 9").selectExpr("NULL", "review_text"))
    both = [sorted(s.collect(), key=str) for s in (text._scores_by_join(again, lexicon, mods, *how), text.rule_sentiment_scores(again, lexicon, mods, "that", check_size=False))]
    assert both[0] == both[1] and both[0] != joined


def test_figures_by_a_large_lexicon_move_no_row_per_word(spark):
    reviews = spark.createDataFrame([(1, "en abcdefgh", 1), (2, "abcde", 1)], "review_id long, review_text string, n int")
    lexicon = spark.createDataFrame([("abcdefgh", 0.9), ("abcde", -1.8)], "token string, valence double")
    figures = text.text_figures(reviews, lexicon, modifiers=[("en", 0.0, True)], contrast="that", check_size=False)
    assert {r.review_id: r.sentiment_score for r in figures.collect()} == {1: squash(0.9 * lookups.NEGATION_FACTOR), 2: squash(-1.8)}
    # what report_recommendations reads; before, words were exploded for a join
    assert "Generate" not in figures._jdf.queryExecution().optimizedPlan().toString()
