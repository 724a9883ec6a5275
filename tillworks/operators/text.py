"""Review text: sentiment from a lexicon, topics from vectors.

Texts are processed whole. A lexicon within a checked bound travels to the tasks and is looked
up there, in one pass over the words of an Arrow batch; a larger one is asked for the distinct words of
chunks of texts (rules), or meets counted words in a join. Topics compare vectors inside the row, without any shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.functions import lookups
from tillworks.functions.scalars import (
    NOT_WORD,
    as_column,
    category_key,
    clean_text,
    half_even,
    month_start,
    sentiment_label,
    tokens_of,
    without_urls,
)
from tillworks.session import staged

# Tasks get this module's functions with the task; executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOPIC_TYPE = "array<struct<topic:string,score:double>>"


# --- sentiment ------------------------------------------------------------


def compound(total: Column | str) -> Column:
    """Squash a valence sum into [-1, 1]; null stays null."""
    s = as_column(total).cast("double")
    squashed = s / F.sqrt(s * s + F.lit(float(lookups.NORMALISER)))
    return F.when(s.isNotNull(), half_even(F.greatest(F.least(squashed, F.lit(1.0)), F.lit(-1.0)), 4))


def exploded_words(texts: DataFrame, text_col: str) -> DataFrame:
    """One row per word of the cleaned text.

    The text is cut at the same places where cleaning would leave a space, which
    spares one pass over it.
    """
    kept = [c for c in texts.columns if c != text_col]
    plain = texts.select(*kept, without_urls(text_col).alias("_plain"))
    return plain.select(*kept, F.explode(F.split("_plain", NOT_WORD)).alias("token")).filter(
        F.col("token") != ""
    )


# A lexicon travels to the tasks when a count shows it to be within both bounds.
LEXICON_ROWS, LEXICON_BYTES = 100_000, 8 << 20
# Points are added up as whole numbers, so sums do not depend on the order of words.
PLAIN_SCALE, RULE_SCALE = 10**6, 10**10


def small_lexicon(lexicon: DataFrame) -> list[tuple[str, float]] | None:
    """The words with their valence, or None where they are too many to travel. The count stops at the bound."""
    known = lexicon.select("token", F.col("valence").cast("double").alias("valence")).where("token IS NOT NULL AND valence IS NOT NULL")
    size = known.limit(LEXICON_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("token") + 8), F.lit(0)).alias("bytes")).first()
    if size["n"] > LEXICON_ROWS or size["bytes"] > LEXICON_BYTES:
        return None
    return [(r["token"], r["valence"]) for r in known.collect()]


def coded_words(clean: pa.Array, rules: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every word of cleaned texts, and the words the codes stand for; with ``rules`` those of ``rule_tokens``."""
    lists = pc.split_pattern(clean.cast(pa.string()), " ")
    coded = lists.flatten().dictionary_encode()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    rows, codes, words = np.repeat(np.arange(len(clean)), sizes), np.asarray(coded.indices), coded.dictionary
    if rules:  # one outer apostrophe is removed, single characters are not words
        long = np.asarray(pc.greater(pc.utf8_length(words), 1).to_numpy(zero_copy_only=False), bool)
        words = pc.replace_substring_regex(words, "^'([a-z0-9]{2,})$|^([a-z0-9]{2,})'$", "\\1\\2")
        rows, codes = rows[long[codes]], codes[long[codes]]
    return rows, codes, words


class Scorer:
    """Sums of points of cleaned texts, a batch at a time.

    Each distinct word of a batch is looked up once; words and their neighbours are then
    numbers in one array. With ``rules`` a word counts as ``rule_sentiment_scores`` says.
    ``known`` are all words that have a valence, where ``lexicon`` holds only some of them.
    """

    def __init__(self, lexicon: list[tuple[str, float]], rules: bool, modifiers: list[tuple[str, float, bool]], contrast: str, known: set[str] | None = None):
        self.words, self.valence, self.rules, self.contrast = [w for w, _ in lexicon], np.array([v for _, v in lexicon], float), rules, contrast
        known = set(self.words) if known is None else known
        active = [m for m in modifiers if m[0] not in known]  # a modifier with a valence is an ordinary word
        self.modifiers = [w for w, _, _ in active]
        self.boost = np.array([b for _, b, _ in active] + [0.0])
        self.negates = np.array([n for _, _, n in active] + [False])
        silent = {w for w, b, _ in modifiers if b}
        self.silent = np.array([w in silent for w in self.words], bool)

    def totals(self, clean: pa.Array) -> pa.Array:
        """The sum of each text, null where no word has a valence."""
        sums, found, scale = self.sums(clean)
        return pa.array(sums / scale, mask=~found)

    def sums(self, clean: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        """The sum of each text as a whole number, whether it has a word with a valence, and the scale of the sums."""
        rows, codes, words = coded_words(clean, self.rules)
        scale = RULE_SCALE * 10 if self.rules else PLAIN_SCALE
        place = np.asarray(pc.fill_null(pc.index_in(words, value_set=pa.array(self.words, pa.string())), -1))
        at = np.flatnonzero(place[codes] >= 0) if len(codes) else np.empty(0, np.int64)
        sums, found = np.zeros(len(clean), np.int64), np.zeros(len(clean), bool)
        if not len(at):
            return sums, found, scale
        hits, row = place[codes[at]], rows[at]
        if self.rules:
            points, row = self._ruled(words, codes, rows, at, hits)
        else:
            points = np.rint(self.valence[hits] * PLAIN_SCALE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        sums[row[first]] = np.add.reduceat(points, first)
        found[row] = True
        return sums, found, scale

    def _ruled(self, words: pa.Array, codes: np.ndarray, rows: np.ndarray, at: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points of each text's distinct words, ordered by text, and the texts."""

        def each(flags: pa.Array) -> np.ndarray:
            return np.asarray(pc.fill_null(flags, False).to_numpy(zero_copy_only=False), bool)

        begins = np.searchsorted(rows, rows[at])
        # Uses before the first contrast word weigh half, uses after it one and a half.
        turns = np.flatnonzero(each(pc.equal(words, self.contrast))[codes])
        turns = turns[np.concatenate(([True], rows[turns][1:] != rows[turns][:-1]))] if len(turns) else turns
        turn = np.full(rows[-1] + 1, -1)
        turn[rows[turns]] = turns
        turn = turn[rows[at]]
        weight = np.where((turn < 0) | (at == turn), 10, np.where(at < turn, 5, 15))
        key, first, back = np.unique(rows[at] * len(self.words) + hits, return_index=True, return_inverse=True)
        weights = np.bincount(back, weights=weight).astype(np.int64)
        use, begin, word = at[first], begins[first], hits[first]
        modifier = np.asarray(pc.fill_null(pc.index_in(words, value_set=pa.array(self.modifiers, pa.string())), -1))
        negated_by = self.negates[modifier] | each(pc.match_substring(words, "n't"))
        value = self.valence[word].copy()
        for k, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
            there = use - k >= begin
            before = codes[np.maximum(use - k, 0)]
            step = np.where(there, self.boost[modifier[before]], 0.0) * fade
            value += np.where(value < 0, -step, step)
            value = np.where(there & negated_by[before], value * lookups.NEGATION_FACTOR, value)
        after = np.minimum(use + 1, len(codes) - 1)
        of = each(pc.equal(words, "of"))[codes[after]] & (use + 1 < len(codes)) & (rows[after] == rows[use])
        kind = each(pc.equal(words, "kind"))[codes[use]]
        value = np.where(self.silent[word] | (kind & of), 0.0, value)
        return np.rint(value * RULE_SCALE).astype(np.int64) * weights, rows[use]


def scored_in_row(clean: Column | str, lexicon: list[tuple[str, float]], rules: bool, modifiers: list[tuple[str, float, bool]] | None = None, contrast: str = "but") -> Column:
    """Sentiment of a cleaned text by a lexicon that travels with the task; null without a known word."""
    scorer = Scorer(lexicon, rules, modifiers if modifiers is not None else modifier_rows(), contrast)

    @F.arrow_udf("double")
    def totals(texts: pa.Array) -> pa.Array:
        return scorer.totals(texts)

    return compound(totals(as_column(clean)))


def _scores_in_row(reviews: DataFrame, id_col: str, text_col: str, *how) -> DataFrame:
    scores = reviews.select(id_col, scored_in_row(clean_text(text_col), *how).alias("sentiment_score"))
    return scores.where("sentiment_score IS NOT NULL")


def sentiment_scores(
    reviews: DataFrame,
    lexicon: DataFrame,
    id_col: str = "review_id",
    text_col: str = "review_text",
    check_size: bool = True,
) -> DataFrame:
    """(id, sentiment_score) of every review that has a word in the lexicon, whose words are distinct.

    A lexicon proven small is looked up where a text was read. For a larger one (or with
    ``check_size=False`` for one known to be large) words are first counted per
    review, so that a word used in every text arrives once per review, and the
    counts are joined by word; AQE splits a skewed word.
    """
    small = small_lexicon(lexicon) if check_size else None
    if small is not None:
        return _scores_in_row(reviews, id_col, text_col, small, False)
    words = exploded_words(reviews.select(id_col, text_col), text_col).groupBy(id_col, "token").agg(F.count("*").alias("n"))
    points = F.col("n") * F.col("valence").cast("decimal(12,6)")
    return (
        words.join(lexicon.select("token", "valence"), "token")
        .groupBy(id_col)
        .agg(F.sum(points).alias("total"))
        .select(id_col, compound("total").alias("sentiment_score"))
    )


def with_sentiment(
    reviews: DataFrame, scores: DataFrame, id_col: str = "review_id"
) -> DataFrame:
    """Attach score and label; a review without a scored word gets 0.0."""
    score = F.coalesce("sentiment_score", F.lit(0.0))
    return (
        reviews.join(scores, id_col, "left")
        .withColumn("sentiment_score", score)
        .withColumn("sentiment_label", sentiment_label("sentiment_score"))
    )


# --- topics ---------------------------------------------------------------


# Topics travel to the tasks as numbers: a handful of vectors, checked against this many.
MOST_TOPICS = 10_000


def topic_table(topics: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and unit vectors of the topics in topic order; a topic of length 0 stays 0."""
    rows = topics.select("topic_no", "topic", F.col("vector").cast("array<double>").alias("vector")).limit(MOST_TOPICS + 1).collect()
    if len(rows) > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics")
    rows.sort(key=lambda r: (r["topic_no"], r["topic"]))
    if not rows:
        return [], np.zeros((0, 0))
    vectors = np.array([r["vector"] for r in rows], float)
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return [r["topic"] for r in rows], np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def cosines(embedding: pa.Array, units: np.ndarray) -> pa.Array:
    """Similarity of each vector of a batch with every topic, in one product; null for a null or unfit vector, 0 for a vector of length 0."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(embedding), -1))
    flat = embedding.flatten()
    values = np.asarray(pc.fill_null(flat, float("nan")), float)
    fits = sizes == units.shape[1]
    matrix = values[np.repeat(fits, np.maximum(sizes, 0))].reshape(-1, units.shape[1]) if units.shape[1] else np.zeros((int(fits.sum()), 0))
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    dots = np.divide(matrix @ units.T, lengths, out=np.zeros((len(matrix), len(units))), where=lengths > 0)
    width = np.where(fits, len(units), 0)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(width))), pa.int32()), pa.array(dots.ravel()))
    return pc.if_else(pa.array(fits), lists, pa.scalar(None, lists.type))


def rank_topics(
    reviews: DataFrame,
    topics: DataFrame,
    vector: str = "embedding",
    is_empty: Column | None = None,
    threshold: float = 0.35,
    top_n: int | None = 3,
) -> DataFrame:
    """Add ``topics``: the ``top_n`` (None: all) whose cosine similarity reaches the threshold.

    The topics are a handful of rows: their unit vectors travel with the task, a batch of
    reviews is compared in one matrix product, and every review sorts and cuts inside its own
    row. Equal scores keep topic order. No topic, an empty text or a vector of another
    length gives [("Other", 0.0)].
    """
    names, units = topic_table(topics)

    @F.arrow_udf("array<double>")
    def similarities(embedding: pa.Array) -> pa.Array:
        return cosines(embedding, units)

    # The places and names are literals of the plan; only scores come from the product.
    places = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("topic")) for i, name in enumerate(names)])
    if not names:
        places = F.array().cast("array<struct<place:int,topic:string>>")

    def scored(t: Column, similarity: Column) -> Column:
        score = F.round(similarity, 4)
        return F.struct((-score).alias("order"), t["place"].alias("place"), t["topic"].alias("topic"), score.alias("score"))

    rows = reviews.withColumn("_scores", similarities(vector))
    passing = F.filter(F.zip_with(places, "_scores", scored), lambda s: s["score"] >= threshold)
    ranked = F.sort_array(passing)
    best = F.transform(
        ranked if top_n is None else F.slice(ranked, 1, top_n),
        lambda s: F.struct(s["topic"].alias("topic"), s["score"].alias("score")),
    ).cast(TOPIC_TYPE)
    other = F.array(
        F.struct(F.lit(lookups.NO_TOPIC).alias("topic"), F.lit(0.0).alias("score"))
    ).cast(TOPIC_TYPE)
    rows = rows.withColumn("topics", best)
    nothing = F.col("topics").isNull() | (F.size("topics") < 1)
    if is_empty is not None:
        nothing = nothing | is_empty
    return rows.withColumn("topics", F.when(nothing, other).otherwise(F.col("topics"))).drop("_scores")


def text_figures(
    texts: DataFrame, lexicon: DataFrame, id_col: str = "review_id", text_col: str = "review_text",
    rules: bool = True, modifiers: list[tuple[str, float, bool]] | None = None, contrast: str = "but", check_size: bool = True,
) -> DataFrame:
    """What the marts need of each text, without the text: ``has_text, empty_text, sentiment_score, sentiment_label``.

    With a lexicon proven small this is a projection of the scan, so no text meets an exchange.
    """
    about = texts.select(
        id_col, F.col(text_col).isNotNull().alias("has_text"), clean_text(text_col).alias("_clean")
    ).withColumn("empty_text", F.col("_clean") == "")
    small = small_lexicon(lexicon) if check_size else None
    if small is not None:
        score = F.coalesce(scored_in_row("_clean", small, rules, modifiers, contrast), F.lit(0.0))
        scored = about.withColumn("sentiment_score", score).withColumn("sentiment_label", sentiment_label("sentiment_score"))
        return scored.drop("_clean")
    if rules:
        scores = rule_sentiment_scores(texts, lexicon, modifiers, contrast, id_col, text_col, check_size=False)
    else:
        scores = sentiment_scores(texts, lexicon, id_col, text_col, check_size=False)
    return with_sentiment(about.drop("_clean"), scores, id_col)


def enriched_figures(reviews: DataFrame, vectors: DataFrame, figures: DataFrame, topics: DataFrame, vector_key: str, threshold: float = 0.35, top_n: int | None = 3) -> DataFrame:
    """Reviews with topics and sentiment but no text: rows of ids, dates, scores, a vector and the figures of the text.

    ``reviews`` has no text column; it meets ``vectors`` by ``vector_key`` and ``figures`` by review_id.
    The text is for the caller to join back, by review_id, where it is to be shown.
    """
    narrow = reviews.withColumns({"review_month": month_start("review_date"), "category": category_key("category")})
    rows = narrow.join(figures, "review_id").join(vectors, vector_key)
    ranked = rank_topics(rows, topics, "embedding", F.col("empty_text"), threshold, top_n)
    return ranked.withColumns(topic_columns()).drop("embedding", "empty_text")


def topic_similarity(reviews: DataFrame, topics: DataFrame, vector: str = "embedding") -> DataFrame:
    """Every review x topic pair with its similarity (as many per review as there are topics)."""
    ranked = rank_topics(reviews, topics, vector, threshold=-2.0, top_n=None)
    return ranked.select("review_id", F.explode("topics").alias("pair")).select(
        "review_id", "pair.topic", F.col("pair.score").alias("similarity")
    )


def topic_columns(topics: Column | str = "topics") -> dict[str, Column]:
    """Names, scores and first entry of a topic list, as flat columns."""
    t = as_column(topics)
    names = F.transform(t, lambda x: x["topic"])
    scores = F.transform(t, lambda x: x["score"].cast("string"))
    return {
        "primary_topic": t[0]["topic"],
        "primary_topic_score": t[0]["score"],
        "topics_text": F.array_join(names, ", "),
        "topic_scores_text": F.array_join(scores, ", "),
        "topic_count": F.size(t),
    }


def with_topics(
    reviews: DataFrame, topics: DataFrame, threshold: float = 0.35, top_n: int = 3
) -> DataFrame:
    """Clean text, month, standard category and topics of every review."""
    cleaned = reviews.withColumns(
        {
            "clean_review_text": clean_text("review_text"),
            "has_text": F.col("review_text").isNotNull(),
            "review_month": month_start("review_date"),
            "category": category_key("category"),
        }
    )
    ranked = rank_topics(
        cleaned, topics, "embedding", F.col("clean_review_text") == "", threshold, top_n
    )
    return ranked.withColumns(topic_columns()).drop("embedding")


def enrich_reviews(
    reviews: DataFrame,
    topics: DataFrame,
    lexicon: DataFrame,
    threshold: float = 0.35,
    top_n: int = 3,
    check_size: bool = True,
    rules: bool = True,
    modifiers: list[tuple[str, float, bool]] | None = None,
    contrast: str = "but",
) -> DataFrame:
    """Reviews with topics and sentiment, scored by the rules or, without, by the plain sum of valences.

    With a lexicon proven small both are settled inside the row. With a larger one topics
    are settled before the join with the scores, so a mart that needs only month,
    category and counts never shuffles a text.
    """
    topical = with_topics(reviews, topics, threshold, top_n)
    small = small_lexicon(lexicon) if check_size else None
    if small is not None:
        score = F.coalesce(scored_in_row("clean_review_text", small, rules, modifiers, contrast), F.lit(0.0))
        return topical.withColumn("sentiment_score", score).withColumn("sentiment_label", sentiment_label("sentiment_score"))
    if rules:
        scores = rule_sentiment_scores(reviews, lexicon, modifiers, contrast, check_size=False)
    else:
        scores = sentiment_scores(reviews, lexicon, check_size=False)
    return with_sentiment(topical, scores)


def explode_topics(enriched: DataFrame) -> DataFrame:
    """One row per review and topic, all review columns kept."""
    return (
        enriched.withColumn("entry", F.explode("topics"))
        .withColumns({"topic": F.col("entry.topic"), "topic_similarity_score": F.col("entry.score")})
        .drop("entry", "topics")
    )


def encode_texts(
    reviews: DataFrame,
    encoder: Callable[[], Callable[[list[str]], list]],
    text_col: str = "clean_review_text",
) -> DataFrame:
    """Vectors from a user-supplied encoder, batch by batch on the executors.

    ``encoder()`` runs once per task and returns a function from a list of texts
    to a list of vectors.
    """
    vector = T.StructField("embedding", T.ArrayType(T.FloatType()))
    schema = T.StructType([*reviews.schema.fields, vector])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = encoder()
        for batch in batches:
            yield batch.assign(embedding=[list(map(float, v)) for v in embed(batch[text_col].tolist())])

    return reviews.mapInPandas(encode, schema)


# --- rule-based sentiment -------------------------------------------------


def modifier_rows() -> list[tuple[str, float, bool]]:
    """(word, boost, negates) of every single-word modifier."""
    rows = [(w, lookups.BOOST, False) for w in lookups.BOOSTERS]
    rows += [(w, lookups.DAMPEN, False) for w in lookups.DAMPENERS if " " not in w]
    return rows + [(w, 0.0, True) for w in lookups.NEGATIONS]


def rule_tokens(clean: Column | str) -> Column:
    """Words of two or more characters, one outer apostrophe removed."""
    longer = F.filter(tokens_of(clean), lambda w: F.length(w) > 1)
    return F.transform(
        longer, lambda w: F.regexp_replace(w, r"^'([a-z0-9]{2,})$|^([a-z0-9]{2,})'$", "$1$2")
    )


def rule_sentiment_scores(
    reviews: DataFrame,
    lexicon: DataFrame,
    modifiers: list[tuple[str, float, bool]] | None = None,
    contrast: str = "but",
    id_col: str = "review_id",
    text_col: str = "review_text",
    check_size: bool = True,
) -> DataFrame:
    """Lexicon sentiment with boosters, dampeners, negations and contrast.

    A word's valence is read in the context of its first use in the text and
    counts once per use. Up to three words before it can boost, dampen or negate
    it, unless they carry a valence themselves. Uses before the first contrast
    word weigh half, uses after it one and a half.

    A lexicon proven small is looked up where a text was read. For a larger one texts are
    gathered in chunks, which ask for the valences of their distinct words. Texts that
    share an id are one text with several beginnings; their words meet the lexicon in a join.
    """
    small = small_lexicon(lexicon) if check_size else None
    if small is not None:
        return _scores_in_row(reviews, id_col, text_col, small, True, modifiers, contrast)
    texts = reviews.select(id_col, text_col)
    several = staged(texts.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(id_col).alias("_id")), "repeated-ids")
    if several.isEmpty():
        return _scores_of_chunks(texts, lexicon, modifiers, contrast, id_col, text_col)
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    single = _scores_of_chunks(texts.join(several, same, "left_anti"), lexicon, modifiers, contrast, id_col, text_col)
    return single.unionByName(_scores_by_join(texts.join(several, same, "left_semi"), lexicon, modifiers, contrast, id_col, text_col))


# Bytes of cleaned text that ask for their distinct words together, and that one step scores; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20


def _asking(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows ``chunk, token, texts``: the distinct words of every chunk, and one row with its packed texts."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        _, codes, words = coded_words(table.column(1).combine_chunks(), True)
        tokens = pc.unique(words.take(pa.array(np.unique(codes)))) if len(codes) else pa.array([], pa.string())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        packed = pa.array([None] * len(tokens) + [sink.getvalue().to_pybytes()], pa.binary())
        tokens = pa.concat_arrays([tokens.cast(pa.string()), pa.nulls(1, pa.string())])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), number)), tokens, packed], ["chunk", "token", "texts"])

    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit - size, "right")))
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1] - base)
            at = stop
            if size >= limit or at < batch.num_rows:
                yield rows()
                held, size, number = [], 0, number + 1
    if held:
        yield rows()


def _scored(texts: pa.Table, replies: pa.Table, modifiers: list[tuple[str, float, bool]], contrast: str) -> pa.Table:
    """Id and sum of the texts of a chunk with a word that has a valence; null where all valences are."""
    found = pa.ipc.open_stream(texts.column("texts")[0].as_py()).read_all().combine_chunks()
    ids, clean = found.column(0).combine_chunks(), found.column(1).combine_chunks()
    tokens, valences = replies.column("token").to_pylist(), replies.column("valence").to_pylist()
    # a word that the lexicon holds several times counts several times
    layers, times = [], {}
    for token, valence in zip(tokens, valences):
        times[token] = times.get(token, -1) + 1
        if times[token] == len(layers):
            layers.append([])
        layers[times[token]].append((token, valence))
    silent = {w for w, boost, _ in modifiers if boost}
    sums, counted, hit, scale = np.zeros(len(clean), np.int64), np.zeros(len(clean), bool), np.zeros(len(clean), bool), RULE_SCALE * 10
    for layer in layers:
        valued = [(w, v) for w, v in layer if v is not None or w in silent]
        more, some, scale = Scorer([(w, v or 0.0) for w, v in valued], True, modifiers, contrast, set(times)).sums(clean)
        sums, counted = sums + more, counted | some
        if len(valued) < len(layer):
            hit |= Scorer([(w, 0.0) for w, _ in layer], True, modifiers, contrast, set(times)).sums(clean)[1]
    hit |= counted
    totals = pa.array(sums / scale, mask=~counted)
    return pa.Table.from_arrays([ids.filter(pa.array(hit)), totals.filter(pa.array(hit))], ["id", "total"])


def _scores_of_chunks(texts: DataFrame, lexicon: DataFrame, modifiers: list[tuple[str, float, bool]] | None, contrast: str, id_col: str, text_col: str) -> DataFrame:
    """Scores of texts with an id of their own; what moves is each chunk's distinct words, and its texts once, packed."""
    listed = modifiers if modifiers is not None else modifier_rows()
    cleaned = texts.select(id_col, clean_text(text_col).alias("_clean"))
    asking = cleaned.mapInArrow(partial(_asking, limit=CHUNK_BYTES), "chunk long, token string, texts binary")
    asking = staged(asking, "asking-chunks")
    replies = asking.where("token IS NOT NULL").select(F.col("chunk").alias("of"), "token").join(lexicon.select("token", F.col("valence").cast("double").alias("valence")), "token")
    whole = asking.where("texts IS NOT NULL").select("chunk", "texts")

    def score(chunk: pa.Table, found: pa.Table) -> pa.Table:
        return _scored(chunk, found, listed, contrast)

    kind = T.StructType([T.StructField("id", texts.schema[id_col].dataType), T.StructField("total", T.DoubleType())])
    totals = whole.groupBy("chunk").cogroup(replies.groupBy("of")).applyInArrow(score, kind)
    return totals.select(F.col("id").alias(id_col), compound("total").alias("sentiment_score"))


def _scores_by_join(
    reviews: DataFrame, lexicon: DataFrame, modifiers: list[tuple[str, float, bool]] | None, contrast: str, id_col: str, text_col: str
) -> DataFrame:
    """Scores where the texts of one id count as one: each word with its neighbours meets the lexicon."""
    spark = reviews.sparkSession
    listed = spark.createDataFrame(
        modifiers if modifiers is not None else modifier_rows(),
        "word string, boost double, negates boolean",
    )
    # A modifier that has a valence is an ordinary word; the list is a literal.
    active = listed.join(lexicon, F.col("word") == F.col("token"), "left_anti")

    cleaned = reviews.select(id_col, clean_text(text_col).alias("_clean"))
    words = cleaned.select(id_col, rule_tokens("_clean").alias("words"))
    at = F.array_position("words", F.lit(contrast)) - 1
    uses = words.withColumn("turn", F.when(at >= 0, at)).select(
        id_col,
        "turn",
        F.posexplode(
            F.transform(
                "words",
                lambda w, i: F.struct(
                    w.alias("token"),
                    *[
                        F.when(i >= k, F.get("words", i - k)).alias(f"before{k}")
                        for k in (1, 2, 3)
                    ],
                    F.get("words", i + 1).alias("after1"),
                ),
            )
        ).alias("pos", "use"),
    )
    weight = (
        F.when(F.col("turn").isNull() | (F.col("pos") == F.col("turn")), 1.0)
        .when(F.col("pos") < F.col("turn"), 0.5)
        .otherwise(1.5)
        .cast("decimal(3,1)")
    )
    per_word = uses.groupBy(id_col, F.col("use.token").alias("token")).agg(
        F.sum(weight).alias("weight"),
        F.min(F.struct("pos", "use")).alias("first"),
    )
    hits = per_word.join(lexicon.select("token", "valence"), "token").select(
        id_col,
        "token",
        "weight",
        "valence",
        "first.use.before1",
        "first.use.before2",
        "first.use.before3",
        "first.use.after1",
    )
    for k in (1, 2, 3):
        near = active.select(
            F.col("word").alias(f"before{k}"),
            F.col("boost").alias(f"boost{k}"),
            F.col("negates").alias(f"negates{k}"),
        )
        # The modifier list is a literal of a few hundred words.
        hits = hits.join(F.broadcast(near), f"before{k}", "left")

    value = F.col("valence").cast("double")
    for k, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
        step = F.coalesce(F.col(f"boost{k}"), F.lit(0.0)) * fade
        value = value + F.when(value < 0, -step).otherwise(step)
        negated = F.coalesce(F.col(f"negates{k}"), F.lit(False)) | F.coalesce(
            F.contains(F.col(f"before{k}"), F.lit("n't")), F.lit(False)
        )
        value = F.when(negated, value * lookups.NEGATION_FACTOR).otherwise(value)

    boosting = [w for w, boost, _ in (modifiers or modifier_rows()) if boost]
    silent = F.col("token").isin(boosting) | (
        (F.col("token") == "kind") & F.coalesce(F.col("after1") == "of", F.lit(False))
    )
    points = F.when(silent, 0.0).otherwise(value).cast("decimal(20,10)") * F.col("weight")
    return (
        hits.groupBy(id_col)
        .agg(F.sum(points).alias("total"))
        .select(id_col, compound("total").alias("sentiment_score"))
    )


# --- one topic per group --------------------------------------------------


def dominant_topics(topic_months: DataFrame, key: str = "category") -> DataFrame:
    """The topic with most reviews per key; the topic name settles ties."""
    totals = topic_months.groupBy(key, "topic").agg(F.sum("topic_review_count").alias("n"))
    first = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col("topic").asc())
    return (
        totals.withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .select(key, F.col("topic").alias("dominant_topic"))
    )
