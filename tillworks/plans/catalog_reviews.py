"""Registered queries: ratings, review texts, segments, report and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.functions import lookups
from tillworks.functions.scalars import category_key, clean_text, half_even
from tillworks.operators import cleaning, forecast, marts, partials, ratings, reviews, segments, text
from tillworks.plans import dashboards as dash
from tillworks.plans import report
from tillworks.plans.oracle_views import VIEWS, buckets, growth, mean, pct, pearson, trend, values
from tillworks.plans.registry import query
from tillworks.plans.rollup import sales_for
from tillworks.session import stored_mart
from tillworks.sources.star_views import (
    RULE_CONTRAST,
    RULE_MODIFIERS,
    TEST_TOPIC_THRESHOLD,
    lexicon,
    read_docs,
    review_docs,
    review_events,
    review_heads,
    sales_lines,
    text_words,
    topic_vectors,
    vectors,
)

# The given tables' own category words, shaped like the fixed lists in lookups.
TAXONOMY_CATEGORY = "ECONOMY"
TAXONOMY_TYPES = ("small ring", "red widget", "blue widget", "large gear", "green bolt", "small widget", "red gear")
CATEGORY_MAP = {
    "ECONOMY": "Value", "PROMO": "Value", "SMALL": "Compact", "MEDIUM": "Eggs, Meat & Fish", "Brand#1": "House", "Brand#2": "House",
}
REPORT_YEAR = 1998
REVIEW_PERIOD = {"year": 1998, "months": [1, 2, 3, 6], "categories": ["economy", "promo", "small", "large"]}
REVIEW_WHERE = "year({m}) = 1998 AND month({m}) IN (1, 2, 3, 6) AND category IN ('economy', 'promo', 'small', 'large')"


# --- frames ---------------------------------------------------------------


def figured(spark: SparkSession, d: str, threshold: float = TEST_TOPIC_THRESHOLD, words: DataFrame | None = None) -> DataFrame:
    """Written reviews with topics and rule sentiment; with the fixed words no text passes through a join."""
    known = lexicon(spark) if words is None else words
    figures = text.text_figures(read_docs(spark, d), known, modifiers=RULE_MODIFIERS, contrast=RULE_CONTRAST)
    return text.enriched_figures(review_heads(spark, d), vectors(spark, d), figures, topic_vectors(spark, d), "vec_id", threshold)


def build_scored_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Enriched reviews without their texts: what the marts need."""
    return figured(spark, d).select(
        "review_id", "review_date", "review_month", "review_score", "category", "has_text",
        "sentiment_score", "sentiment_label", "topics", "topic_count", "primary_topic", "primary_topic_score", "topics_text", "topic_scores_text",
    )


def build_review_months(spark: SparkSession, d: str) -> DataFrame:
    return reviews.category_month_mart(scored_reviews(spark, d))


def build_topic_months(spark: SparkSession, d: str) -> DataFrame:
    return reviews.topic_month_mart(text.explode_topics(scored_reviews(spark, d)))


def combined_with(spark: SparkSession, d: str, months_of_reviews: DataFrame) -> DataFrame:
    months = marts.category_months(sales_lines(spark, d, "category", "order_date", "sales"))
    sales = reviews.sales_by_month_and_key(months)
    return reviews.with_review_impact(reviews.combine_sales_and_reviews(sales, months_of_reviews))


def build_combined(spark: SparkSession, d: str) -> DataFrame:
    return combined_with(spark, d, review_months(spark, d))


def build_whole_combined(spark: SparkSession, d: str) -> DataFrame:
    """The same with a valence for every word of the texts."""
    return combined_with(spark, d, reviews.category_month_mart(figured(spark, d, words=whole_lexicon(spark, d))))


def build_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_mart(combined(spark, d))


def build_whole_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_mart(stored_mart(spark, "whole_combined", d, build_whole_combined))


# The tables dashboards and reports read: written once per session and folder.
def whole_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return stored_mart(spark, "text_words", d, text_words)


def scored_reviews(spark: SparkSession, d: str) -> DataFrame:
    return stored_mart(spark, "scored_reviews", d, build_scored_reviews)


def review_months(spark: SparkSession, d: str) -> DataFrame:
    return stored_mart(spark, "review_months", d, build_review_months)


def topic_months(spark: SparkSession, d: str) -> DataFrame:
    return stored_mart(spark, "topic_months", d, build_topic_months)


def combined(spark: SparkSession, d: str) -> DataFrame:
    return stored_mart(spark, "combined", d, build_combined)


def segment_rows(spark: SparkSession, d: str) -> DataFrame:
    return stored_mart(spark, "segments", d, build_segments)


def whole_segment_rows(spark: SparkSession, d: str) -> DataFrame:
    return stored_mart(spark, "whole_segments", d, build_whole_segments)


def summary_of_both(spark: SparkSession, d: str) -> DataFrame:
    return marts.sales_review_summary(
        sales_lines(spark, d, "category", "sales", "order_id"), review_events(spark, d)
    )


def plain_sales_forecast(spark: SparkSession, d: str) -> DataFrame:
    monthly = forecast.monthly_sales(sales_for(spark, d, "category", "order_date", "sales"), "category")
    ahead = forecast.same_month_last_year(monthly, "total_sales")
    return ahead.select("category", category_key("category").alias("category_key"), "sales_month", F.col("total_sales").alias("sales"))


def plain_transaction_forecast(spark: SparkSession, d: str) -> DataFrame:
    monthly = partials.monthly_orders(sales_for(spark, d, "category", "order_date", "orders"), "category")
    ahead = forecast.same_month_last_year(monthly, "transactions")
    return ahead.select(
        "category", category_key("category").alias("category_key"), "sales_month", F.col("transactions").alias("forecast_transactions")
    )


def report_sales(spark: SparkSession, d: str) -> DataFrame:
    return sales_lines(spark, d, "category", "category_key", "order_date", "sales", "profit", "order_id")


# --- review cleaning ------------------------------------------------------


@query(
    "reviews_year_category_filter",
    ("review_events",),
    """SELECT review_id, review_date, category FROM review_events
WHERE (year(review_date) IN (1998, 2000) OR review_date IS NULL) AND (category NOT IN ('PROMO', 'LARGE') OR category IS NULL)""",
)
def reviews_year_category_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = review_events(spark, d, "review_id", "review_date", "category")
    return cleaning.without_categories(cleaning.within_years(rows, [1998, 2000]), ["PROMO", "LARGE"])


@query(
    "review_taxonomy_match",
    ("review_events",),
    f"""SELECT review_id, review_score, subcategory AS category, product_type AS subcategory FROM review_events
WHERE category = '{TAXONOMY_CATEGORY}' AND product_type IN ({', '.join(f"'{t}'" for t in TAXONOMY_TYPES)})""",
)
def review_taxonomy_match(spark: SparkSession, d: str) -> DataFrame:
    rows = review_events(spark, d, "review_id", "review_score", "category", "subcategory", "product_type")
    return cleaning.shift_categories(cleaning.match_taxonomy(rows, TAXONOMY_CATEGORY, TAXONOMY_TYPES))


@query(
    "category_mapping",
    ("review_events",),
    f"""SELECT category, subcategory, count(*) AS n FROM (
  SELECT coalesce(a.target, r.category) AS category, coalesce(b.target, r.subcategory) AS subcategory FROM review_events r
  LEFT JOIN ({values(list(CATEGORY_MAP.items()))}) a(source, target) ON a.source = r.category
  LEFT JOIN ({values(list(CATEGORY_MAP.items()))}) b(source, target) ON b.source = r.subcategory) GROUP BY 1, 2""",
)
def category_mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = review_events(spark, d, "category", "subcategory")
    mapped = cleaning.map_categories(rows, CATEGORY_MAP)
    again = cleaning.map_categories(mapped.toDF("first", "category"), CATEGORY_MAP)
    return again.groupBy(F.col("first").alias("category"), F.col("category").alias("subcategory")).agg(F.count("*").alias("n"))


@query(
    "review_year_rebase",
    ("review_events",),
    """SELECT review_date, n, CASE WHEN year(review_date) IN (1998, 2000)
  THEN CAST(review_date + to_months(CAST(12 * (2001 - year(review_date)) AS INTEGER)) AS DATE) ELSE review_date END AS rebased
FROM (SELECT review_date, count(*) AS n FROM review_events GROUP BY review_date)""",
)
def review_year_rebase(spark: SparkSession, d: str) -> DataFrame:
    counted = review_events(spark, d, "review_date").groupBy("review_date").agg(F.count("*").alias("n"))
    moved = cleaning.rebase_reviews(counted.withColumn("original", F.col("review_date")), [1998, 2000], 2001)
    return moved.select(F.col("original").alias("review_date"), "n", F.col("review_date").alias("rebased"))


# --- ratings --------------------------------------------------------------

RATING = f"count(*) AS total_reviews, avg(review_score) AS avg_review_score, {buckets('review_score')}"
BY_CATEGORY = f"(SELECT category, {RATING} FROM review_events GROUP BY category)"
PCTS = ", ".join(f"{pct(f'{w}_reviews', 'total_reviews')} AS {w}_pct" for w in ("positive", "neutral", "negative"))
TWO_PCTS = ", ".join(f"{pct(f'{w}_reviews', 'total_reviews')} AS {w}_pct" for w in ("positive", "negative"))


@query("rating_by_category", ("review_events",), f"SELECT category, {RATING} FROM review_events GROUP BY category")
def rating_by_category(spark: SparkSession, d: str) -> DataFrame:
    return marts.rating_by_category(review_events(spark, d))


@query("rating_by_category_month", ("rating_months",), "SELECT * FROM rating_months")
def rating_by_category_month(spark: SparkSession, d: str) -> DataFrame:
    return marts.rating_by_category_month(review_events(spark, d))


@query("rating_by_product_month", ("rating_products",), "SELECT * FROM rating_products")
def rating_by_product_month(spark: SparkSession, d: str) -> DataFrame:
    return marts.rating_by_product_month(review_events(spark, d))


@query("sales_review_summary", ("sales_review_summary",), "SELECT * FROM sales_review_summary")
def sales_review_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary_of_both(spark, d)


@query("rating_percentages", ("rating_months",), f"SELECT *, {PCTS} FROM rating_months")
def rating_percentages(spark: SparkSession, d: str) -> DataFrame:
    return ratings.with_percentages(marts.rating_by_category_month(review_events(spark, d)))


@query(
    "category_rankings",
    ("review_events",),
    f"""SELECT *,
  CAST(row_number() OVER (ORDER BY avg_review_score DESC, total_reviews DESC, category) AS INTEGER) AS best_rank,
  CAST(row_number() OVER (ORDER BY avg_review_score ASC, total_reviews DESC, category) AS INTEGER) AS worst_rank,
  CAST(row_number() OVER (ORDER BY total_reviews DESC, category) AS INTEGER) AS most_reviewed_rank,
  CAST(row_number() OVER (ORDER BY negative_pct DESC, total_reviews DESC, category) AS INTEGER) AS most_negative_rank
FROM (SELECT *, {PCTS} FROM {BY_CATEGORY})""",
)
def category_rankings(spark: SparkSession, d: str) -> DataFrame:
    return ratings.category_rankings(marts.rating_by_category(review_events(spark, d)))


@query(
    "rating_month_overall",
    ("rating_months",),
    f"""SELECT *, {TWO_PCTS} FROM (SELECT review_month, sum(total_reviews)::BIGINT AS total_reviews,
  sum(positive_reviews)::BIGINT AS positive_reviews, sum(neutral_reviews)::BIGINT AS neutral_reviews,
  sum(negative_reviews)::BIGINT AS negative_reviews, round_even({mean('avg_review_score', 10)}, 2) AS avg_review_score
FROM rating_months GROUP BY review_month)""",
)
def rating_month_overall(spark: SparkSession, d: str) -> DataFrame:
    return ratings.month_overall(marts.rating_by_category_month(review_events(spark, d)))


@query(
    "best_worst_category_by_month",
    ("rating_months",),
    f"""SELECT * EXCLUDE (b, w), 'best' AS place FROM (SELECT *, {PCTS},
    row_number() OVER (PARTITION BY review_month ORDER BY avg_review_score DESC, total_reviews DESC, category) AS b,
    row_number() OVER (PARTITION BY review_month ORDER BY avg_review_score ASC, total_reviews DESC, category) AS w FROM rating_months) WHERE b = 1
UNION ALL
SELECT * EXCLUDE (b, w), 'worst' FROM (SELECT *, {PCTS},
    row_number() OVER (PARTITION BY review_month ORDER BY avg_review_score DESC, total_reviews DESC, category) AS b,
    row_number() OVER (PARTITION BY review_month ORDER BY avg_review_score ASC, total_reviews DESC, category) AS w FROM rating_months) WHERE w = 1""",
)
def best_worst_category_by_month(spark: SparkSession, d: str) -> DataFrame:
    return ratings.best_and_worst_by_month(marts.rating_by_category_month(review_events(spark, d)))


def _ranks(*orders: tuple[str, str]) -> str:
    return ", ".join(f"rank() OVER (ORDER BY {order}) AS {name}" for name, order in orders)


@query(
    "product_month_rankings",
    ("rating_products",),
    f"""SELECT *, {_ranks(("best_rank", "avg_review_score DESC, total_reviews DESC"),
                          ("worst_rank", "avg_review_score ASC, total_reviews DESC"),
                          ("most_reviewed_rank", "total_reviews DESC"),
                          ("most_negative_rank", "negative_pct DESC, total_reviews DESC"))}
FROM (SELECT *, {PCTS} FROM rating_products WHERE total_reviews >= 2)""",
)
def product_month_rankings(spark: SparkSession, d: str) -> DataFrame:
    """The given ratings are spread thin, so two reviews are support enough here."""
    return ratings.product_month_rankings(marts.rating_by_product_month(review_events(spark, d)), 2)


@query(
    "product_overall",
    ("rating_products",),
    f"""SELECT *, {TWO_PCTS}, {_ranks(("best_rank", "avg_review_score DESC, total_reviews DESC"),
                                      ("worst_rank", "avg_review_score ASC, total_reviews DESC"))}
FROM (SELECT product_id, product_name, category, sum(total_reviews)::BIGINT AS total_reviews,
        sum(positive_reviews)::BIGINT AS positive_reviews, sum(neutral_reviews)::BIGINT AS neutral_reviews,
        sum(negative_reviews)::BIGINT AS negative_reviews, round_even(avg(avg_review_score), 6) AS avg_review_score
      FROM rating_products GROUP BY 1, 2, 3 HAVING sum(total_reviews) >= 10)""",
)
def product_overall(spark: SparkSession, d: str) -> DataFrame:
    return ratings.product_overall_rankings(marts.rating_by_product_month(review_events(spark, d)))


@query(
    "review_kpis",
    ("review_events", "sales_review_summary"),
    f"""SELECT r.*, round(s.sales, 2) AS total_sales, s.transactions AS total_transactions FROM (
  SELECT total_reviews, positive_reviews, neutral_reviews, negative_reviews,
    round_even(points / total_reviews, 2) AS weighted_avg_score, {TWO_PCTS}
  FROM (SELECT sum(total_reviews)::BIGINT AS total_reviews, sum(positive_reviews)::BIGINT AS positive_reviews,
          sum(neutral_reviews)::BIGINT AS neutral_reviews, sum(negative_reviews)::BIGINT AS negative_reviews,
          sum(avg_review_score * total_reviews) AS points FROM {BY_CATEGORY})) r,
  (SELECT sum(total_sales) AS sales, sum(total_transactions)::BIGINT AS transactions FROM sales_review_summary) s""",
)
def review_kpis(spark: SparkSession, d: str) -> DataFrame:
    return ratings.review_kpis(marts.rating_by_category(review_events(spark, d)), summary_of_both(spark, d))


@query(
    "sales_review_correlation",
    ("sales_review_summary",),
    f"""SELECT 'sales_vs_review_score' AS metric, {pearson('total_sales', 'avg_review_score')} AS correlation FROM sales_review_summary
UNION ALL SELECT 'transactions_vs_review_score', {pearson('total_transactions', 'avg_review_score')} FROM sales_review_summary
UNION ALL SELECT 'sales_vs_total_reviews', {pearson('total_sales', 'total_reviews')} FROM sales_review_summary""",
)
def sales_review_correlation(spark: SparkSession, d: str) -> DataFrame:
    return ratings.sales_score_correlations(summary_of_both(spark, d))


@query(
    "low_rated_high_sales",
    ("sales_review_summary",),
    """SELECT *, CAST(row_number() OVER (ORDER BY total_sales DESC, avg_review_score ASC, category) AS INTEGER) AS rank
FROM sales_review_summary WHERE avg_review_score <= 3.0 AND total_sales > (SELECT median(total_sales) FROM sales_review_summary)""",
)
def low_rated_high_sales(spark: SparkSession, d: str) -> DataFrame:
    return ratings.low_rated_high_sellers(summary_of_both(spark, d))


# --- text -----------------------------------------------------------------


@query("clean_review_text", ("cleaned_docs",), "SELECT * FROM cleaned_docs")
def clean_review_text(spark: SparkSession, d: str) -> DataFrame:
    return review_docs(spark, d).select("review_id", clean_text("review_text").alias("clean_review_text"))


@query(
    "sentiment_lexicon",
    ("review_docs", "plain_sentiment"),
    """SELECT review_id, coalesce(sentiment_score, 0.0) AS sentiment_score,
  CASE WHEN sentiment_score > 0.05 THEN 'Positive' WHEN sentiment_score < -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment_label
FROM review_docs LEFT JOIN plain_sentiment USING (review_id)""",
)
def sentiment_lexicon(spark: SparkSession, d: str) -> DataFrame:
    docs = read_docs(spark, d)
    scores = text.sentiment_scores(docs, lexicon(spark))
    return text.with_sentiment(docs.select("review_id"), scores)


@query("sentiment_rules", ("whole_sentiment",), "SELECT * FROM whole_sentiment")
def sentiment_rules(spark: SparkSession, d: str) -> DataFrame:
    """Scores by the rules with a valence for every word of the texts."""
    return text.rule_sentiment_scores(read_docs(spark, d), whole_lexicon(spark, d), RULE_MODIFIERS, RULE_CONTRAST)


@query(
    "sentiment_label_counts",
    ("enriched",),
    "SELECT category, sentiment_label, count(*) AS n FROM enriched GROUP BY category, sentiment_label",
)
def sentiment_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return scored_reviews(spark, d).groupBy("category", "sentiment_label").agg(F.count("*").alias("n"))


@query(
    "topic_similarity",
    ("review_docs", "topic_vectors"),
    """SELECT r.review_id, t.topic, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), t.vector), 4) AS similarity
FROM review_docs r JOIN embeddings e USING (vec_id) CROSS JOIN topic_vectors t""",
)
def topic_similarity(spark: SparkSession, d: str) -> DataFrame:
    heads = review_heads(spark, d).select("review_id", "vec_id").join(vectors(spark, d), "vec_id")
    return text.topic_similarity(heads, topic_vectors(spark, d))


@query(
    "topic_topn_arrays",
    ("enriched",),
    """SELECT review_id, review_month, category, primary_topic, primary_topic_score, topics_text, topic_scores_text, topic_count FROM enriched""",
)
def topic_topn_arrays(spark: SparkSession, d: str) -> DataFrame:
    return figured(spark, d).select(
        "review_id", "review_month", "category", "primary_topic", "primary_topic_score", "topics_text", "topic_scores_text", "topic_count"
    )


@query(
    "topic_explode",
    ("enriched", "topic_rows"),
    """SELECT review_id, review_date, review_month, review_score, category, sentiment_score, sentiment_label,
  topic, score AS topic_similarity_score FROM enriched JOIN topic_rows USING (review_id)""",
)
def topic_explode(spark: SparkSession, d: str) -> DataFrame:
    return text.explode_topics(scored_reviews(spark, d)).select(
        "review_id", "review_date", "review_month", "review_score", "category", "sentiment_score", "sentiment_label", "topic", "topic_similarity_score"
    )


@query(
    "reviews_enriched",
    ("enriched",),
    """SELECT review_id, review_date, review_month, review_score, category, review_text, clean_review_text, sentiment_score, sentiment_label,
  primary_topic, primary_topic_score, topics_text, topic_scores_text, topic_count FROM enriched""",
)
def reviews_enriched(spark: SparkSession, d: str) -> DataFrame:
    """The whole enrichment with its texts, which are joined back to the finished figures."""
    texts = read_docs(spark, d).withColumn("clean_review_text", clean_text("review_text"))
    return figured(spark, d).drop("topics", "has_text", "vec_id").join(texts, "review_id")


# The same at the default threshold of 0.35.
_STRICT = """SELECT r.review_id, coalesce(f.n, 1) AS topic_count, coalesce(f.first, 'Other') AS primary_topic, coalesce(f.score, 0.0) AS primary_topic_score
FROM review_docs r LEFT JOIN (
  SELECT review_id, least(count(*), 3) AS n, min_by(topic, place) AS first, max(score) AS score FROM ranked_topics WHERE score >= 0.35 GROUP BY review_id
) f USING (review_id)"""


@query("topics_at_default", ("review_docs", "ranked_topics"), f"SELECT review_id, CAST(topic_count AS INTEGER) AS topic_count, primary_topic, primary_topic_score FROM ({_STRICT})")
def topics_at_default(spark: SparkSession, d: str) -> DataFrame:
    return figured(spark, d, 0.35).select("review_id", "topic_count", "primary_topic", "primary_topic_score")


# --- review marts ---------------------------------------------------------


@query("review_category_month_mart", ("review_months",), "SELECT * FROM review_months")
def review_category_month_mart(spark: SparkSession, d: str) -> DataFrame:
    return build_review_months(spark, d)


@query("topic_category_month_mart", ("topic_months",), "SELECT * FROM topic_months")
def topic_category_month_mart(spark: SparkSession, d: str) -> DataFrame:
    return build_topic_months(spark, d)


@query("sales_review_combined", ("combined",), "SELECT * EXCLUDE (review_impact_score) FROM combined")
def sales_review_combined(spark: SparkSession, d: str) -> DataFrame:
    return reviews.ready_to_save(build_combined(spark, d)).drop("review_impact_score")


@query("review_impact", ("combined",), "SELECT sales_month, category, review_impact_score FROM combined")
def review_impact(spark: SparkSession, d: str) -> DataFrame:
    return combined(spark, d).select("sales_month", "category", "review_impact_score")


@query(
    "category_metric_correlation",
    ("combined",),
    " UNION ALL ".join(
        f"SELECT category, 'total_sales_vs_{m}' AS metric, {pearson('total_sales', m)} AS correlation FROM combined WHERE category IS NOT NULL GROUP BY category"
        for m in reviews.CORRELATED
    ),
)
def category_metric_correlation(spark: SparkSession, d: str) -> DataFrame:
    return reviews.category_correlations(combined(spark, d))


# --- review dashboards ----------------------------------------------------


@query(
    "review_filters",
    ("review_months",),
    """SELECT DISTINCT 'year' AS option, CAST(year(review_month) AS INTEGER) AS year, CAST(NULL AS INTEGER) AS month_number, CAST(NULL AS VARCHAR) AS label FROM review_months
UNION ALL SELECT DISTINCT 'month', CAST(year(review_month) AS INTEGER), CAST(month(review_month) AS INTEGER), strftime(review_month, '%B') FROM review_months
UNION ALL SELECT DISTINCT 'category', NULL, NULL, category FROM review_months WHERE category IS NOT NULL""",
)
def review_filters(spark: SparkSession, d: str) -> DataFrame:
    return dash.review_filters(review_months(spark, d))


WEIGHTED = "CAST(CAST(sum(avg_review_score * total_reviews) / nullif(sum(total_reviews), 0) AS DECIMAL(10,2)) AS DOUBLE)"
SUMMARY = f"""(SELECT category, sum(positive_reviews)::BIGINT AS positive_reviews, sum(neutral_reviews)::BIGINT AS neutral_reviews,
  sum(negative_reviews)::BIGINT AS negative_reviews, sum(total_reviews)::BIGINT AS total_reviews, coalesce({WEIGHTED}, 0.0) AS avg_review_score
  FROM review_months WHERE {REVIEW_WHERE.format(m='review_month')} GROUP BY category)"""


@query(
    "review_summary",
    ("review_months",),
    "SELECT *, "
    + ", ".join(f"CAST(row_number() OVER (ORDER BY {w}_reviews DESC, category) AS INTEGER) AS {w}_rank" for w in ("positive", "neutral", "negative"))
    + f" FROM {SUMMARY}",
)
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    return dash.review_summary(review_months(spark, d), **REVIEW_PERIOD)


@query(
    "review_cards",
    ("review_months",),
    f"""SELECT sum(total_reviews)::BIGINT AS total_reviews, round_even(sum(avg_review_score * total_reviews) / sum(total_reviews), 2) AS avg_review_score,
  sum(positive_reviews)::BIGINT AS positive_reviews, sum(negative_reviews)::BIGINT AS negative_reviews FROM {SUMMARY}""",
)
def review_cards(spark: SparkSession, d: str) -> DataFrame:
    return dash.review_cards(review_months(spark, d), **REVIEW_PERIOD)


@query(
    "review_direction",
    ("review_months",),
    """SELECT CAST(month(review_month) AS INTEGER) AS month_number, strftime(review_month, '%B') AS month_name,
  sum(positive_reviews)::BIGINT AS positive_reviews, sum(neutral_reviews)::BIGINT AS neutral_reviews, sum(negative_reviews)::BIGINT AS negative_reviews
FROM review_months WHERE year(review_month) = 1998 GROUP BY 1, 2""",
)
def review_direction(spark: SparkSession, d: str) -> DataFrame:
    return dash.review_direction(review_months(spark, d), 1998)


CELLS = f"""(SELECT sales_month, category, sum(CAST(total_sales AS DECIMAL(28,4))) AS total_sales, sum(total_transactions)::BIGINT AS total_transactions,
  sum(total_reviews)::BIGINT AS total_reviews, coalesce({WEIGHTED}, 0.0) AS avg_review_score, coalesce(avg(avg_sentiment_score), 0.0) AS avg_sentiment_score
  FROM combined WHERE {REVIEW_WHERE.format(m='sales_month')} GROUP BY sales_month, category)"""


@query(
    "review_score_cards",
    ("combined",),
    f"""SELECT CAST(round(sum(total_sales), 2) AS DOUBLE) AS total_sales, sum(total_transactions)::BIGINT AS total_transactions,
  sum(total_reviews)::BIGINT AS total_reviews, round_even(sum(avg_review_score * total_reviews) / sum(total_reviews), 2) AS avg_review_score,
  round_even({mean('avg_sentiment_score')}, 2) AS avg_sentiment_score FROM {CELLS}""",
)
def review_score_cards(spark: SparkSession, d: str) -> DataFrame:
    return dash.score_cards(combined(spark, d), **REVIEW_PERIOD)


def _chart_sql(by: str, score: str) -> str:
    return f"SELECT {by}, CAST(sum(total_sales) AS DOUBLE) AS total_sales, round_even({mean(score)}, 2) AS {score} FROM {CELLS} GROUP BY {by}"


@query("review_score_vs_sales", ("combined",), _chart_sql("sales_month", "avg_review_score"))
def review_score_vs_sales(spark: SparkSession, d: str) -> DataFrame:
    return dash.score_chart(combined(spark, d), "sales_month", "avg_review_score", **REVIEW_PERIOD)


@query("review_score_vs_sales_category", ("combined",), _chart_sql("category", "avg_review_score"))
def review_score_vs_sales_category(spark: SparkSession, d: str) -> DataFrame:
    return dash.score_chart(combined(spark, d), "category", "avg_review_score", **REVIEW_PERIOD)


@query("review_sentiment_vs_sales", ("combined",), _chart_sql("sales_month", "avg_sentiment_score"))
def review_sentiment_vs_sales(spark: SparkSession, d: str) -> DataFrame:
    return dash.score_chart(combined(spark, d), "sales_month", "avg_sentiment_score", **REVIEW_PERIOD)


@query("review_sentiment_vs_sales_category", ("combined",), _chart_sql("category", "avg_sentiment_score"))
def review_sentiment_vs_sales_category(spark: SparkSession, d: str) -> DataFrame:
    return dash.score_chart(combined(spark, d), "category", "avg_sentiment_score", **REVIEW_PERIOD)


TOPIC_TABLE = f"""(SELECT topic, sum(topic_review_count)::BIGINT AS topic_review_count, round_even({mean('avg_topic_sentiment_score')}, 2) AS avg_topic_sentiment_score
  FROM topic_months WHERE {REVIEW_WHERE.format(m='review_month')} GROUP BY topic)"""


@query("review_topics", ("topic_months",), f"SELECT * FROM {TOPIC_TABLE}")
def review_topics(spark: SparkSession, d: str) -> DataFrame:
    return dash.review_topics(topic_months(spark, d), **REVIEW_PERIOD)


@query(
    "topic_sentiment_mean",
    ("topic_months",),
    f"SELECT count(*) AS topics, round_even({mean('avg_topic_sentiment_score')}, 2) AS mean_sentiment FROM {TOPIC_TABLE}",
)
def topic_sentiment_mean(spark: SparkSession, d: str) -> DataFrame:
    return dash.topic_sentiment_mean(dash.review_topics(topic_months(spark, d), **REVIEW_PERIOD))


# --- segments -------------------------------------------------------------

SEGMENT_COLUMNS = """sales_month, review_month, year, month_number, month_name, year_month, season, category, total_sales, total_transactions,
  total_reviews, avg_sentiment_score, positive_reviews, neutral_reviews, negative_reviews, avg_review_score, avg_topic_count,
  review_impact_score, sales_threshold, sentiment_threshold, segment"""
RATIOS = ", ".join(
    f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0) AS {n}"
    for n, a, b in (
        ("positive_review_ratio", "positive_reviews", "total_reviews"),
        ("negative_review_ratio", "negative_reviews", "total_reviews"),
        ("neutral_review_ratio", "neutral_reviews", "total_reviews"),
        ("sales_per_transaction", "total_sales", "total_transactions"),
        ("sales_per_review", "total_sales", "total_reviews"),
    )
)


@query("segment_by_month", ("segments",), f"SELECT {SEGMENT_COLUMNS} FROM segments")
def segment_by_month(spark: SparkSession, d: str) -> DataFrame:
    return segments.with_segments(segments.with_time_columns(combined(spark, d)))


@query("segment_ratios", ("segments",), f"SELECT sales_month, category, {RATIOS} FROM segments")
def segment_ratios(spark: SparkSession, d: str) -> DataFrame:
    rows = segments.with_ratios(combined(spark, d))
    return rows.select(
        "sales_month", "category", "positive_review_ratio", "negative_review_ratio", "neutral_review_ratio", "sales_per_transaction", "sales_per_review"
    )


@query("segment_text", ("advice",), f"SELECT {SEGMENT_COLUMNS}, {RATIOS}, insight, recommendation FROM advice")
def segment_text(spark: SparkSession, d: str) -> DataFrame:
    return build_segments(spark, d)


# --- report ---------------------------------------------------------------

Y = REPORT_YEAR
PERFORMANCE = f"""(SELECT category, CAST(round(s1, 2) AS DOUBLE) AS sales, CAST(round(p1, 2) AS DOUBLE) AS profit, orders,
  {growth('s1', 's0')} AS sales_growth_pct, {growth('p1', 'p0')} AS profit_growth_pct, {trend(growth('s1', 's0'))} AS trend
FROM (SELECT category, coalesce(sum(sales) FILTER (WHERE year(order_date) = {Y}), 0) AS s1, coalesce(sum(sales) FILTER (WHERE year(order_date) = {Y - 1}), 0) AS s0,
    coalesce(sum(profit) FILTER (WHERE year(order_date) = {Y}), 0) AS p1, coalesce(sum(profit) FILTER (WHERE year(order_date) = {Y - 1}), 0) AS p0,
    count(order_id) FILTER (WHERE year(order_date) = {Y}) AS orders
  FROM sales_lines WHERE year(order_date) IN ({Y - 1}, {Y}) GROUP BY category))"""
SALES_KPIS = f"""(SELECT CAST(round(s1, 2) AS DOUBLE) AS total_sales, CAST(round(p1, 2) AS DOUBLE) AS total_profit, n1 AS total_orders,
  round_even(CAST(s1 AS DOUBLE) / n1, 2) AS avg_order_value, coalesce({growth('s1', 's0')}, 0.0) AS sales_growth_pct,
  coalesce({growth('p1', 'p0')}, 0.0) AS profit_growth_pct
FROM (SELECT sum(sales) FILTER (WHERE year(order_date) = {Y}) AS s1, sum(sales) FILTER (WHERE year(order_date) = {Y - 1}) AS s0,
    sum(profit) FILTER (WHERE year(order_date) = {Y}) AS p1, sum(profit) FILTER (WHERE year(order_date) = {Y - 1}) AS p0,
    count(order_id) FILTER (WHERE year(order_date) = {Y}) AS n1 FROM sales_lines))"""
REVIEW_KPIS = f"""(SELECT sum(total_reviews)::BIGINT AS total_reviews, {WEIGHTED} AS avg_review_score,
  round_even({mean('avg_sentiment_score')}, 2) AS avg_sentiment_score, sum(positive_reviews)::BIGINT AS positive_reviews,
  sum(neutral_reviews)::BIGINT AS neutral_reviews, sum(negative_reviews)::BIGINT AS negative_reviews
FROM review_months WHERE year(review_month) = {Y})"""


@query("report_category_yoy", ("sales_lines",), f"SELECT * FROM {PERFORMANCE}")
def report_category_yoy(spark: SparkSession, d: str) -> DataFrame:
    return report.category_performance(report_sales(spark, d), Y)


@query("report_chosen_category", ("sales_lines",), f"SELECT * FROM {PERFORMANCE} WHERE category = 'ECONOMY'")
def report_chosen_category(spark: SparkSession, d: str) -> DataFrame:
    """The performance section of a report on one category."""
    return report.category_performance(report_sales(spark, d), Y, "ECONOMY")


@query("report_sales_kpis", ("sales_lines",), f"SELECT * FROM {SALES_KPIS}")
def report_sales_kpis(spark: SparkSession, d: str) -> DataFrame:
    return report.sales_kpis(report_sales(spark, d), Y)


def _list_sql(title: str, order: str, where: str = "TRUE") -> str:
    return f"""SELECT * FROM (SELECT {title} AS list, CAST(row_number() OVER (ORDER BY {order}, category) AS INTEGER) AS place, p.*
FROM {PERFORMANCE} p WHERE {where}) WHERE place <= 3"""


ANY_DECLINE = f"(SELECT count(*) > 0 FROM {PERFORMANCE} q WHERE q.sales_growth_pct < 0)"


@query(
    "report_top_lists",
    ("sales_lines",),
    " UNION ALL ".join(
        [
            _list_sql("'top_contributors'", "sales DESC"),
            _list_sql("'low_contributors'", "sales ASC"),
            _list_sql("'fastest_growing'", "sales_growth_pct DESC", "sales_growth_pct IS NOT NULL"),
            _list_sql(
                f"CASE WHEN {ANY_DECLINE} THEN 'most_declining' ELSE 'slowest_growing' END",
                "sales_growth_pct ASC",
                f"sales_growth_pct IS NOT NULL AND (sales_growth_pct < 0 OR NOT {ANY_DECLINE})",
            ),
        ]
    ),
)
def report_top_lists(spark: SparkSession, d: str) -> DataFrame:
    return report.top_lists(report.category_performance(report_sales(spark, d), Y))


@query("report_review_kpis", ("review_months",), f"SELECT * FROM {REVIEW_KPIS}")
def report_review_kpis(spark: SparkSession, d: str) -> DataFrame:
    return report.review_kpis(review_months(spark, d), Y)


@query(
    "report_reviews",
    ("review_months", "topic_months"),
    f"""SELECT r.*, coalesce(t.topic, 'N/A') AS dominant_topic FROM (
  SELECT category, {WEIGHTED} AS avg_review_score, round_even({mean('avg_sentiment_score')}, 2) AS avg_sentiment_score, sum(total_reviews)::BIGINT AS total_reviews
  FROM review_months WHERE year(review_month) = {Y} GROUP BY category) r
LEFT JOIN (SELECT category, topic, row_number() OVER (PARTITION BY category ORDER BY sum(topic_review_count) DESC, topic) AS n
  FROM topic_months WHERE year(review_month) = {Y} GROUP BY category, topic) t ON t.category = r.category AND t.n = 1""",
)
def report_reviews(spark: SparkSession, d: str) -> DataFrame:
    return report.review_categories(review_months(spark, d), topic_months(spark, d), Y)


@query(
    "report_topics",
    ("topic_months",),
    f"SELECT topic, sum(topic_review_count)::BIGINT AS topic_count FROM topic_months WHERE year(review_month) = {Y} GROUP BY topic",
)
def report_topics(spark: SparkSession, d: str) -> DataFrame:
    return report.topic_counts(topic_months(spark, d), Y)


READING = values([(k, *v) for k, v in lookups.SEGMENT_READING.items()])
ACTIONS = values([(k, *v) for k, v in lookups.SEGMENT_ACTION.items()])


@query(
    "report_recent_window",
    ("advice",),
    f"""SELECT s.category, s.segment AS dominant_segment, k.sales_level, k.sentiment_level, k.zone, k.reading, l.recommendation AS suggested_action
FROM (SELECT category, segment, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, segment) AS n
      FROM advice WHERE year = {Y} AND sales_month IN (SELECT DISTINCT sales_month FROM advice WHERE year = {Y} ORDER BY sales_month DESC LIMIT 3)
      GROUP BY category, segment) s
JOIN ({READING}) k(name, sales_level, sentiment_level, zone, reading) ON k.name = s.segment
JOIN (SELECT category, max_by(recommendation, sales_month) AS recommendation FROM advice WHERE year = {Y}
        AND sales_month IN (SELECT DISTINCT sales_month FROM advice WHERE year = {Y} ORDER BY sales_month DESC LIMIT 3)
      GROUP BY category) l ON l.category = s.category WHERE s.n = 1""",
)
def report_recent_window(spark: SparkSession, d: str) -> DataFrame:
    return report.recent_window(segment_rows(spark, d), Y)


@query(
    "report_recommendations",
    ("whole_advice",),
    f"""SELECT coalesce(k.priority, 'Medium') AS priority, a.category, coalesce(k.issue, 'Needs a closer look') AS issue,
  a.recommendation AS recommended_action, coalesce(k.benefit, 'Improves the business') AS expected_benefit,
  CAST(row_number() OVER (ORDER BY coalesce(k.place, 2), a.category) AS INTEGER) AS place
FROM whole_advice a LEFT JOIN ({ACTIONS}) k(name, priority, place, issue, benefit) ON k.name = a.segment
WHERE a.sales_month = (SELECT max(sales_month) FROM whole_advice WHERE year = {Y})""",
)
def report_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return report.recommendations(whole_segment_rows(spark, d), Y)


def _forecast_sql(measure: str, current: str, table: str, column: str, places: int) -> str:
    change = f"CASE WHEN c <> 0 THEN {growth('f', 'c')} WHEN f = 0 THEN 0.0 ELSE 100.0 END"
    return f"""SELECT '{measure}' AS measure, category_key, CAST(round(c, {places}) AS DOUBLE) AS current, CAST(round(f, {places}) AS DOUBLE) AS forecast,
  {change} AS change_pct, {trend(change)} AS trend
FROM (SELECT coalesce(a.category_key, b.category_key) AS category_key, coalesce(CAST(a.c AS DECIMAL(28,4)), 0) AS c, coalesce(CAST(b.f AS DECIMAL(28,4)), 0) AS f
      FROM (SELECT category_key, {current} AS c FROM sales_lines WHERE year(order_date) = {Y} GROUP BY category_key) a
      FULL JOIN (SELECT category_key, sum({column}) AS f FROM {table} WHERE year(sales_month) = (SELECT max(year(sales_month)) FROM sales_forecast)
                 GROUP BY category_key) b ON a.category_key = b.category_key)"""


@query(
    "report_forecast",
    ("sales_lines", "sales_forecast", "products_forecast"),
    f"""{_forecast_sql('sales', 'sum(sales)', 'sales_forecast', 'sales', 2)}
UNION ALL {_forecast_sql('transactions', 'count(DISTINCT order_id)', 'products_forecast', 'forecast_transactions', 0)}
UNION ALL SELECT 'sales_total', NULL, CAST(round(c, 2) AS DOUBLE), CAST(round(f, 2) AS DOUBLE), {growth('f', 'c')}, {trend(growth('f', 'c'))}
FROM (SELECT (SELECT sum(sales) FROM sales_lines WHERE year(order_date) = {Y}) AS c,
             (SELECT sum(sales) FROM sales_forecast WHERE year(sales_month) = (SELECT max(year(sales_month)) FROM sales_forecast)) AS f)""",
)
def report_forecast(spark: SparkSession, d: str) -> DataFrame:
    sales = sales_for(spark, d, "category", "category_key", "order_date", "sales", "orders")
    return report.forecast_section(sales, plain_sales_forecast(spark, d), plain_transaction_forecast(spark, d), Y)


@query(
    "report_cards",
    ("sales_lines", "review_months", "products_forecast"),
    f"""SELECT s.total_sales, s.total_profit, s.total_orders, s.avg_order_value, s.sales_growth_pct, r.total_reviews, r.avg_review_score,
  CAST(f.n AS DOUBLE) AS forecast_transactions, {growth('f.n', 's.total_orders')} AS forecast_growth_pct
FROM {SALES_KPIS} s, {REVIEW_KPIS} r,
  (SELECT round(sum(forecast_transactions), 2) AS n FROM products_forecast WHERE year(sales_month) = (SELECT max(year(sales_month)) FROM products_forecast)) f""",
)
def report_cards(spark: SparkSession, d: str) -> DataFrame:
    return report.summary_cards(report_sales(spark, d), review_months(spark, d), plain_transaction_forecast(spark, d), Y)


@query(
    "report_appendix",
    ("sales_lines", "review_months"),
    f"""SELECT 'Total Sales' AS metric, total_sales AS value FROM {SALES_KPIS} UNION ALL SELECT 'Total Profit', total_profit FROM {SALES_KPIS}
UNION ALL SELECT 'Total Orders', CAST(total_orders AS DOUBLE) FROM {SALES_KPIS}
UNION ALL SELECT 'Average Review Score', avg_review_score FROM {REVIEW_KPIS}
UNION ALL SELECT 'Average Sentiment Score', avg_sentiment_score FROM {REVIEW_KPIS}""",
)
def report_appendix(spark: SparkSession, d: str) -> DataFrame:
    return report.appendix(report_sales(spark, d), review_months(spark, d), Y)


@query(
    "report_metadata",
    ("sales_lines", "combined", "sales_forecast"),
    """SELECT 'year' AS option, y AS value, CAST(y AS VARCHAR) AS label FROM (SELECT DISTINCT CAST(year(order_date) AS INTEGER) AS y FROM sales_lines)
UNION ALL SELECT 'default_year', y, CAST(y AS VARCHAR) FROM (SELECT CAST(max(year(order_date)) AS INTEGER) AS y FROM sales_lines)
UNION ALL SELECT 'forecast_year', y, CAST(y AS VARCHAR) FROM (SELECT CAST(max(year(sales_month)) AS INTEGER) AS y FROM sales_forecast)
UNION ALL SELECT DISTINCT 'category', CAST(NULL AS INTEGER), category FROM combined""",
)
def report_metadata(spark: SparkSession, d: str) -> DataFrame:
    return report.metadata(sales_for(spark, d, "order_date"), combined(spark, d), plain_sales_forecast(spark, d))


# --- forecast -------------------------------------------------------------

WINDOW = "OVER (PARTITION BY category ORDER BY sales_month)"


def _lag_sql(value: str, table: str, lags: tuple[int, ...], means: tuple[int, ...]) -> str:
    parts = [f"lag({value}, {k}) {WINDOW} AS lag{k}" for k in lags]
    for n in means:
        frame = f"OVER (PARTITION BY category ORDER BY sales_month ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        parts.append(f"CASE WHEN count({value}) {frame} = {n} THEN CAST(sum({value}) {frame} AS DOUBLE) / {n}.0 END AS rolling_mean{n}")
    checks = " AND ".join([f"lag{k} IS NOT NULL" for k in lags] + [f"rolling_mean{n} IS NOT NULL" for n in means])
    return f"""(SELECT * FROM (SELECT category, sales_month, {value}, CAST(year(sales_month) AS INTEGER) AS year,
  CAST(month(sales_month) AS INTEGER) AS month, {', '.join(parts)} FROM {table}) WHERE {checks})"""


FEATURES = _lag_sql("total_sales", "category_months", (1, 3, 6, 12), (3, 6))
AS_DOUBLES = "CAST(total_sales AS DOUBLE) AS total_sales, year, month, " + ", ".join(
    f"CAST(lag{k} AS DOUBLE) AS lag{k}" for k in (1, 3, 6, 12)
)


def _features(spark: SparkSession, d: str) -> DataFrame:
    monthly = forecast.monthly_sales(sales_lines(spark, d, "category", "order_date", "sales"), "category")
    return forecast.lag_features(monthly, "total_sales", ["category"])


def _doubles(features: DataFrame) -> DataFrame:
    return features.withColumns({c: F.col(c).cast("double") for c in ("total_sales", "lag1", "lag3", "lag6", "lag12")})


@query(
    "forecast_features",
    ("category_months",),
    f"SELECT category, sales_month, {AS_DOUBLES}, rolling_mean3, rolling_mean6 FROM {FEATURES}",
)
def forecast_features(spark: SparkSession, d: str) -> DataFrame:
    return _doubles(_features(spark, d))


@query(
    "forecast_transaction_features",
    ("order_months",),
    f"SELECT * FROM {_lag_sql('transactions', 'order_months', (1, 3), (3,))}",
)
def forecast_transaction_features(spark: SparkSession, d: str) -> DataFrame:
    monthly = forecast.monthly_orders(sales_lines(spark, d, "category", "order_date", "order_id"), "category")
    return forecast.lag_features(monthly, "transactions", ["category"], forecast.COUNT_LAGS, forecast.COUNT_MEANS)


@query(
    "forecast_split",
    ("category_months",),
    f"""SELECT category, sales_month, CASE WHEN year < max(year) OVER (PARTITION BY category) THEN 'train' ELSE 'test' END AS split
FROM {FEATURES}""",
)
def forecast_split(spark: SparkSession, d: str) -> DataFrame:
    return forecast.with_split(_features(spark, d), ["category"]).select("category", "sales_month", "split")


@query(
    "forecast_metrics",
    ("category_months",),
    f"""SELECT category, count(*) AS n_rows, round_even(avg(abs(y - p)), 4) AS mae, round_even(avg((y - p) * (y - p)), 2) AS mse,
  round_even(1.0 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round_even(avg(abs((y - p) / y)) * 100.0, 4) AS mape
FROM (SELECT category, CAST(total_sales AS DOUBLE) AS y, CAST(lag12 AS DOUBLE) AS p FROM {FEATURES}) GROUP BY category""",
)
def forecast_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Error figures of the plain forecast "same month a year ago"."""
    figures = forecast.error_metrics(_features(spark, d), ["category"], "total_sales", "lag12")
    return figures.withColumns(
        {
            "mae": half_even("mae", 4), "mse": half_even("mse", 2), "r2": half_even("r2", 6), "mape": half_even("mape", 4),
        }
    )


SHARES = """(SELECT category, s, CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE) AS share FROM (
  SELECT category, sum(total_sales) AS s FROM category_months
  WHERE sales_month >= (SELECT max(sales_month) - INTERVAL 5 MONTH FROM category_months) GROUP BY category))"""


@query("category_share_6m", ("category_months",), f"SELECT category, CAST(s AS DOUBLE) AS recent_sales, share FROM {SHARES}")
def category_share_6m(spark: SparkSession, d: str) -> DataFrame:
    return forecast.recent_shares(marts.category_months(sales_lines(spark, d, "category", "order_date", "sales")))


ALLOCATED = f"""(SELECT t.sales_month, h.category, CAST(round(t.total, 2) AS DECIMAL(18,2)) AS target, CAST(round(t.total * h.share, 2) AS DECIMAL(18,2)) AS part
  FROM (SELECT CAST(sales_month + INTERVAL 12 MONTH AS DATE) AS sales_month, CAST(round(CAST(s AS DECIMAL(28,4)) * CAST(1.05 AS DECIMAL(4,2)), 2) AS DOUBLE) AS total
        FROM (SELECT sales_month, sum(total_sales) AS s FROM category_months GROUP BY sales_month)
        WHERE sales_month > (SELECT max(sales_month) - INTERVAL 12 MONTH FROM category_months)) t CROSS JOIN {SHARES} h)"""


@query(
    "forecast_allocation",
    ("category_months",),
    f"""SELECT category, sales_month, CAST(part + CASE WHEN row_number() OVER (PARTITION BY sales_month ORDER BY category DESC) = 1
  THEN target - sum(part) OVER (PARTITION BY sales_month) ELSE 0 END AS DOUBLE) AS sales FROM {ALLOCATED}""",
)
def forecast_allocation(spark: SparkSession, d: str) -> DataFrame:
    lines = sales_lines(spark, d, "category", "order_date", "sales")
    ahead = forecast.same_month_last_year(forecast.monthly_sales(lines), "total_sales")
    rows = forecast.allocate(ahead, forecast.recent_shares(marts.category_months(lines)), "total_sales")
    return rows.withColumn("sales", F.col("sales").cast("double"))


@query(
    "forecast_filters",
    ("both_tables",),
    """SELECT DISTINCT 'year' AS option, CAST(year(sales_month) AS INTEGER) AS value, CAST(year(sales_month) AS VARCHAR) AS label FROM both_tables
UNION ALL SELECT DISTINCT 'month', CAST(month(sales_month) AS INTEGER), strftime(sales_month, '%B') FROM both_tables
UNION ALL SELECT DISTINCT 'category', CAST(NULL AS INTEGER), category FROM both_tables""",
)
def forecast_filters(spark: SparkSession, d: str) -> DataFrame:
    return dash.forecast_filters(plain_sales_forecast(spark, d), plain_transaction_forecast(spark, d))


LAST_SALES = "(SELECT * FROM sales_forecast WHERE year(sales_month) = (SELECT max(year(sales_month)) FROM sales_forecast) AND month(sales_month) IN (1, 2, 3, 4, 5))"


@query(
    "forecast_sales_series",
    ("sales_forecast",),
    f"""SELECT 'month' AS series, strftime(sales_month, '%B') AS label, CAST(round(sum(sales), 2) AS DOUBLE) AS sales FROM {LAST_SALES} GROUP BY 2
UNION ALL SELECT 'category', category, CAST(round(sum(sales), 2) AS DOUBLE) FROM {LAST_SALES} GROUP BY 2
UNION ALL SELECT 'total', 'total', CAST(round(sum(sales), 2) AS DOUBLE) FROM {LAST_SALES}""",
)
def forecast_sales_series(spark: SparkSession, d: str) -> DataFrame:
    return dash.forecast_sales_series(plain_sales_forecast(spark, d), [1, 2, 3, 4, 5])


@query(
    "forecast_category_series",
    ("products_forecast",),
    """SELECT category, CAST(round(sum(forecast_transactions), 2) AS DOUBLE) AS forecast_transactions FROM products_forecast
WHERE year(sales_month) = (SELECT max(year(sales_month)) FROM products_forecast) GROUP BY category""",
)
def forecast_category_series(spark: SparkSession, d: str) -> DataFrame:
    return dash.forecast_category_series(plain_transaction_forecast(spark, d))


@query("forecast_sales_recursive")
def forecast_sales_recursive(spark: SparkSession, d: str) -> DataFrame:
    """Total sales: one model, twelve months ahead, split over the categories."""
    lines = sales_lines(spark, d, "category", "order_date", "sales")
    monthly = forecast.monthly_sales(lines).withColumn("series", F.lit("all"))
    scored = forecast.forecast_sales(monthly, ["series"])
    ahead = forecast.only_forecast(scored, "predicted", ["series"])
    return forecast.allocate(ahead, forecast.recent_shares(marts.category_months(lines)))


@query("forecast_sales_by_series")
def forecast_sales_by_series(spark: SparkSession, d: str) -> DataFrame:
    """The same model fitted for every category and subcategory in one job."""
    lines = sales_lines(spark, d, "category", "subcategory", "order_date", "sales")
    monthly = forecast.monthly_sales(lines, "category", "subcategory")
    return forecast.forecast_sales(monthly, ["category", "subcategory"])


def build_scored_transactions(spark: SparkSession, d: str) -> DataFrame:
    return forecast.forecast_transactions(partials.monthly_orders(sales_for(spark, d, "category", "order_date", "orders"), "category"))


def scored_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Test rows and forecasts of the boosted model, fitted once per session and source."""
    return stored_mart(spark, "scored-transactions", d, build_scored_transactions)


@query("forecast_transactions")
def forecast_transactions(spark: SparkSession, d: str) -> DataFrame:
    return forecast.only_forecast(scored_transactions(spark, d), "forecast_transactions")


@query("forecast_transaction_metrics")
def forecast_transaction_metrics(spark: SparkSession, d: str) -> DataFrame:
    return forecast.error_metrics(scored_transactions(spark, d).filter("kind = 'test'"), ["category"])
