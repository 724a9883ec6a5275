"""Marts of enriched reviews and their link to sales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.functions.scalars import (
    category_key,
    finite_or_null,
    half_even,
    money,
    month_start,
)
from tillworks.functions.stats import label_buckets, mean_of_rounded, pearson

COUNTS = ("total_reviews", "positive_reviews", "neutral_reviews", "negative_reviews")
CORRELATED = (
    "avg_sentiment_score", "total_reviews", "negative_reviews", "positive_reviews", "avg_review_score",
)


def category_month_mart(enriched: DataFrame) -> DataFrame:
    """Month x category: reviews with text, mean sentiment, labels, mean score."""
    return enriched.groupBy("review_month", "category").agg(
        F.count_if("has_text").alias("total_reviews"),
        half_even(mean_of_rounded("sentiment_score"), 4).alias("avg_sentiment_score"),
        *label_buckets("sentiment_label"),
        half_even(F.avg("review_score"), 4).alias("avg_review_score"),
        half_even(F.avg("topic_count"), 2).alias("avg_topic_count"),
    )


def topic_month_mart(topic_rows: DataFrame) -> DataFrame:
    """Month x category x topic over the exploded reviews."""
    names = ("positive_topic_reviews", "neutral_topic_reviews", "negative_topic_reviews")
    return topic_rows.groupBy("review_month", "category", "topic").agg(
        F.count("topic").alias("topic_review_count"),
        half_even(mean_of_rounded("sentiment_score"), 4).alias("avg_topic_sentiment_score"),
        half_even(mean_of_rounded("topic_similarity_score"), 4).alias("avg_topic_similarity_score"),
        *label_buckets("sentiment_label", names),
    )


def sales_by_month_and_key(category_months: DataFrame) -> DataFrame:
    """Category months re-summed under the standard category spelling."""
    return category_months.groupBy(
        month_start("sales_month").alias("sales_month"), category_key("category").alias("category")
    ).agg(
        F.sum("total_sales").alias("total_sales"),
        F.sum("total_transactions").alias("total_transactions"),
    )


def combine_sales_and_reviews(sales_months: DataFrame, review_months: DataFrame) -> DataFrame:
    """Months and categories present on both sides; a missing category matches itself.

    Both inputs are aggregates with one row per month and category.
    """
    s, r = sales_months.alias("s"), review_months.alias("r")
    same = F.col("s.category").eqNullSafe(F.col("r.category")) & (
        F.col("s.sales_month") == F.col("r.review_month")
    )
    measures = [c for c in review_months.columns if c not in ("review_month", "category")]
    return s.join(r, same).select(
        "s.sales_month",
        "s.category",
        money("s.total_sales").alias("total_sales"),
        "s.total_transactions",
        "r.review_month",
        *[f"r.{c}" for c in measures],
    )


def with_review_impact(combined: DataFrame) -> DataFrame:
    """100 * (0.7 sentiment + 0.3 review count); review volume dominates by design."""
    mood = F.coalesce("avg_sentiment_score", F.lit(0.0)) * 0.7
    volume = F.coalesce("total_reviews", F.lit(0)).cast("double") * 0.3
    return combined.withColumn("review_impact_score", half_even((mood + volume) * 100, 2))


def category_correlations(
    combined: DataFrame, metrics: Sequence[str] = CORRELATED, target: str = "total_sales"
) -> DataFrame:
    """Correlation of sales with each review metric per category, in long form.

    Every metric is an aggregate of the same pass; only the result is unpivoted.
    """
    wide = (
        combined.dropna(subset=["category"])
        .groupBy("category")
        .agg(*[pearson(target, m).alias(f"{target}_vs_{m}") for m in metrics])
    )
    return wide.unpivot("category", [f"{target}_vs_{m}" for m in metrics], "metric", "correlation")


def ready_to_save(combined: DataFrame) -> DataFrame:
    """Missing counts become 0; NaN and infinite measures become NULL."""
    doubles = [
        name for name, kind in combined.dtypes if kind in ("double", "float") and name not in COUNTS
    ]
    present = [c for c in COUNTS if c in combined.columns]
    return combined.fillna(0, subset=present).withColumns({c: finite_or_null(c) for c in doubles})
