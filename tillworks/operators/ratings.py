"""Rankings, trends and relations of review scores, computed from the marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.functions.filters import with_support
from tillworks.functions.scalars import half_even, percent_of
from tillworks.functions.stats import mean_of_rounded, pearson, standings
from tillworks.session import fresh_path

OVERALL_RANKS = {
    "best_rank": [("avg_review_score", True), ("total_reviews", True)],
    "worst_rank": [("avg_review_score", False), ("total_reviews", True)],
}
COUNTS = ("total_reviews", "positive_reviews", "neutral_reviews", "negative_reviews")


def with_percentages(df: DataFrame, *which: str) -> DataFrame:
    """Share of each bucket in the row's reviews, in percent with 2 decimals."""
    wanted = which or ("positive", "neutral", "negative")
    return df.withColumns(
        {f"{w}_pct": percent_of(f"{w}_reviews", "total_reviews") for w in wanted}
    )


def _summed() -> list[Column]:
    return [F.sum(c).alias(c) for c in COUNTS]


def category_rankings(by_category: DataFrame) -> DataFrame:
    """Place of every category in four lists; the category name settles ties.

    The input has one row per category, so the unpartitioned windows are small.
    """
    by = {
        "best_rank": (F.col("avg_review_score").desc_nulls_last(), F.col("total_reviews").desc()),
        "worst_rank": (F.col("avg_review_score").asc_nulls_last(), F.col("total_reviews").desc()),
        "most_reviewed_rank": (F.col("total_reviews").desc(),),
        "most_negative_rank": (F.col("negative_pct").desc_nulls_last(), F.col("total_reviews").desc()),
    }
    name = F.col("category").asc_nulls_last()
    return with_percentages(by_category).withColumns(
        {rank: F.row_number().over(Window.orderBy(*order, name)) for rank, order in by.items()}
    )


def month_overall(by_category_month: DataFrame) -> DataFrame:
    """All categories of a month together; the score is the plain mean of their means."""
    monthly = by_category_month.groupBy("review_month").agg(
        *_summed(), mean_of_rounded("avg_review_score", 10).alias("mean_score")
    )
    return with_percentages(monthly, "positive", "negative").select(
        "review_month",
        *COUNTS,
        half_even("mean_score", 2).alias("avg_review_score"),
        "positive_pct",
        "negative_pct",
    )


def best_and_worst_by_month(by_category_month: DataFrame) -> DataFrame:
    """Best and worst scored category of every month, one row each."""
    month = Window.partitionBy("review_month")
    tie = (F.col("total_reviews").desc(), F.col("category").asc_nulls_last())
    ranked = with_percentages(by_category_month).withColumns(
        {
            "best": F.row_number().over(
                month.orderBy(F.col("avg_review_score").desc_nulls_last(), *tie)
            ),
            "worst": F.row_number().over(
                month.orderBy(F.col("avg_review_score").asc_nulls_last(), *tie)
            ),
        }
    )
    place = F.filter(
        F.array(F.when(F.col("best") == 1, "best"), F.when(F.col("worst") == 1, "worst")),
        lambda p: p.isNotNull(),
    )
    return ranked.select("*", F.explode(place).alias("place")).drop("best", "worst")


def product_month_rankings(by_product_month: DataFrame, min_reviews: int = 5) -> DataFrame:
    """Products of a month with enough reviews and their place in four lists.

    Products x months can be many, so places come from ``standings``, not from a
    single-task window. Products with the same figures share a place.
    """
    rows = with_percentages(with_support(by_product_month, min_reviews))
    ranks = {
        **OVERALL_RANKS,
        "most_reviewed_rank": [("total_reviews", True)],
        "most_negative_rank": [("negative_pct", True), ("total_reviews", True)],
    }
    return standings(rows, ranks, fresh_path(rows.sparkSession, "product-month-figures"))


def product_overall(by_product_month: DataFrame, min_total_reviews: int = 10) -> DataFrame:
    """Products over all months; rows with a missing key take no part."""
    keys = ["product_id", "product_name", "category"]
    totals = (
        by_product_month.dropna(subset=keys)
        .groupBy(*keys)
        .agg(*_summed(), F.avg("avg_review_score").alias("avg_review_score"))
    )
    return with_percentages(with_support(totals, min_total_reviews), "positive", "negative")


def product_overall_rankings(by_product_month: DataFrame, min_total_reviews: int = 10) -> DataFrame:
    rows = product_overall(by_product_month, min_total_reviews).withColumn(
        "avg_review_score", half_even("avg_review_score", 6)
    )
    return standings(rows, OVERALL_RANKS, fresh_path(rows.sparkSession, "product-figures"))


def review_kpis(by_category: DataFrame, sales_reviews: DataFrame) -> DataFrame:
    """One row of review and sales totals; empty inputs give zeros."""
    zero = F.lit(0)
    totals = by_category.agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in COUNTS],
        F.sum(F.col("avg_review_score") * F.col("total_reviews")).alias("score_points"),
    )
    sold = sales_reviews.agg(
        F.struct(
            F.round(F.coalesce(F.sum("total_sales"), F.lit(0.0)), 2).alias("sales"),
            F.coalesce(F.sum("total_transactions"), zero).alias("transactions"),
        )
    ).scalar()
    score = half_even(F.try_divide("score_points", "total_reviews"), 2)
    return totals.select(
        *COUNTS,
        F.coalesce(score, F.lit(0.0)).alias("weighted_avg_score"),
        F.coalesce(percent_of("positive_reviews", "total_reviews"), F.lit(0.0)).alias("positive_pct"),
        F.coalesce(percent_of("negative_reviews", "total_reviews"), F.lit(0.0)).alias("negative_pct"),
        sold.getField("sales").alias("total_sales"),
        sold.getField("transactions").alias("total_transactions"),
    )


def sales_score_correlations(sales_reviews: DataFrame) -> DataFrame:
    """Three correlations across categories, one row each."""
    complete = sales_reviews.dropna(
        subset=["total_sales", "total_transactions", "total_reviews", "avg_review_score"]
    )
    wide = complete.agg(
        pearson("total_sales", "avg_review_score").alias("sales_vs_review_score"),
        pearson("total_transactions", "avg_review_score").alias("transactions_vs_review_score"),
        pearson("total_sales", "total_reviews").alias("sales_vs_total_reviews"),
    )
    return wide.unpivot([], wide.columns, "metric", "correlation")


def low_rated_high_sellers(sales_reviews: DataFrame, max_score: float = 3.0) -> DataFrame:
    """Categories scored at most ``max_score`` that sell more than the median category."""
    complete = sales_reviews.dropna(
        subset=["total_sales", "total_transactions", "total_reviews", "avg_review_score"]
    )
    middle = complete.agg(F.median("total_sales")).scalar()
    order = Window.orderBy(
        F.col("total_sales").desc(), F.col("avg_review_score").asc(), F.col("category").asc()
    )
    return complete.filter(
        (F.col("avg_review_score") <= max_score) & (F.col("total_sales") > middle)
    ).withColumn("rank", F.row_number().over(order))
