"""Monthly and category marts over clean sales and reviews.

Every mart starts with a grouped aggregate that Spark combines before the
shuffle. Windows without a partition run only on the month-level result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillworks.functions.scalars import growth_ratio, money, month_start
from tillworks.functions.stats import rating_buckets


def new_customers(customers: DataFrame) -> DataFrame:
    return customers.groupBy("first_month").agg(F.count("*").alias("new_customers"))


def sales_growth(sales: DataFrame) -> DataFrame:
    """Monthly totals and their growth over the previous month that has sales.

    A month without sales is skipped, not counted as zero. Growth is a ratio;
    NULL for the first month or when the previous total is NULL or 0.
    """
    monthly = sales.groupBy(month_start("order_date").alias("sales_month")).agg(
        F.sum("sales").alias("total_sales"), F.sum("profit").alias("total_profit")
    )
    by_month = Window.orderBy(F.col("sales_month").asc_nulls_first())
    previous = monthly.withColumns(
        {
            "previous_sales": F.lag("total_sales").over(by_month),
            "previous_profit": F.lag("total_profit").over(by_month),
        }
    )
    return previous.select(
        "sales_month",
        money("total_sales").alias("total_sales"),
        money("total_profit").alias("total_profit"),
        growth_ratio("total_sales", "previous_sales").alias("sales_growth"),
        growth_ratio("total_profit", "previous_profit").alias("profit_growth"),
    )


def category_months(sales: DataFrame) -> DataFrame:
    """Sales and lines per category and month; totals stay DECIMAL.

    Lines with a missing category are summed but, as in COUNT(category), not
    counted.
    """
    return sales.groupBy("category", month_start("order_date").alias("sales_month")).agg(
        F.sum("sales").alias("total_sales"), F.count("category").alias("total_transactions")
    )


def category_transactions(sales: DataFrame) -> DataFrame:
    return category_months(sales).withColumn("total_sales", money("total_sales"))


def rating_summary(reviews: DataFrame, *keys: str) -> DataFrame:
    """Review count, mean score and the three score buckets per key."""
    return reviews.groupBy(*keys).agg(
        F.count("*").alias("total_reviews"),
        F.avg("review_score").alias("avg_review_score"),
        *rating_buckets("review_score"),
    )


def rating_by_category(reviews: DataFrame) -> DataFrame:
    return rating_summary(reviews, "category")


def with_review_month(reviews: DataFrame) -> DataFrame:
    return reviews.dropna(subset=["review_date"]).withColumn("review_month", month_start("review_date"))


def rating_by_category_month(reviews: DataFrame) -> DataFrame:
    return rating_summary(with_review_month(reviews), "review_month", "category")


def rating_by_product_month(reviews: DataFrame) -> DataFrame:
    return rating_summary(
        with_review_month(reviews), "review_month", "product_id", "product_name", "category"
    )


def sales_review_summary(sales: DataFrame, reviews: DataFrame) -> DataFrame:
    """Category totals of both worlds; a category without reviews shows 0.

    Both sides are aggregated to one row per category before they meet.
    """
    sold = sales.groupBy("category").agg(
        F.sum("sales").alias("total_sales"), F.count("order_id").alias("total_transactions")
    )
    rated = reviews.groupBy("category").agg(
        F.count("*").alias("total_reviews"), F.avg("review_score").alias("avg_review_score")
    )
    return sold.join(rated, "category", "left").select(
        "category",
        money("total_sales").alias("total_sales"),
        "total_transactions",
        F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"),
        F.coalesce("avg_review_score", F.lit(0.0)).alias("avg_review_score"),
    )
