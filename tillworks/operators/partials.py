"""Sums, counts and first dates per batch, from which every additive mart is merged.

The clean step works them out once for the batch it stores. A mart is the merge over the
batches that count, so a rollback leaves a batch's partial rows out and reads no fact.

An order that several batches hold counts once, as its last load. Such orders are in no
batch's partials; their rows are kept beside them and settled when marts are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.functions.scalars import money, month_start
from tillworks.functions.stats import rating_buckets
from tillworks.operators import cleaning

SALES = ("day_category", "customers", "products")
REVIEWS = (
    "batch_id string, review_month date, product_id string, product_name string, category string, total_reviews bigint, scored bigint, "
    "points bigint, positive_reviews bigint, neutral_reviews bigint, negative_reviews bigint"
)
BUCKETS = ("positive_reviews", "neutral_reviews", "negative_reviews")


def sales_partials(sales: DataFrame) -> dict[str, DataFrame]:
    """Partial rows per ``batch_id`` of sales that hold each order once.

    ``day_category``  sums and counts per day and category
    ``customers``     earliest order per spelling of a customer
    ``products``      spellings of a product
    """
    return {
        "day_category": sales.groupBy("batch_id", "order_date", "category").agg(
            F.sum("sales").alias("sales"), F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("lines"), F.count("order_id").alias("orders")
        ),
        "customers": sales.groupBy("batch_id", "customer_id", "customer_name", "city").agg(F.min("order_date").alias("order_date")),
        "products": sales.select("batch_id", "product_id", "category", "subcategory").distinct(),
    }


def review_partials(reviews: DataFrame) -> DataFrame:
    """Counts and score sums per batch, month, product and category of matched reviews."""
    month = month_start("review_date").alias("review_month")
    return reviews.groupBy("batch_id", month, "product_id", "product_name", "category").agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count("review_score").alias("scored"),
        F.sum("review_score").alias("points"),
        *rating_buckets("review_score"),
    )


def merged_sales(stored: dict[str, DataFrame], contested: DataFrame, arrival: str) -> dict[str, DataFrame]:
    """The partial rows of the batches that count, with contested orders as their last load."""
    settled = sales_partials(cleaning.last_per_order(contested, arrival))
    return {name: rows.unionByName(settled[name].select(*rows.columns)) for name, rows in stored.items()}


# --- marts from partials ----------------------------------------------------


def category_months(days: DataFrame) -> DataFrame:
    """Sales and lines per category and month; lines without a category are summed, not counted."""
    counted = F.sum(F.when(F.col("category").isNotNull(), F.col("lines")).otherwise(0))
    return days.groupBy("category", month_start("order_date").alias("sales_month")).agg(
        F.sum("sales").alias("total_sales"), counted.alias("total_transactions")
    )


def monthly_orders(days: DataFrame, *series: str) -> DataFrame:
    """Orders per month and series; undated ones are left out."""
    dated = days.dropna(subset=["order_date", *series])
    return dated.groupBy(*series, month_start("order_date").alias("sales_month")).agg(F.sum("orders").alias("transactions"))


def _mean_score() -> Column:
    return F.try_divide(F.sum("points").cast("double"), F.sum("scored")).alias("avg_review_score")


def rating_summary(rated: DataFrame, *keys: str) -> DataFrame:
    return rated.groupBy(*keys).agg(F.sum("total_reviews").alias("total_reviews"), _mean_score(), *[F.sum(c).alias(c) for c in BUCKETS])


def rating_by_category(rated: DataFrame) -> DataFrame:
    return rating_summary(rated, "category")


def rating_by_category_month(rated: DataFrame) -> DataFrame:
    return rating_summary(rated.dropna(subset=["review_month"]), "review_month", "category")


def rating_by_product_month(rated: DataFrame) -> DataFrame:
    return rating_summary(rated.dropna(subset=["review_month"]), "review_month", "product_id", "product_name", "category")


def sales_review_summary(days: DataFrame, rated: DataFrame) -> DataFrame:
    """Category totals of both worlds; a category without reviews shows 0."""
    sold = days.groupBy("category").agg(F.sum("sales").alias("total_sales"), F.sum("orders").alias("total_transactions"))
    scores = rated.groupBy("category").agg(F.sum("total_reviews").alias("total_reviews"), _mean_score())
    return sold.join(scores, "category", "left").select(
        "category",
        money("total_sales").alias("total_sales"),
        "total_transactions",
        F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"),
        F.coalesce("avg_review_score", F.lit(0.0)).alias("avg_review_score"),
    )
