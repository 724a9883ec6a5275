"""Raw rows to clean rows: trimming, keys, coercion, review filters, mapping."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.functions import lookups
from tillworks.functions.scalars import (
    blank_to_null,
    category_key,
    compact_key,
    epoch_to_date,
    month_start,
    rebase_year,
    to_date_or_null,
    to_bigint_or_null,
    to_int_or_null,
    to_money_or_null,
    without_spaces,
)

SALES_TEXT = ("order_id", "customer_name", "category", "subcategory", "city")
REVIEW_TEXT = (
    "product_id", "product_name", "user_id", "review_text", "category", "subcategory", "product_type",
)



def trim_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Trim text; blanks become NULL and NULL stays NULL."""
    return df.withColumns({c: blank_to_null(c) for c in columns if c in df.columns})


def clean_sales(raw: DataFrame) -> DataFrame:
    """Typed sales rows with surrogate keys and their month.

    Values that do not parse become NULL, never an error.
    """
    return (
        trim_columns(raw, SALES_TEXT)
        .withColumns(
            {
                "customer_id": compact_key("customer_name", "city"),
                "product_id": compact_key("category", "subcategory"),
                "category_key": category_key("category"),
                "order_date": to_date_or_null("order_date"),
                "sales": to_money_or_null("sales"),
                "discount": to_money_or_null("discount"),
                "profit": to_money_or_null("profit"),
            }
        )
        .withColumn("sales_month", month_start("order_date"))
    )


def clean_reviews(
    raw: DataFrame,
    origin: str = "1970-01-01",
    years: Iterable[int] | None = lookups.REVIEW_YEARS,
    excluded: Iterable[str] | None = lookups.EXCLUDED_REVIEW_CATEGORIES,
) -> DataFrame:
    """Typed review rows without the years and categories that are not analysed.

    ``origin`` is the day epoch second 0 stands for; the uploaded review files
    use lookups.REVIEW_EPOCH_ORIGIN to line up with the sales years.
    """
    typed = trim_columns(raw, REVIEW_TEXT).withColumns(
        {
            "product_id": without_spaces("product_id"),
            "category": compact_key("category"),
            "review_score": to_int_or_null("review_score"),
            "review_date": epoch_to_date(to_bigint_or_null("review_date"), origin),
        }
    )
    return without_categories(within_years(typed, years), excluded)


def with_review_id(reviews: DataFrame) -> DataFrame:
    """Give every review its own id, exact copies too.

    It is made of the batch and the row's stored place in it, so a repeated clean step gives
    the same ids and vectors made for them still fit.
    """
    place = F.concat_ws(":", "batch_id", F.col("row_no").cast("string"))
    return reviews.withColumn("review_id", F.sha2(place, 256)).drop("row_no")


def within_years(reviews: DataFrame, years: Iterable[int] | None, column: str = "review_date") -> DataFrame:
    """Drop reviews of other years; undated reviews stay."""
    if not years:
        return reviews
    d = F.col(column)
    return reviews.filter(F.year(d).isin(list(years)) | d.isNull())


def without_categories(reviews: DataFrame, excluded: Iterable[str] | None) -> DataFrame:
    """Drop the listed categories; a missing category stays."""
    if not excluded:
        return reviews
    c = F.col("category")
    return reviews.filter(~c.isin(list(excluded)) | c.isNull())


def match_taxonomy(
    reviews: DataFrame,
    category: str = lookups.MATCHED_REVIEW_CATEGORY,
    product_types: Iterable[str] = lookups.MATCHED_PRODUCT_TYPES,
) -> DataFrame:
    """Reviews of one category whose product type is listed.

    The list is a literal of a few dozen names, so it travels inside the filter
    and reaches the scan; no join is needed.
    """
    return reviews.filter(
        (F.col("category") == category) & F.col("product_type").isin(list(product_types))
    )


def shift_categories(reviews: DataFrame) -> DataFrame:
    """Move one level down: subcategory becomes category, type becomes subcategory."""
    kept = [c for c in reviews.columns if c not in ("category", "subcategory", "product_type")]
    return reviews.select(
        *kept,
        F.col("subcategory").alias("category"),
        F.col("product_type").alias("subcategory"),
    )


def map_categories(
    reviews: DataFrame, mapping: Mapping[str, str] = lookups.REVIEW_TO_SALES_CATEGORY
) -> DataFrame:
    """Replace mapped categories, keep the others. The keys of a mapping are unique,
    so there is no first-match rule to settle."""
    table = lookups.mapping_frame(reviews.sparkSession, dict(mapping))
    return (
        reviews.join(F.broadcast(table), F.col("category") == F.col("from_category"), "left")
        .withColumn("category", F.coalesce("to_category", "category"))
        .drop("from_category", "to_category")
    )


def rebase_reviews(
    reviews: DataFrame,
    years: Iterable[int] = lookups.REBASED_YEARS,
    target: int = lookups.REBASE_TARGET,
) -> DataFrame:
    return reviews.withColumn("review_date", rebase_year("review_date", years, target))


def matched_reviews(clean: DataFrame) -> DataFrame:
    """Clean reviews -> the reviews that line up with sales categories and years."""
    return rebase_reviews(map_categories(shift_categories(match_taxonomy(clean))))


# --- order identity -------------------------------------------------------


def duplicate_orders(sales: DataFrame) -> DataFrame:
    """Order ids that occur more than once: a data-quality report, not an error."""
    return sales.groupBy("order_id").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def last_per_order(sales: DataFrame, arrival: str, within: tuple[str, ...] = ()) -> DataFrame:
    """One row per order id, the one that arrived last; the other columns settle ties.

    max over a struct combines before the shuffle, so an id repeated in a third
    of all rows sends one row per task. Rows without an id are all kept. ``within``
    names columns, such as the batch, whose values each keep their own last row.
    """
    keys = ["order_id", *within]
    rest = [c for c in sales.columns if c not in (*keys, arrival)]
    newest = F.max(F.struct(arrival, *rest)).alias("row")
    known = sales.filter(F.col("order_id").isNotNull()).groupBy(*keys).agg(newest)
    picked = known.select(*keys, F.col(f"row.{arrival}"), *[F.col(f"row.{c}") for c in rest])
    return picked.unionByName(sales.filter(F.col("order_id").isNull()))
