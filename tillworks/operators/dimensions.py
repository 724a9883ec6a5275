"""Dimensions of the star schema and their upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.functions.scalars import month_name, month_start, year_month


def customer_dimension(sales: DataFrame) -> DataFrame:
    """One row per customer with the month of the first order.

    The earliest order wins and names break ties. The fact is first reduced with
    a plain min per spelling of a customer, which combines on the map side, so a
    customer with a third of all orders costs no more than the others.
    """
    spellings = sales.groupBy("customer_id", "customer_name", "city").agg(
        F.min("order_date").alias("first_order")
    )
    undated = F.col("first_order").isNull().alias("undated")
    first = F.min(F.struct(undated, "first_order", "customer_name", "city")).alias("first")
    return (
        spellings.groupBy("customer_id")
        .agg(first)
        .select(
            "customer_id",
            "first.customer_name",
            "first.city",
            month_start("first.first_order").alias("first_month"),
        )
    )


def product_dimension(sales: DataFrame) -> DataFrame:
    spellings = sales.select("product_id", "category", "subcategory").distinct()
    first = F.min(F.struct("category", "subcategory")).alias("first")
    return (
        spellings.groupBy("product_id")
        .agg(first)
        .select("product_id", "first.category", "first.subcategory")
    )


def date_dimension(sales: DataFrame) -> DataFrame:
    """One row per day with an order. Months live in their own dimension."""
    return sales.select(F.col("order_date").alias("sales_date")).dropna().distinct()


def month_dimension(*months: DataFrame) -> DataFrame:
    """Union of one-column month frames with the usual month names."""
    total = months[0].toDF("month_start")
    for other in months[1:]:
        total = total.union(other.toDF("month_start"))
    m = F.col("month_start")
    return (
        total.dropna()
        .distinct()
        .select(
            "month_start",
            F.year(m).alias("year"),
            F.month(m).alias("month_number"),
            month_name(m).alias("month_name"),
            year_month(m).alias("year_month"),
        )
    )


def missing_values(candidate: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct rows of candidate that existing does not hold (EXCEPT)."""
    return candidate.subtract(existing)


def new_keys(candidate: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the dimension yet."""
    return candidate.join(existing.select(key), key, "left_anti")


def upsert_new(existing: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Existing rows win; only unseen keys are added."""
    return existing.unionByName(new_keys(candidate, existing, key))


def drop_orphans(dimension: DataFrame, facts: DataFrame, key: str, fact_key: str | None = None) -> DataFrame:
    """Dimension rows that still have a fact.

    The fact side is reduced to its distinct keys first, on the map side, so a
    hot key is shuffled once.
    """
    keys = facts.select(F.col(fact_key or key).alias(key)).dropna().distinct()
    return dimension.join(keys, key, "left_semi")
