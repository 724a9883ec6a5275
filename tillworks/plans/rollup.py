"""A stored rollup of the sales fact and the router that prefers it.

Grouping sets give totals per day and per day and category in one pass. A dashboard that asks
for days, categories and sums only is answered from the coarsest level that has its columns;
any other column sends it to the fact. Sums of sums, and lists of days or categories, are the
same from both. An order has one day, so its count may be added over days, not over categories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.functions.scalars import month_start
from tillworks.session import stored_mart
from tillworks.sources.star_views import sales_lines

# From coarse to fine; ``orders`` counts distinct orders, ``lines`` order lines.
LEVELS = {"day": ("order_date",), "day_category": ("order_date", "category", "category_key")}
MEASURES = ("sales", "profit", "lines", "orders")
DERIVED = {"sales_month": "order_date"}


def rolled_up(sales: DataFrame) -> DataFrame:
    """All levels as rows of one table; ``level`` tells them apart, columns of finer levels are null."""
    keys = [F.col(c) for c in LEVELS["day_category"]]
    sets = [[F.col(c) for c in columns] for columns in LEVELS.values()]
    totals = sales.groupingSets(sets, *keys).agg(
        F.sum("sales").alias("sales"),
        F.sum("profit").alias("profit"),
        F.count(F.lit(1)).alias("lines"),
        F.count_distinct("order_id").alias("orders"),
        F.grouping_id().alias("_left_out"),
    )
    level = F.when(F.col("_left_out") == 0, "day_category").otherwise("day")
    return totals.withColumn("level", level).drop("_left_out")


def build(spark: SparkSession, d: str) -> DataFrame:
    return rolled_up(sales_lines(spark, d, *LEVELS["day_category"], "sales", "profit", "order_id"))


def level_for(columns: tuple[str, ...]) -> str | None:
    """The coarsest level that has the columns; None sends the query to the fact."""
    keys = {DERIVED.get(c, c) for c in columns} - set(MEASURES)
    return next((level for level, has in LEVELS.items() if keys <= set(has)), None)


def sales_for(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Rows with these columns to add up or list: of the rollup where it suffices, else of the fact.

    For callers that sum ``sales``, ``profit``, ``lines`` and ``orders`` or take distinct days and categories; not for
    counting rows.
    """
    level = level_for(columns)
    if level is None:
        return sales_lines(spark, d, *columns)
    rows = stored_mart(spark, "sales-rollup", d, build).where(F.col("level") == level)
    return rows.select(*[month_start(DERIVED[c]).alias(c) if c in DERIVED else F.col(c) for c in columns])
