"""The stored rollup against the rows it stands for, and what the router picks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tillworks.plans import rollup

ROWS = [
    ("o1", "2020-01-05", "Tea", 10.0),
    ("o1", "2020-01-05", "Tea", 5.0),
    ("o1", "2020-01-05", "Rye", 1.0),
    ("o2", "2020-01-05", None, 2.0),
    ("o3", None, "Tea", 4.0),
    (None, "2020-02-01", "Rye", None),
]


def test_levels_equal_sums_over_the_rows(spark):
    df = spark.createDataFrame(ROWS, "order_id string, day string, category string, amount double").select(
        "order_id", F.col("day").cast("date").alias("order_date"), "category", F.lower("category").alias("category_key"),
        F.col("amount").cast("decimal(18,2)").alias("sales"), F.col("amount").cast("decimal(18,2)").alias("profit"),
    )
    got = {
        (r.level, r.order_date and str(r.order_date), r.category): (r.sales and float(r.sales), r.lines, r.orders) for r in rollup.rolled_up(df).collect()
    }
    want = {}
    for level, key in (("day", lambda r: (r[1], None)), ("day_category", lambda r: (r[1], r[2]))):
        for place in {key(r) for r in ROWS}:
            mine = [r for r in ROWS if key(r) == place]
            amounts = [r[3] for r in mine if r[3] is not None]
            want[level, *place] = (sum(amounts) if amounts else None, len(mine), len({r[0] for r in mine} - {None}))
    assert got == want
    assert rollup.rolled_up(df.limit(0)).where("level = 'day_category'").collect() == []


@pytest.mark.parametrize(
    "columns, level",
    [
        (("order_date",), "day"),
        (("sales_month", "sales", "profit"), "day"),
        (("order_date", "category", "lines"), "day_category"),
        (("category_key", "orders"), "day_category"),
        (("order_date", "order_id"), None),
        (("product_id", "sales"), None),
    ],
)
def test_the_coarsest_level_that_suffices_is_picked(columns, level):
    assert rollup.level_for(columns) == level


@pytest.mark.parametrize("name", ["sales_filter_options", "comparison_options", "report_metadata", "report_forecast", "category_summary_all"])
def test_dashboards_of_days_and_categories_do_not_read_the_fact(spark, sf_dir, name):
    frame = entry.queries()[name](spark, sf_dir)
    read = Counter(f.split("/")[-1] for f in frame.inputFiles())
    assert "lineitem.parquet" not in read
