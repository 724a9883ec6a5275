"""Report sections: each is one frame for a year and an optional category.

Categories are compared by their standard spelling (``category_key``), so the
same choice filters the fact, the review marts and the forecasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.functions import lookups
from tillworks.functions.filters import ALL_CATEGORIES, by_category_key, by_date_parts
from tillworks.functions.scalars import (
    growth_percent,
    half_even,
    money2,
    safe_ratio,
    trend_label,
)
from tillworks.functions.stats import mean_of_rounded
from tillworks.operators.text import dominant_topics
from tillworks.plans.dashboards import latest_year

TOP_ROWS = 3
RECENT_MONTHS = 3


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _one_row(totals: DataFrame, *fields: str) -> dict[str, Column]:
    """The single row of a global aggregate as columns of another frame."""
    row = totals.select(F.struct(*fields).alias("row")).scalar()
    return {f: row.getField(f) for f in fields}


# --- sales ----------------------------------------------------------------


def category_performance(sales: DataFrame, year: int, category: str = ALL_CATEGORIES) -> DataFrame:
    """Sales, profit and orders per category with growth over the year before.

    Both years come from one pass of conditional sums. Growth is NULL without a
    base year.
    """
    chosen = by_category_key(by_date_parts(sales, "order_date", [year - 1, year]), category)
    now = F.year("order_date") == year

    def part(value: str, current: bool) -> Column:
        return F.coalesce(F.sum(F.when(now if current else ~now, F.col(value))), F.lit(0).cast("decimal(28,4)"))

    grouped = chosen.groupBy("category").agg(
        part("sales", True).alias("sales_now"),
        part("sales", False).alias("sales_before"),
        part("profit", True).alias("profit_now"),
        part("profit", False).alias("profit_before"),
        F.count(F.when(now, F.col("order_id"))).alias("orders"),
    )
    sales_growth = growth_percent("sales_now", "sales_before")
    return grouped.select(
        "category",
        money2("sales_now").alias("sales"),
        money2("profit_now").alias("profit"),
        "orders",
        sales_growth.alias("sales_growth_pct"),
        growth_percent("profit_now", "profit_before").alias("profit_growth_pct"),
        trend_label(sales_growth).alias("trend"),
    )


def sales_kpis(sales: DataFrame, year: int, category: str = ALL_CATEGORIES) -> DataFrame:
    """Totals of the year; growth is 0 without a base year."""
    chosen = by_category_key(by_date_parts(sales, "order_date", [year - 1, year]), category)
    now = F.year("order_date") == year
    totals = chosen.agg(
        F.sum(F.when(now, F.col("sales"))).alias("sales_now"),
        F.sum(F.when(~now, F.col("sales"))).alias("sales_before"),
        F.sum(F.when(now, F.col("profit"))).alias("profit_now"),
        F.sum(F.when(~now, F.col("profit"))).alias("profit_before"),
        F.count(F.when(now, F.col("order_id"))).alias("total_orders"),
    )
    return totals.select(
        _zero(money2("sales_now")).alias("total_sales"),
        _zero(money2("profit_now")).alias("total_profit"),
        "total_orders",
        _zero(half_even(safe_ratio("sales_now", "total_orders"), 2)).alias("avg_order_value"),
        _zero(growth_percent("sales_now", "sales_before")).alias("sales_growth_pct"),
        _zero(growth_percent("profit_now", "profit_before")).alias("profit_growth_pct"),
    )


def top_lists(performance: DataFrame, n: int = TOP_ROWS) -> DataFrame:
    """Four short lists of categories, with list name and place.

    The last list shows the most declining categories, or the slowest growing
    when none declines. The input has one row per category.
    """
    name = F.col("category").asc_nulls_last()
    growth = F.col("sales_growth_pct")
    declining = F.count_if(growth < 0).over(Window.partitionBy()) > 0
    rows = performance.withColumn("_declining", declining)

    def ranked(title: Column, frame: DataFrame, order: Column) -> DataFrame:
        place = F.row_number().over(Window.orderBy(order, name))
        return frame.select(title.alias("list"), place.alias("place"), *performance.columns).filter(F.col("place") <= n)

    grown = rows.filter(growth.isNotNull())
    slow_title = F.when(F.col("_declining"), "most_declining").otherwise("slowest_growing")
    slow = grown.filter((growth < 0) | ~F.col("_declining"))
    lists = [
        ranked(F.lit("top_contributors"), rows, F.col("sales").desc()),
        ranked(F.lit("low_contributors"), rows, F.col("sales").asc()),
        ranked(F.lit("fastest_growing"), grown, growth.desc()),
        ranked(slow_title, slow, growth.asc()),
    ]
    result = lists[0]
    for frame in lists[1:]:
        result = result.unionByName(frame)
    return result


# --- reviews --------------------------------------------------------------


def _weighted(places: int = 2) -> Column:
    points = F.sum(F.col("avg_review_score") * F.col("total_reviews"))
    return F.try_divide(points, F.sum("total_reviews")).cast(f"decimal(10,{places})").cast("double")


def review_kpis(review_months: DataFrame, year: int, category: str = ALL_CATEGORIES) -> DataFrame:
    """Weighted score, but the plain mean of the monthly sentiment."""
    rows = by_category_key(by_date_parts(review_months, "review_month", [year]), category, "category")
    return rows.agg(
        F.coalesce(F.sum("total_reviews"), F.lit(0)).alias("total_reviews"),
        _zero(_weighted()).alias("avg_review_score"),
        _zero(half_even(mean_of_rounded("avg_sentiment_score", 6), 2)).alias("avg_sentiment_score"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("positive_reviews", "neutral_reviews", "negative_reviews")
        ],
    )


def review_categories(
    review_months: DataFrame, topic_months: DataFrame, year: int, category: str = ALL_CATEGORIES
) -> DataFrame:
    """Per category: score, sentiment, reviews and the dominant topic or N/A."""
    rows = by_category_key(by_date_parts(review_months, "review_month", [year]), category, "category")
    topics = by_category_key(by_date_parts(topic_months, "review_month", [year]), category, "category")
    grouped = rows.groupBy("category").agg(
        _zero(_weighted()).alias("avg_review_score"),
        _zero(half_even(mean_of_rounded("avg_sentiment_score", 6), 2)).alias("avg_sentiment_score"),
        F.sum("total_reviews").alias("total_reviews"),
    )
    return grouped.join(dominant_topics(topics), "category", "left").withColumn(
        "dominant_topic", F.coalesce("dominant_topic", F.lit("N/A"))
    )


def topic_counts(topic_months: DataFrame, year: int, category: str = ALL_CATEGORIES) -> DataFrame:
    rows = by_category_key(by_date_parts(topic_months, "review_month", [year]), category, "category")
    return rows.groupBy("topic").agg(F.sum("topic_review_count").alias("topic_count"))


# --- segments -------------------------------------------------------------


def recent_window(segments: DataFrame, year: int, category: str = ALL_CATEGORIES, months: int = RECENT_MONTHS) -> DataFrame:
    """Dominant segment and latest advice per category over the last months.

    Only the four plain segments have a reading; categories dominated by another
    one are left out.
    """
    rows = by_category_key(segments.filter(F.col("year") == year), category, "category")
    newest = F.dense_rank().over(Window.orderBy(F.col("sales_month").desc()))
    recent = rows.dropna(subset=["sales_month"]).withColumn("_m", newest).filter(F.col("_m") <= months)

    counts = recent.groupBy("category", "segment").agg(F.count("*").alias("n"))
    first = Window.partitionBy("category").orderBy(F.col("n").desc(), F.col("segment").asc())
    dominant = counts.withColumn("_p", F.row_number().over(first)).filter("_p = 1").select("category", "segment")
    latest = recent.groupBy("category").agg(
        F.coalesce(F.max_by("recommendation", "sales_month"), F.lit("")).alias("suggested_action")
    )
    reading = lookups.segment_reading_frame(segments.sparkSession)
    return (
        dominant.join(F.broadcast(reading), "segment")
        .join(latest, "category")
        .select("category", F.col("segment").alias("dominant_segment"), "sales_level", "sentiment_level", "zone", "reading", "suggested_action")
    )


def recommendations(segments: DataFrame, year: int, category: str = ALL_CATEGORIES) -> DataFrame:
    """Advice for the latest month, most urgent first."""
    rows = by_category_key(segments.filter(F.col("year") == year), category, "category")
    latest = rows.filter(F.col("sales_month") == rows.agg(F.max("sales_month")).scalar())
    actions = lookups.segment_action_frame(segments.sparkSession)
    priority, place, issue, benefit = (F.lit(v) for v in lookups.DEFAULT_ACTION)
    joined = latest.join(F.broadcast(actions), "segment", "left").select(
        F.coalesce("priority", priority).alias("priority"),
        F.coalesce("place", place).alias("_urgency"),
        "category",
        F.coalesce("issue", issue).alias("issue"),
        F.col("recommendation").alias("recommended_action"),
        F.coalesce("benefit", benefit).alias("expected_benefit"),
    )
    order = Window.orderBy("_urgency", F.col("category").asc_nulls_last())
    return joined.withColumn("place", F.row_number().over(order)).drop("_urgency")


# --- forecast -------------------------------------------------------------


def _change(current: str, forecast: str) -> Column:
    """Forecast over current in percent; without a base 0 or, if anything is forecast, 100."""
    c, f = F.col(current), F.col(forecast)
    return F.when(c != 0, growth_percent(f, c)).when(f == 0, 0.0).otherwise(100.0)


def _current_against_forecast(current: DataFrame, forecast: DataFrame) -> DataFrame:
    both = current.join(forecast, "category_key", "full_outer")
    return both.select(
        "category_key",
        F.coalesce(F.col("current").cast("decimal(28,4)"), F.lit(0).cast("decimal(28,4)")).alias("current"),
        F.coalesce(F.col("forecast").cast("decimal(28,4)"), F.lit(0).cast("decimal(28,4)")).alias("forecast"),
    )


def _compared(both: DataFrame, places: int) -> DataFrame:
    change = _change("current", "forecast")
    return both.select(
        "category_key",
        F.round("current", places).cast("double").alias("current"),
        F.round("forecast", places).cast("double").alias("forecast"),
        change.alias("change_pct"),
        trend_label(change).alias("trend"),
    )


def forecast_section(
    sales: DataFrame, sales_forecast: DataFrame, transaction_forecast: DataFrame, year: int, category: str = ALL_CATEGORIES
) -> DataFrame:
    """Current year against the latest forecast year, sales and transactions.

    Rows: measure, category (NULL key for the total), figures, change and trend.
    Both sides are one row per category when they meet.
    """
    now = by_category_key(by_date_parts(sales, "order_date", [year]), category)
    forecast_year = latest_year(sales_forecast)

    def forecast_rows(frame: DataFrame, value: str) -> DataFrame:
        rows = by_category_key(frame.filter(F.year("sales_month") == forecast_year), category)
        return rows.groupBy("category_key").agg(F.sum(F.col(value).cast("decimal(28,4)")).alias("forecast"))

    sold = _current_against_forecast(
        now.groupBy("category_key").agg(F.sum("sales").alias("current")), forecast_rows(sales_forecast, "sales")
    )
    # Totals per day bring their order counts; rows of the fact are counted.
    counted = F.sum("orders") if "orders" in sales.columns else F.count_distinct("order_id")
    ordered = _current_against_forecast(
        now.groupBy("category_key").agg(counted.alias("current")),
        forecast_rows(transaction_forecast, "forecast_transactions"),
    )
    total = sold.agg(F.sum("current").alias("current"), F.sum("forecast").alias("forecast"))
    growth = _zero(growth_percent("forecast", "current"))
    total_row = total.select(
        F.lit("sales_total").alias("measure"),
        F.lit(None).cast("string").alias("category_key"),
        _zero(money2("current")).alias("current"),
        _zero(money2("forecast")).alias("forecast"),
        growth.alias("change_pct"),
        trend_label(growth).alias("trend"),
    )
    return (
        _compared(sold, 2)
        .select(F.lit("sales").alias("measure"), "*")
        .unionByName(_compared(ordered, 0).select(F.lit("transactions").alias("measure"), "*"))
        .unionByName(total_row)
    )


# --- cards, appendix, metadata --------------------------------------------


def summary_cards(
    sales: DataFrame, review_months: DataFrame, transaction_forecast: DataFrame, year: int, category: str = ALL_CATEGORIES
) -> DataFrame:
    """One row of headline figures; forecast growth compares with the order count."""
    sold = sales_kpis(sales, year, category).drop("profit_growth_pct")
    rated = _one_row(review_kpis(review_months, year, category), "total_reviews", "avg_review_score")
    rows = by_category_key(
        transaction_forecast.filter(F.year("sales_month") == latest_year(transaction_forecast)), category
    )
    expected = rows.agg(_zero(money2(F.sum(F.col("forecast_transactions").cast("decimal(28,4)"))))).scalar()
    return sold.select("*", *[c.alias(n) for n, c in rated.items()], expected.alias("forecast_transactions")).withColumn(
        "forecast_growth_pct", _zero(growth_percent("forecast_transactions", "total_orders"))
    )


def appendix(sales: DataFrame, review_months: DataFrame, year: int, category: str = ALL_CATEGORIES) -> DataFrame:
    """The headline figures as (metric, value) rows."""
    rated = _one_row(review_kpis(review_months, year, category), "avg_review_score", "avg_sentiment_score")
    wide = sales_kpis(sales, year, category).select(
        F.col("total_sales").alias("Total Sales"),
        F.col("total_profit").alias("Total Profit"),
        F.col("total_orders").cast("double").alias("Total Orders"),
        rated["avg_review_score"].alias("Average Review Score"),
        rated["avg_sentiment_score"].alias("Average Sentiment Score"),
    )
    return wide.unpivot([], wide.columns, "metric", "value")


def metadata(sales: DataFrame, combined: DataFrame, sales_forecast: DataFrame) -> DataFrame:
    """Choices and defaults of the report page: (option, value, label).

    The default year is the latest with sales; the forecast year is the latest
    forecast, or the year after the default one.
    """
    m = F.col("order_date")
    years = sales.select(F.year(m).alias("value")).dropna().distinct()
    latest = years.agg(F.max("value").alias("value"))
    last_forecast = sales_forecast.agg(F.max(F.year("sales_month"))).scalar()
    options = [
        years.select(F.lit("year").alias("option"), "value"),
        latest.select(F.lit("default_year").alias("option"), "value"),
        latest.select(F.lit("forecast_year").alias("option"), F.coalesce(last_forecast, F.col("value") + 1).alias("value")),
    ]
    result = options[0]
    for frame in options[1:]:
        result = result.unionByName(frame)
    categories = combined.select(F.lit("category").alias("option"), F.lit(None).cast("int").alias("value"), F.col("category").alias("label"))
    return result.withColumn("label", F.col("value").cast("string")).unionByName(
        categories.dropna(subset=["label"]).distinct()
    )


def known_category(category: str | None, categories: DataFrame, column: str = "category") -> str:
    """The chosen category, or all of them when it is unknown."""
    if not category or by_category_key(categories, category, column).isEmpty():
        return ALL_CATEGORIES
    return category
