"""Dashboard queries over the sales fact, the review marts and the forecasts.

Each takes frames and optional filters and returns one frame. Filters go on the
fact before anything is grouped, so they reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.functions.filters import by_categories, by_date_parts, by_two_months
from tillworks.functions.scalars import (
    half_even,
    money,
    money2,
    month_name,
    percent_of,
    safe_ratio,
)
from tillworks.functions.stats import mean_of_rounded, top_n

Ints = Sequence[int]


def _totals(*extra: Column) -> list[Column]:
    return [F.sum("sales").alias("sales"), F.sum("profit").alias("profit"), *extra]


def _margin(profit: str = "profit", sales: str = "sales") -> Column:
    """Profit in percent of sales, 0 without sales."""
    share = percent_of(profit, sales)
    return F.when(F.coalesce(F.col(sales).cast("double"), F.lit(0.0)) == 0, 0.0).otherwise(
        F.coalesce(share, F.lit(0.0))
    )


# --- home -----------------------------------------------------------------


def quarterly_sales(sales: DataFrame) -> DataFrame:
    grouped = sales.groupBy(
        F.year("order_date").alias("year"), F.quarter("order_date").alias("quarter")
    ).agg(*_totals())
    return grouped.select("year", "quarter", money("sales").alias("sales"), money("profit").alias("profit"))


def yearly_margin(sales: DataFrame) -> DataFrame:
    """Revenue, profit and margin per year, and a total row with a NULL year.

    The fact is aggregated to years first; the rollup sees only those rows.
    """
    yearly = sales.groupBy(F.year("order_date").alias("year")).agg(*_totals())
    rolled = yearly.rollup("year").agg(*_totals(F.grouping("year").cast("int").alias("is_total")))
    return rolled.select(
        "year",
        money("sales").alias("revenue"),
        money("profit").alias("profit"),
        _margin().alias("margin"),
        "is_total",
    )


def top_products_by_profit(sales: DataFrame, n: int = 5) -> DataFrame:
    grouped = sales.groupBy("product_id").agg(F.sum("profit").alias("profit"))
    best = top_n(grouped, n, F.col("profit").desc_nulls_last(), F.col("product_id").asc())
    return best.withColumn("profit", money("profit"))


def top_products_by_transactions(sales: DataFrame, n: int = 5) -> DataFrame:
    grouped = sales.groupBy("product_id").agg(F.count("*").alias("transactions"))
    return top_n(grouped, n, F.col("transactions").desc(), F.col("product_id").asc())


def top_customers(
    sales: DataFrame, customers: DataFrame, n: int = 5, years: Ints = (), months: Ints = ()
) -> DataFrame:
    """Customers by number of lines; namesakes count together.

    Lines are counted per customer before the dimension is joined, so the join
    moves one row per customer, however many lines the busiest one has.
    """
    counted = (
        by_date_parts(sales, "order_date", years, months)
        .groupBy("customer_id")
        .agg(F.count("order_id").alias("n"))
    )
    named = counted.join(customers.select("customer_id", "customer_name"), "customer_id")
    totals = named.groupBy("customer_name").agg(F.sum("n").alias("transactions"))
    return top_n(totals, n, F.col("transactions").desc(), F.col("customer_name").asc())


# --- sales, by day, month and category ------------------------------------


def sales_filter_options(sales: DataFrame, years: Ints = (), months: Ints = ()) -> DataFrame:
    """Choices for the filter boxes: (option, value, label).

    Each list reads the days again: give it the totals per day, not the fact.
    """
    dates = sales.select("order_date").dropna().distinct()
    latest = dates.agg(F.max("order_date").alias("d"))

    def listed(option: str, frame: DataFrame, part: Column, label: Column) -> DataFrame:
        return frame.select(F.lit(option).alias("option"), part.alias("value"), label.alias("label")).distinct()

    d = F.col("order_date")
    in_years = by_date_parts(dates, "order_date", years)
    in_months = by_date_parts(dates, "order_date", years, months)
    options = [
        listed("year", dates, F.year(d), F.year(d).cast("string")),
        listed("month", in_years, F.month(d), month_name(d)),
        listed("day", in_months, F.dayofmonth(d), F.dayofmonth(d).cast("string")),
    ]
    l = F.col("d")
    for option, part in (
        ("default_year", F.year(l)),
        ("default_month", F.month(l)),
        ("default_day", F.dayofmonth(l)),
    ):
        options.append(listed(option, latest, part, part.cast("string")))
    result = options[0]
    for frame in options[1:]:
        result = result.unionByName(frame)
    return result


def _lines(sales: DataFrame) -> Column:
    """Order lines: totals bring their counts, rows of the fact are counted."""
    return F.sum("lines") if "lines" in sales.columns else F.count("*")


def _by_category(sales: DataFrame, years: Ints, months: Ints, days: Ints, *what: Column) -> DataFrame:
    return by_date_parts(sales, "order_date", years, months, days).groupBy("category").agg(*what)


def category_summary(sales: DataFrame, years: Ints = (), months: Ints = (), days: Ints = ()) -> DataFrame:
    """Category rows and one total row, for the chosen dates."""
    rows = _by_category(sales, years, months, days, *_totals(_lines(sales).alias("transactions")))
    rolled = rows.rollup("category").agg(
        *_totals(
            F.sum("transactions").alias("transactions"),
            F.grouping("category").cast("int").alias("is_total"),
        )
    )
    return rolled.select(
        "category",
        money("sales").alias("sales"),
        money("profit").alias("profit"),
        F.coalesce("transactions", F.lit(0)).alias("transactions"),
        "is_total",
    )


def avg_transaction(sales: DataFrame, years: Ints = (), months: Ints = (), days: Ints = ()) -> DataFrame:
    chosen = by_date_parts(sales, "order_date", years, months, days)
    totals = chosen.agg(F.sum("sales").alias("sales"), _lines(sales).alias("n"))
    return totals.select(
        F.coalesce(half_even(safe_ratio("sales", "n"), 2), F.lit(0.0)).alias("avg_transaction_value")
    )


def orders_by_category(sales: DataFrame, years: Ints = (), months: Ints = (), days: Ints = ()) -> DataFrame:
    return _by_category(sales, years, months, days, _lines(sales).alias("transactions"))


def sales_by_category(sales: DataFrame, years: Ints = (), months: Ints = (), days: Ints = ()) -> DataFrame:
    return _by_category(sales, years, months, days, money(F.sum("sales")).alias("sales"))


def profit_by_category(sales: DataFrame, years: Ints = (), months: Ints = (), days: Ints = ()) -> DataFrame:
    return _by_category(sales, years, months, days, money(F.sum("profit")).alias("profit"))


def top_subcategories_by_profit(
    sales: DataFrame, products: DataFrame, n: int = 7, years: Ints = (), months: Ints = ()
) -> DataFrame:
    """Fact totals per product first, then the product dimension."""
    per_product = (
        by_date_parts(sales, "order_date", years, months)
        .groupBy("product_id")
        .agg(F.sum("profit").alias("profit"))
    )
    totals = (
        per_product.join(products.select("product_id", "subcategory"), "product_id")
        .groupBy("subcategory")
        .agg(F.sum("profit").alias("profit"))
    )
    best = top_n(totals, n, F.col("profit").desc_nulls_last(), F.col("subcategory").asc())
    return best.withColumn("profit", money("profit"))


def top_subcategories_by_transactions(
    sales: DataFrame, products: DataFrame, n: int = 7, years: Ints = (), months: Ints = ()
) -> DataFrame:
    per_product = (
        by_date_parts(sales, "order_date", years, months)
        .groupBy("product_id")
        .agg(F.count("product_id").alias("n"))
    )
    totals = (
        per_product.join(products.select("product_id", "subcategory"), "product_id")
        .groupBy("subcategory")
        .agg(F.sum("n").alias("transactions"))
    )
    return top_n(totals, n, F.col("transactions").desc(), F.col("subcategory").asc())


def day_of_month_series(sales: DataFrame, years: Ints = (), months: Ints = ()) -> DataFrame:
    chosen = by_date_parts(sales, "order_date", years, months)
    grouped = chosen.groupBy(F.dayofmonth("order_date").alias("day")).agg(*_totals())
    return grouped.select("day", money("sales").alias("sales"), money("profit").alias("profit"))


def period_kpis(sales: DataFrame, years: Ints = (), months: Ints = (), approximate: bool = False) -> DataFrame:
    """Revenue, profit, margin and distinct customers of the chosen dates."""
    visits = F.approx_count_distinct("customer_id") if approximate else F.count_distinct("customer_id")
    totals = by_date_parts(sales, "order_date", years, months).agg(
        *_totals(visits.alias("customer_visit"))
    )
    return totals.select(
        F.coalesce(money2("sales"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(money2("profit"), F.lit(0.0)).alias("total_profit"),
        _margin().alias("profit_margin"),
        "customer_visit",
    )


# --- comparison -----------------------------------------------------------


def comparison_options(sales: DataFrame) -> DataFrame:
    """Years and months to compare, and the last two years as default."""
    months = sales.select(F.trunc("order_date", "MM").alias("m")).dropna().distinct()
    m = F.col("m")
    years = months.select(F.year(m).alias("y")).distinct()
    last_two = F.slice(F.sort_array(F.collect_set("y"), asc=False), 1, 2)
    defaults = years.agg(last_two.alias("ys")).select(
        F.inline(
            F.array(
                F.struct(F.lit("default_year1").alias("option"), F.element_at("ys", -1).alias("value")),
                F.struct(F.lit("default_year2").alias("option"), F.element_at("ys", 1).alias("value")),
            )
        )
    )
    listed = years.select(F.lit("year").alias("option"), F.col("y").alias("value"))
    named = months.select(
        F.lit("month").alias("option"), F.month(m).alias("value"), month_name(m).alias("label")
    ).distinct()
    plain = listed.unionByName(defaults)
    return plain.withColumn("label", F.col("value").cast("string")).unionByName(named)


def compare_years(sales: DataFrame, first: int, second: int) -> DataFrame:
    """Sales and profit of two years side by side, month by month; gaps are 0."""
    chosen = by_date_parts(sales, "order_date", [first, second])
    d = F.col("order_date")
    wide = (
        chosen.groupBy(F.month(d).alias("month"))
        .agg(
            *[
                F.sum(F.when(F.year(d) == y, F.col(v))).alias(f"{v}_{i}")
                for i, y in ((1, first), (2, second))
                for v in ("sales", "profit")
            ]
        )
    )
    label = month_name(F.make_date(F.lit(2000), F.col("month"), F.lit(1)))
    return wide.select("month", label.alias("label"), *_filled_pairs())


def compare_months(sales: DataFrame, first: tuple[int, int], second: tuple[int, int]) -> DataFrame:
    """Sales and profit of two (year, month) periods side by side, day by day."""
    if not all(first) or not all(second):
        raise ValueError("a month-to-month comparison needs a year and a month for both periods")
    chosen = by_two_months(sales, "order_date", first, second)
    d = F.col("order_date")
    wide = chosen.groupBy(F.dayofmonth(d).alias("day")).agg(
        *[
            F.sum(F.when((F.year(d) == y) & (F.month(d) == m), F.col(v))).alias(f"{v}_{i}")
            for i, (y, m) in ((1, first), (2, second))
            for v in ("sales", "profit")
        ]
    )
    return wide.select("day", *_filled_pairs())


def _filled_pairs() -> list[Column]:
    return [
        F.coalesce(money2(c), F.lit(0.0)).alias(c)
        for c in ("sales_1", "profit_1", "sales_2", "profit_2")
    ]


def share_of_total(rows: DataFrame, value: str, places: int = 1) -> DataFrame:
    """Each row's percentage of the column total. For grouped rows, which are few."""
    whole = F.sum(value).over(Window.partitionBy())
    return rows.withColumn("share_pct", F.coalesce(percent_of(F.col(value), whole, places), F.lit(0.0)))


# --- reviews --------------------------------------------------------------


def _review_rows(mart: DataFrame, month_col: str, year: int, months: Ints, categories: Sequence[str]) -> DataFrame:
    return by_categories(by_date_parts(mart, month_col, [year], months), categories)


def _weighted_score() -> Column:
    points = F.sum(F.col("avg_review_score") * F.col("total_reviews"))
    return F.try_divide(points, F.sum("total_reviews")).cast("decimal(10,2)").cast("double")


def review_filters(review_months: DataFrame) -> DataFrame:
    """Years, months per year and categories of the review mart, in long form."""
    m = F.col("review_month")
    dated = review_months.dropna(subset=["review_month"])
    no_int, no_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    years = dated.select(
        F.lit("year").alias("option"), F.year(m).alias("year"), no_int.alias("month_number"), no_text.alias("label")
    )
    months = dated.select(
        F.lit("month").alias("option"), F.year(m).alias("year"), F.month(m).alias("month_number"), month_name(m).alias("label")
    )
    categories = review_months.dropna(subset=["category"]).select(
        F.lit("category").alias("option"), no_int.alias("year"), no_int.alias("month_number"), F.col("category").alias("label")
    )
    return years.union(months).union(categories).distinct()


def review_summary(review_months: DataFrame, year: int, months: Ints = (), categories: Sequence[str] = ()) -> DataFrame:
    """Label counts and weighted score per category, with the place in each list."""
    grouped = _review_rows(review_months, "review_month", year, months, categories).groupBy("category").agg(
        *[F.sum(c).alias(c) for c in ("positive_reviews", "neutral_reviews", "negative_reviews", "total_reviews")],
        F.coalesce(_weighted_score(), F.lit(0.0)).alias("avg_review_score"),
    )
    name = F.col("category").asc_nulls_last()
    return grouped.withColumns(
        {
            f"{w}_rank": F.row_number().over(Window.orderBy(F.col(f"{w}_reviews").desc(), name))
            for w in ("positive", "neutral", "negative")
        }
    )


def review_cards(review_months: DataFrame, year: int, months: Ints = (), categories: Sequence[str] = ()) -> DataFrame:
    """Totals over the categories; the score weights the rounded category scores."""
    rows = review_summary(review_months, year, months, categories)
    points = F.sum(F.col("avg_review_score") * F.col("total_reviews"))
    zero = F.lit(0)
    return rows.agg(
        F.coalesce(F.sum("total_reviews"), zero).alias("total_reviews"),
        F.coalesce(half_even(F.try_divide(points, F.sum("total_reviews")), 2), F.lit(0.0)).alias("avg_review_score"),
        F.coalesce(F.sum("positive_reviews"), zero).alias("positive_reviews"),
        F.coalesce(F.sum("negative_reviews"), zero).alias("negative_reviews"),
    )


def review_direction(review_months: DataFrame, year: int, categories: Sequence[str] = ()) -> DataFrame:
    m = F.col("review_month")
    rows = _review_rows(review_months, "review_month", year, (), categories)
    return rows.groupBy(F.month(m).alias("month_number"), month_name(m).alias("month_name")).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("positive_reviews", "neutral_reviews", "negative_reviews")]
    )


def _score_cells(combined: DataFrame, year: int, months: Ints, categories: Sequence[str]) -> DataFrame:
    return _review_rows(combined, "sales_month", year, months, categories).groupBy("sales_month", "category").agg(
        F.sum(F.col("total_sales").cast("decimal(28,4)")).alias("total_sales"),
        F.sum("total_transactions").alias("total_transactions"),
        F.sum("total_reviews").alias("total_reviews"),
        F.coalesce(_weighted_score(), F.lit(0.0)).alias("avg_review_score"),
        F.coalesce(F.avg("avg_sentiment_score"), F.lit(0.0)).alias("avg_sentiment_score"),
    )


def score_cards(combined: DataFrame, year: int, months: Ints = (), categories: Sequence[str] = ()) -> DataFrame:
    """Totals of the chosen months; the score weights the month x category scores."""
    points = F.sum(F.col("avg_review_score") * F.col("total_reviews"))
    return _score_cells(combined, year, months, categories).agg(
        F.coalesce(money2(F.sum("total_sales")), F.lit(0.0)).alias("total_sales"),
        F.coalesce(F.sum("total_transactions"), F.lit(0)).alias("total_transactions"),
        F.coalesce(F.sum("total_reviews"), F.lit(0)).alias("total_reviews"),
        F.coalesce(half_even(F.try_divide(points, F.sum("total_reviews")), 2), F.lit(0.0)).alias("avg_review_score"),
        F.coalesce(half_even(mean_of_rounded("avg_sentiment_score", 6), 2), F.lit(0.0)).alias("avg_sentiment_score"),
    )


def score_chart(
    combined: DataFrame, by: str, score: str, year: int, months: Ints = (), categories: Sequence[str] = ()
) -> DataFrame:
    """Sales and the plain mean of ``score`` per month or per category."""
    cells = _score_cells(combined, year, months, categories)
    return cells.groupBy(by).agg(
        money(F.sum("total_sales")).alias("total_sales"), half_even(mean_of_rounded(score, 6), 2).alias(score)
    )


def review_topics(topic_months: DataFrame, year: int, months: Ints = (), categories: Sequence[str] = ()) -> DataFrame:
    """Reviews and plain mean sentiment per topic."""
    return _review_rows(topic_months, "review_month", year, months, categories).groupBy("topic").agg(
        F.sum("topic_review_count").alias("topic_review_count"),
        half_even(mean_of_rounded("avg_topic_sentiment_score", 6), 2).alias("avg_topic_sentiment_score"),
    )


def topic_sentiment_mean(topic_rows: DataFrame) -> DataFrame:
    """Plain mean over the topics of the topic table, 0 without topics."""
    return topic_rows.agg(
        F.count("*").alias("topics"),
        F.coalesce(half_even(mean_of_rounded("avg_topic_sentiment_score", 6), 2), F.lit(0.0)).alias("mean_sentiment"),
    )


# --- forecasts ------------------------------------------------------------


def latest_year(df: DataFrame, month_col: str = "sales_month") -> Column:
    return df.agg(F.max(F.year(month_col))).scalar()


def forecast_filters(sales_forecast: DataFrame, transaction_forecast: DataFrame) -> DataFrame:
    """Latest forecast year over both tables, its months and its categories."""
    both = (
        sales_forecast.select("category", "sales_month")
        .union(transaction_forecast.select("category", "sales_month"))
        .distinct()
    )
    m = F.col("sales_month")
    last = both.filter(F.year(m) == latest_year(both))
    year = last.select(F.lit("year").alias("option"), F.year(m).alias("value"), F.year(m).cast("string").alias("label"))
    months = last.select(F.lit("month").alias("option"), F.month(m).alias("value"), month_name(m).alias("label"))
    categories = last.dropna(subset=["category"]).select(
        F.lit("category").alias("option"), F.lit(None).cast("int").alias("value"), F.col("category").alias("label")
    )
    return year.union(months).union(categories).distinct()


def _latest_rows(forecast: DataFrame, months: Ints, categories: Sequence[str]) -> DataFrame:
    m = F.col("sales_month")
    rows = forecast.filter(F.year(m) == latest_year(forecast))
    if months:
        rows = rows.filter(F.month(m).isin(list(months)))
    return by_categories(rows, categories)


def forecast_sales_series(forecast: DataFrame, months: Ints = (), categories: Sequence[str] = ()) -> DataFrame:
    """Month rows, category rows and the total of the latest forecast year."""
    rows = _latest_rows(forecast, months, categories).withColumn("sales", F.col("sales").cast("decimal(28,4)"))
    by_month = rows.groupBy("sales_month").agg(F.sum("sales").alias("sales"))
    monthly = by_month.select(F.lit("month").alias("series"), month_name("sales_month").alias("label"), money2("sales").alias("sales"))
    pie = rows.groupBy("category").agg(F.sum("sales").alias("sales")).select(
        F.lit("category").alias("series"), F.col("category").alias("label"), money2("sales").alias("sales")
    )
    total = by_month.agg(F.sum("sales").alias("sales")).select(
        F.lit("total").alias("series"), F.lit("total").alias("label"), F.coalesce(money2("sales"), F.lit(0.0)).alias("sales")
    )
    return monthly.union(pie).union(total)


def forecast_category_series(forecast: DataFrame, months: Ints = (), categories: Sequence[str] = ()) -> DataFrame:
    grouped = _latest_rows(forecast, months, categories).groupBy("category").agg(
        F.sum(F.col("forecast_transactions").cast("decimal(28,4)")).alias("n")
    )
    return grouped.select("category", money2("n").alias("forecast_transactions"))
