"""Month x category segments, ratios and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.functions import lookups
from tillworks.functions.scalars import safe_ratio, season, year_month


def with_time_columns(df: DataFrame, month: str = "sales_month") -> DataFrame:
    m = F.col(month)
    return df.withColumns(
        {
            "year": F.year(m),
            "month_number": F.month(m),
            "month_name": F.date_format(m, "MMM"),
            "year_month": year_month(m),
            "season": season(F.month(m)),
        }
    )


def segment_of(sales: Column, mood: Column, sales_bar: Column, mood_bar: Column) -> Column:
    sells, pleases = sales >= sales_bar, mood >= mood_bar
    return (
        F.when(sales.isNull() | mood.isNull(), lookups.NOT_ENOUGH)
        .when(sells & pleases, lookups.STRONG)
        .when(sells & (mood < mood_bar), lookups.RISK)
        .when((sales < sales_bar) & pleases, lookups.OPPORTUNITY)
        .otherwise(lookups.WEAK)
    )


def with_segments(df: DataFrame) -> DataFrame:
    """Compare each category with the medians of its month.

    A month holds one row per category, so the exact median window is small.
    Rows without a month take no part.
    """
    month = Window.partitionBy("sales_month")
    barred = df.dropna(subset=["sales_month"]).withColumns(
        {
            "sales_threshold": F.median("total_sales").over(month),
            "sentiment_threshold": F.median("avg_sentiment_score").over(month),
        }
    )
    return barred.withColumn(
        "segment",
        segment_of(
            F.col("total_sales"),
            F.col("avg_sentiment_score"),
            F.col("sales_threshold"),
            F.col("sentiment_threshold"),
        ),
    )


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "positive_review_ratio": safe_ratio("positive_reviews", "total_reviews"),
            "negative_review_ratio": safe_ratio("negative_reviews", "total_reviews"),
            "neutral_review_ratio": safe_ratio("neutral_reviews", "total_reviews"),
            "sales_per_transaction": safe_ratio("total_sales", "total_transactions"),
            "sales_per_review": safe_ratio("total_sales", "total_reviews"),
        }
    )


def _filled(template: str) -> Column:
    text = F.col(template)
    for mark, column in (("{month}", "year_month"), ("{category}", "category"), ("{season}", "season")):
        text = F.replace(text, F.lit(mark), F.coalesce(column, F.lit("unknown")))
    return text


def with_advice(df: DataFrame) -> DataFrame:
    """Insight and recommendation sentences from the five-row template table."""
    templates = lookups.segment_text_frame(df.sparkSession)
    return (
        df.join(F.broadcast(templates), "segment")
        .withColumns({"insight": _filled("insight"), "recommendation": _filled("recommendation")})
    )


def segment_mart(combined: DataFrame) -> DataFrame:
    return with_advice(with_ratios(with_segments(with_time_columns(combined))))
