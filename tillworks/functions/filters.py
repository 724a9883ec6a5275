"""Optional filters of the dashboards and reports."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.functions.scalars import category_key

ALL_CATEGORIES = "All Categories"


def date_span(years: Sequence[int], months: Sequence[int] = ()) -> tuple[dt.date, dt.date]:
    """Smallest date range that holds every (year, month) of the selection."""
    first_month, last_month = (min(months), max(months)) if months else (1, 12)
    first = dt.date(min(years), first_month, 1)
    last_day = calendar.monthrange(max(years), last_month)[1]
    return first, dt.date(max(years), last_month, last_day)


def by_date_parts(
    df: DataFrame,
    date_col: str,
    years: Sequence[int] = (),
    months: Sequence[int] = (),
    days: Sequence[int] = (),
) -> DataFrame:
    """Keep rows whose year, month and day are in the lists; an empty list keeps all.

    year(d) IN (...) cannot prune row groups, so the enclosing date range is
    added next to it: that one reaches the parquet scan.
    """
    d = F.col(date_col)
    if years:
        first, last = date_span(years, months)
        df = df.filter(d.between(F.lit(first), F.lit(last)))
        if len(years) > 1 or months:
            df = df.filter(F.year(d).isin(list(years)))
    if months:
        df = df.filter(F.month(d).isin(list(months)))
    if days:
        df = df.filter(F.dayofmonth(d).isin(list(days)))
    return df


def by_two_months(
    df: DataFrame, date_col: str, first: tuple[int, int], second: tuple[int, int]
) -> DataFrame:
    """Rows of either of two (year, month) periods, as two pushable date ranges."""
    keep = F.lit(False)
    for year, month in (first, second):
        start, end = date_span([year], [month])
        keep = keep | F.col(date_col).between(F.lit(start), F.lit(end))
    return df.filter(keep)


def by_categories(df: DataFrame, categories: Sequence[str] = (), column: str = "category") -> DataFrame:
    return df.filter(F.col(column).isin(list(categories))) if categories else df


def by_category_key(
    df: DataFrame, category: str | None = ALL_CATEGORIES, column: str = "category_key"
) -> DataFrame:
    """Equality on the standardised spelling, so "A & B" finds "a and b" and back."""
    if not category or category == ALL_CATEGORIES:
        return df
    return df.filter(F.col(column) == category_key(F.lit(category)))


def with_support(df: DataFrame, minimum: int, column: str = "total_reviews") -> DataFrame:
    return df.filter(F.col(column) >= minimum)
