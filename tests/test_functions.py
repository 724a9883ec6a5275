"""Traps and edge cases on literal frames."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillworks.functions import filters, lookups, scalars, stats
from tillworks.operators import cleaning, dimensions, marts, ratings, reviews, segments
from tillworks.plans import dashboards, report
from tillworks.session import broadcast_if_bounded, fresh_path


def one(df):
    return df.collect()[0]


def day(text):
    return dt.date.fromisoformat(text) if text else None


def test_keys_keep_null(spark):
    df = spark.createDataFrame([("Ann B.", "New-York"), ("Ann", None)], "n string, c string")
    keys = [r[0] for r in df.select(scalars.compact_key("n", "c")).collect()]
    assert keys == ["AnnBNewYork", None]


@pytest.mark.parametrize(
    "raw, key",
    [(" Eggs,  Meat & Fish ", "eggs meat and fish"), ("Bakery", "bakery"), (None, None), ("A&B", "aandb")],
)
def test_category_key(spark, raw, key):
    df = spark.createDataFrame([(raw,)], "c string")
    assert one(df.select(scalars.category_key("c")))[0] == key


def test_bad_values_become_null(spark):
    df = spark.createDataFrame([("2020-13-01", "1,5", "x"), ("2020-02-29", "1.55", "3")], "d string, m string, i string")
    rows = df.select(scalars.to_date_or_null("d"), scalars.to_money_or_null("m"), scalars.to_int_or_null("i")).collect()
    assert tuple(rows[0]) == (None, None, None)
    assert rows[1][0] == dt.date(2020, 2, 29) and str(rows[1][1]) == "1.55" and rows[1][2] == 3


def test_epoch_origin(spark):
    df = spark.createDataFrame([(0,), (86399,), (86400,), (-1,)], "s bigint")
    got = [tuple(r) for r in df.select(scalars.epoch_to_date("s"), scalars.epoch_to_date("s", "1977-01-01")).collect()]
    assert got[0] == (dt.date(1970, 1, 1), dt.date(1977, 1, 1))
    assert got[1] == got[0] and got[2][0] == dt.date(1970, 1, 2) and got[3][0] == dt.date(1969, 12, 31)


def test_year_and_category_filters_keep_null(spark):
    df = spark.createDataFrame(
        [(day(d), c) for d, c in ((None, "a"), ("2014-01-01", "a"), ("2015-05-05", "beauty"), ("2018-12-31", None), ("2019-01-01", "a"))],
        "review_date date, category string",
    )
    years = cleaning.within_years(df, lookups.REVIEW_YEARS)
    assert years.count() == 3
    assert cleaning.without_categories(years, lookups.EXCLUDED_REVIEW_CATEGORIES).count() == 2


def test_leap_day_is_clamped(spark):
    df = spark.createDataFrame([(day("2016-02-29"),), (day("2014-02-03"),), (None,)], "review_date date")
    got = [r[0] for r in cleaning.rebase_reviews(df).collect()]
    assert got == [dt.date(2018, 2, 28), dt.date(2014, 2, 3), None]


def test_matched_reviews(spark):
    rows = [
        ("grocerygourmetfood", "breads bakery", "tortillas", day("2016-02-29")),
        ("grocerygourmetfood", "dairy eggs", "eggs", day("2018-03-01")),
        ("grocerygourmetfood", "mystery", "tea", None),
        ("grocerygourmetfood", "beverages", "soup", day("2018-03-01")),
        ("petsupplies", "beverages", "tea", day("2018-03-01")),
    ]
    df = spark.createDataFrame(rows, "category string, subcategory string, product_type string, review_date date")
    got = sorted((r.category, r.subcategory) for r in cleaning.matched_reviews(df).collect())
    assert got == [("Bakery", "tortillas"), ("Eggs, Meat & Fish", "eggs"), ("mystery", "tea")]


def test_growth_skips_gaps_and_zero_bases(spark):
    rows = [("2020-01-05", "10.00", "0"), ("2020-02-05", "0.00", "5"), ("2020-04-05", "8.00", "10"), ("2020-05-05", "12.00", None)]
    df = spark.createDataFrame([(day(d), s, p) for d, s, p in rows], "order_date date, sales string, profit string")
    df = df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("sales", "profit")})
    got = {r.sales_month.month: (r.sales_growth, r.profit_growth) for r in marts.sales_growth(df).collect()}
    assert got == {1: (None, None), 2: (-1.0, None), 4: (None, 1.0), 5: (0.5, None)}


def test_correlation_edges(spark):
    rows = [("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("single", 1.0, 1.0), ("gap", 1.0, None), ("gap", 2.0, 5.0), ("gap", 3.0, 9.0), ("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", 3.0, 6.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r.k: r.r for r in df.groupBy("k").agg(stats.pearson("x", "y").alias("r")).collect()}
    assert got == {"flat": None, "single": None, "gap": 1.0, "line": 1.0}


def test_rounding_is_half_even(spark):
    values = [0.125, 0.375, 2.5, -0.125, 1.005, 33.335]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(scalars.half_even("x", 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in values]


def test_trend_and_sentiment_labels(spark):
    df = spark.createDataFrame([(v,) for v in (None, 5.0, 0.1, 0.0, -0.1, -5.0)], "p double")
    assert [r[0] for r in df.select(scalars.trend_label("p")).collect()] == [
        "N/A", "Upward", "Slight Upward", "Flat", "Slight Decline", "Declining",
    ]
    df = spark.createDataFrame([(v,) for v in (0.05, 0.0501, -0.05, -0.06)], "s double")
    assert [r[0] for r in df.select(scalars.sentiment_label("s")).collect()] == ["Neutral", "Positive", "Neutral", "Negative"]


def test_segments(spark):
    rows = [
        ("a", 10.0, 0.5), ("b", 20.0, 0.5), ("c", 30.0, 0.1), ("d", 5.0, 0.9), ("e", 1.0, 0.2), ("f", None, 0.3), ("g", 3.0, None),
    ]
    df = spark.createDataFrame([(day("2020-01-01"), *r) for r in rows], "sales_month date, category string, total_sales double, avg_sentiment_score double")
    got = {r.category: r.segment for r in segments.with_segments(df).collect()}
    # median sales 7.5, median sentiment 0.4
    assert got == {"a": "Strong Performer", "b": "Strong Performer", "c": "Risk", "d": "Opportunity", "e": "Weak", "f": "Insufficient Data", "g": "Insufficient Data"}


def test_equal_to_both_medians_is_strong(spark):
    df = spark.createDataFrame([(day("2020-01-01"), "a", 1.0, 0.1)], "sales_month date, category string, total_sales double, avg_sentiment_score double")
    assert one(segments.with_segments(df)).segment == "Strong Performer"


def test_combined_matches_null_category(spark):
    sales = spark.createDataFrame([(day("2020-01-01"), None, 5.0, 1), (day("2020-01-01"), "a", 5.0, 1)], "sales_month date, category string, total_sales double, total_transactions bigint")
    rated = spark.createDataFrame([(day("2020-01-01"), None, 3), (day("2020-02-01"), "a", 4)], "review_month date, category string, total_reviews bigint")
    got = reviews.combine_sales_and_reviews(sales, rated).collect()
    assert len(got) == 1 and got[0].category is None and got[0].total_reviews == 3


def test_ready_to_save(spark):
    df = spark.createDataFrame([(None, float("nan"), float("inf")), (2, 1.0, -0.5)], "total_reviews bigint, total_sales double, avg_sentiment_score double")
    assert [tuple(r) for r in reviews.ready_to_save(df).collect()] == [(0, None, None), (2, 1.0, -0.5)]


def test_forecast_change_without_base(spark):
    df = spark.createDataFrame([("a", "0", "0"), ("b", "0", "7"), ("c", "10", "15")], "category_key string, current string, forecast string")
    df = df.withColumns({c: F.col(c).cast("decimal(28,4)") for c in ("current", "forecast")})
    got = {r.category_key: (r.change_pct, r.trend) for r in report._compared(df, 2).collect()}
    assert got == {"a": (0.0, "Flat"), "b": (100.0, "Upward"), "c": (50.0, "Upward")}


def test_slowest_growing_when_nothing_declines(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 1.0), ("c", 3.0, None)], "category string, sales double, sales_growth_pct double")
    lists = {}
    for r in report.top_lists(df).collect():
        lists.setdefault(r["list"], []).append((r.place, r.category))
    assert sorted(lists["slowest_growing"]) == [(1, "b"), (2, "a")] and "most_declining" not in lists


def test_standings_match_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([5.0, 5.0, 5.0, 1.0, 2.5, 4.75]), rng.randint(1, 6)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, score double, n int")
    keys = {"up": [("score", False), ("n", True)], "down": [("score", True), ("n", True)], "most": [("n", True)]}
    got = stats.standings(df, keys, fresh_path(spark, "figures"), slices=4).collect()
    assert len(got) == 400
    for r in got:
        assert r.up == 1 + sum((s, -n) < (r.score, -r.n) for _, s, n in rows)
        assert r.down == 1 + sum((-s, -n) < (-r.score, -r.n) for _, s, n in rows)
        assert r.most == 1 + sum(n > r.n for _, _, n in rows)


def test_standings_of_equal_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, score double")
    got = stats.standings(df, {"r": [("score", True)]}, fresh_path(spark, "figures")).collect()
    assert [r.r for r in got] == [1, 1]


def test_date_filter_reaches_the_scan(spark, sf_dir, capsys):
    from tillworks.sources.star_views import sales_lines

    lines = filters.by_date_parts(sales_lines(spark, sf_dir, "order_date", "sales"), "order_date", [1998], [2, 3])
    lines.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan" in plan


def test_empty_filter_keeps_all(spark):
    df = spark.createDataFrame([(day("2020-01-05"),), (None,)], "order_date date")
    assert filters.by_date_parts(df, "order_date").count() == 2
    assert filters.by_date_parts(df, "order_date", days=[5]).count() == 1
    assert filters.by_date_parts(df, "order_date", [2019, 2020], [1]).count() == 1


def test_category_choice_uses_the_standard_spelling(spark):
    df = spark.createDataFrame([("eggs meat and fish",), ("bakery",)], "category_key string")
    assert filters.by_category_key(df, "Eggs, Meat & Fish").count() == 1
    assert filters.by_category_key(df, "All Categories").count() == 2
    assert report.known_category("nowhere", df, "category_key") == "All Categories"


def test_month_comparison_needs_months(spark):
    with pytest.raises(ValueError):
        dashboards.compare_months(spark.range(1), (1998, None), (1998, 3))


def test_first_visit_takes_the_earliest_dated_order(spark):
    rows = [("k", "N", "C", None), ("k", "N", "C", day("2020-05-09")), ("k", "N", "C", day("2020-03-09")), ("u", "U", "C", None)]
    df = spark.createDataFrame(rows, "customer_id string, customer_name string, city string, order_date date")
    got = {r.customer_id: r.first_month for r in dimensions.customer_dimension(df).collect()}
    assert got == {"k": dt.date(2020, 3, 1), "u": None}


def test_kpis_of_empty_inputs_are_zero(spark):
    by_category = spark.createDataFrame([], "category string, total_reviews bigint, avg_review_score double, positive_reviews bigint, neutral_reviews bigint, negative_reviews bigint")
    both = spark.createDataFrame([], "category string, total_sales double, total_transactions bigint")
    assert set(one(ratings.review_kpis(by_category, both))) == {0}


def test_broadcast_only_when_counted_small(spark):
    assert broadcast_if_bounded(spark.range(10), 10)[1] is True
    assert broadcast_if_bounded(spark.range(11), 10)[1] is False


def test_standings_keep_rows_without_a_figure(spark):
    df = spark.createDataFrame([(1, 2.0, 1), (2, None, 5), (3, 3.0, None), (4, None, 5)], "id int, score double, n int")
    keys = {"best": [("score", True), ("n", True)], "worst": [("score", False), ("n", False)]}
    got = {r.id: (r.best, r.worst) for r in stats.standings(df, keys, fresh_path(spark, "figures")).collect()}
    assert got == {1: (2, 1), 2: (3, 3), 3: (1, 2), 4: (3, 3)}


def test_dates_and_numbers_in_several_forms(spark):
    texts = ["2017-08-11", "08/11/2017", "08-11-2017", "2017/08/11", "11.08.2017", "2017-08-11 10:00:00", " 2017-08-11 ", "8th", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(scalars.to_date_or_null("t")).collect()]
    assert got == [day("2017-08-11")] * 7 + [None] * 3
    numbers = spark.createDataFrame([(t,) for t in ["5", "5.0", " 4 ", "x", None, "1182729600.0"]], "t string")
    assert [r[0] for r in numbers.select(scalars.to_int_or_null("t")).collect()] == [5, 5, 4, None, None, 1182729600]
    assert numbers.select(scalars.to_bigint_or_null("t")).collect()[5][0] == 1182729600
