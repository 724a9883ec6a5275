"""Forecast features, models and allocation against plain numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillworks.operators import forecast


def months(n, start=(2018, 1)):
    y, m = start
    return [dt.date(y + (m - 1 + i) // 12, (m - 1 + i) % 12 + 1, 1) for i in range(n)]


def series(n, seed=1):
    rng = np.random.default_rng(seed)
    return [float(round(1000 + 20 * i + 100 * np.sin(i / 2) + rng.normal(0, 10), 2)) for i in range(n)]


def frame(spark, groups):
    rows = [(k, m, v) for k, values in groups.items() for m, v in zip(months(len(values)), values)]
    return spark.createDataFrame(rows, "series string, sales_month date, total_sales double")


@pytest.mark.parametrize("rows, means", [(2, {}), (3, {}), (4, {4: 2.0})])
def test_rolling_mean_needs_a_full_frame(spark, rows, means):
    df = frame(spark, {"a": [1.0, 2.0, 3.0, 4.0][:rows]})
    got = forecast.lag_features(df, "total_sales", ["series"], lags=(1,), means=(3,)).collect()
    assert {r.sales_month.month: r.rolling_mean3 for r in got} == means


def test_lags_count_rows_not_months(spark):
    rows = [("a", dt.date(2020, m, 1), float(m)) for m in (1, 2, 4, 5)]
    df = spark.createDataFrame(rows, "series string, sales_month date, total_sales double")
    got = forecast.lag_features(df, "total_sales", ["series"], lags=(1,), means=()).collect()
    assert {r.sales_month.month: r.lag1 for r in got} == {2: 1.0, 4: 2.0, 5: 4.0}


def test_split_falls_back_to_position(spark):
    df = frame(spark, {"two": [1.0] * 14, "one": [1.0] * 10}).withColumn("year", F.year("sales_month"))
    got = forecast.with_split(df, ["series"]).groupBy("series", "split").count().collect()
    assert {(r.series, r.split): r["count"] for r in got} == {("two", "train"): 12, ("two", "test"): 2, ("one", "train"): 8, ("one", "test"): 2}


def brute(values):
    """The recursive least-squares forecast, written out for one series."""
    dates = months(len(values))
    rows = [[dates[i].year, dates[i].month, *[values[i - k] for k in (1, 3, 6, 12)], np.mean(values[i - 3 : i]), np.mean(values[i - 6 : i])] for i in range(12, len(values))]
    x, y = np.array(rows), np.array(values[12:])
    train = x[:, 0] < x[:, 0].max()
    a = np.c_[np.ones(train.sum()), x[train]]
    weights = np.linalg.lstsq(a - np.r_[0, x[train].mean(axis=0)], y[train], rcond=None)[0]
    shift = x[train].mean(axis=0)
    history, when = list(values), list(months(len(values) + 12))
    for i in range(len(values), len(values) + 12):
        row = np.array([when[i].year, when[i].month, *[history[-k] for k in (1, 3, 6, 12)], np.mean(history[-3:]), np.mean(history[-6:])])
        history.append(max(0.0, float(weights[0] + (row - shift) @ weights[1:])))
    return history[-12:]


def test_recursive_linear_forecast(spark):
    data = {"a": series(60), "b": series(48, seed=5)}
    scored = forecast.forecast_sales(frame(spark, data), ["series"])
    rows = forecast.only_forecast(scored, "p", ["series"]).orderBy("series", "sales_month").collect()
    for name, values in data.items():
        got = [r.p for r in rows if r.series == name]
        assert got == pytest.approx(brute(values), rel=1e-6)
    assert scored.filter("kind = 'test'").count() == 12 + 12


def test_short_series_are_skipped(spark):
    data = {"short": series(13), "long": series(40)}
    df = frame(spark, data).withColumnRenamed("total_sales", "transactions")
    scored = forecast.forecast_transactions(df, ["series"], trees=20)
    assert {r.series for r in scored.select("series").distinct().collect()} == {"long"}


def test_boosted_forecast_is_repeatable_and_not_negative(spark):
    df = frame(spark, {"a": series(40), "b": [max(0.0, 50.0 - 2 * i) for i in range(40)]}).withColumnRenamed("total_sales", "transactions")
    first = sorted(map(tuple, forecast.forecast_transactions(df, ["series"], trees=30).collect()), key=str)
    again = sorted(map(tuple, forecast.forecast_transactions(df.repartition(5), ["series"], trees=30).collect()), key=str)
    assert first == again and all(r[-1] >= 0 for r in first)
    assert sum(r[2] == "forecast" for r in first) == 24


def test_boosted_model_learns_a_step_of_each_series(spark):
    rows = [(name, m, 2020, 1, 0.0, 0.0, 0.0, 1.0 if (i < 20) == (name == "a") else 5.0) for name in "ab" for i, m in enumerate(months(40))]
    df = spark.createDataFrame(rows, "series string, sales_month date, year int, month int, lag1 double, lag3 double, rolling_mean3 double, transactions double")
    stepped = df.withColumn("lag1", F.months_between("sales_month", F.lit("2000-01-01")))
    model = forecast.boosted_model(stepped, ["series"], "transactions", 40, 3, 0.2, 0.9, 1)
    scored = model.transform(stepped.withColumn("series_key", F.col("series"))).select("transactions", "prediction").collect()
    assert max(abs(r.transactions - r.prediction) for r in scored) < 0.5


def test_no_series_long_enough_gives_no_rows(spark):
    df = frame(spark, {"short": series(9)}).withColumnRenamed("total_sales", "transactions")
    scored = forecast.forecast_transactions(df, ["series"])
    assert scored.columns == ["series", "sales_month", "kind", "actual", "predicted"] and scored.collect() == []


def test_error_metrics(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 4.0, 3.0), ("z", 0.0, 1.0), ("z", 2.0, 1.0), ("s", 3.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, actual double, predicted double")
    got = {r.k: r for r in forecast.error_metrics(df, ["k"]).collect()}
    assert got["a"].mae == pytest.approx(2 / 3) and got["a"].mse == pytest.approx(2 / 3)
    assert got["a"].r2 == pytest.approx(1 - 2 / np.sum((np.array([1, 2, 4]) - 7 / 3) ** 2))
    assert got["a"].mape == pytest.approx((1 + 0 + 0.25) / 3 * 100)
    assert got["z"].mape is None and got["s"].r2 is None


def test_allocation_adds_up(spark):
    totals = spark.createDataFrame([(dt.date(2021, 1, 1), 100.0), (dt.date(2021, 2, 1), 0.05)], "sales_month date, predicted double")
    shares = spark.createDataFrame([(c, 1 / 3) for c in "abc"], "category string, share double")
    rows = forecast.allocate(totals, shares).collect()
    january = {r.category: str(r.sales) for r in rows if r.sales_month.month == 1}
    assert january == {"a": "33.33", "b": "33.33", "c": "33.34"}
    assert sum(r.sales for r in rows if r.sales_month.month == 2) == forecast_decimal("0.05")


def forecast_decimal(value):
    from decimal import Decimal

    return Decimal(value)


def test_shares_of_recent_months(spark):
    rows = [("a", m, 10.0) for m in months(12)] + [("b", m, 30.0) for m in months(12)[6:]]
    df = spark.createDataFrame(rows, "category string, sales_month date, total_sales double")
    assert {r.category: r.share for r in forecast.recent_shares(df).collect()} == {"a": 0.25, "b": 0.75}
    nothing = df.withColumn("total_sales", F.lit(0.0))
    assert forecast.recent_shares(nothing).count() == 0


def test_recursive_forecast_of_the_given_tables_adds_up(spark, sf_dir):
    import __spark_entry__ as entry

    rows = entry.queries()["forecast_sales_recursive"](spark, sf_dir).collect()
    assert len({r.sales_month for r in rows}) == 12 and all(r.sales is not None for r in rows)
