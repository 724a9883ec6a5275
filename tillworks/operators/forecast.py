"""Monthly forecasts: features, split, models, error figures, allocation.

Inputs are month-level aggregates, so one series is at most a few hundred rows
however large the fact is. Work is spread over series, never gathered.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.functions.scalars import half_even, month_start
from tillworks.session import fresh_path

# Tasks get this module's functions with the task; executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HORIZON = 12
SHARE_MONTHS = 6
MIN_ROWS = 12
SALES_LAGS, SALES_MEANS = (1, 3, 6, 12), (3, 6)
COUNT_LAGS, COUNT_MEANS = (1, 3), (3,)
MOST_CATEGORIES = 1_000
# A tree is grown by several passes; a part of fewer rows costs more to start than to read.
ROWS_A_PART = 10_000


# --- monthly inputs -------------------------------------------------------


def monthly_sales(sales: DataFrame, *series: str) -> DataFrame:
    """Total sales per month (and series); undated lines are left out."""
    dated = sales.dropna(subset=["order_date", *series])
    return dated.groupBy(*series, month_start("order_date").alias("sales_month")).agg(
        F.sum("sales").alias("total_sales")
    )


def monthly_orders(sales: DataFrame, *series: str) -> DataFrame:
    """Distinct orders per month and series. Orders are made distinct on the map
    side first, so a hot series is spread by order before it is counted."""
    dated = sales.dropna(subset=["order_date", *series])
    return dated.groupBy(*series, month_start("order_date").alias("sales_month")).agg(
        F.count_distinct("order_id").alias("transactions")
    )


# --- features and split ---------------------------------------------------


def lag_features(
    monthly: DataFrame,
    value: str,
    series: Sequence[str] = (),
    lags: Sequence[int] = SALES_LAGS,
    means: Sequence[int] = SALES_MEANS,
) -> DataFrame:
    """Year, month, lags by row position and trailing means; incomplete rows dropped.

    A missing month shifts the lags: they count rows, not calendar months. A
    trailing mean exists only once its frame is full.
    """
    order = Window.partitionBy(*series).orderBy("sales_month")
    columns: dict[str, Column] = {
        "year": F.year("sales_month"),
        "month": F.month("sales_month"),
    }
    for k in lags:
        columns[f"lag{k}"] = F.lag(value, k).over(order)
    for n in means:
        frame = order.rowsBetween(-n, -1)
        mean = F.sum(value).over(frame).cast("double") / F.lit(float(n))
        columns[f"rolling_mean{n}"] = F.when(F.count(value).over(frame) == n, mean)
    return monthly.withColumns(columns).dropna(subset=[value, *columns])


def with_split(features: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Label rows train or test: the latest year is the test.

    When every row is of one year, the first 80 % by position train.
    """
    whole = Window.partitionBy(*series)
    order = whole.orderBy("sales_month")
    latest = F.max("year").over(whole)
    earlier = F.count_if(F.col("year") < F.col("latest_year")).over(whole)
    cut = F.floor(F.count("*").over(whole) * F.lit(0.8))
    labelled = features.withColumn("latest_year", latest).withColumns(
        {"_earlier": earlier, "_cut": cut, "_place": F.row_number().over(order)}
    )
    train = F.when(F.col("_earlier") > 0, F.col("year") < F.col("latest_year")).otherwise(
        F.col("_place") <= F.col("_cut")
    )
    return labelled.withColumn("split", F.when(train, "train").otherwise("test")).drop(
        "latest_year", "_earlier", "_cut", "_place"
    )


def error_metrics(
    scored: DataFrame, keys: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """MAE, MSE, R2 and MAPE per key. R2 needs two rows; MAPE needs no zero actual."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    squares = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * F.count(y)
    fit = F.when(spread == 0, F.when(squares == 0, 1.0).otherwise(0.0)).otherwise(
        1.0 - F.try_divide(squares, spread)
    )
    return scored.groupBy(*keys).agg(
        F.count(y).alias("n_rows"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.when(F.count(y) > 1, fit).alias("r2"),
        F.when(
            F.count_if(y == 0) == 0, F.avg(F.abs(F.try_divide(y - p, y))) * 100.0
        ).alias("mape"),
    )


# --- allocation to categories ---------------------------------------------


def recent_shares(category_months: DataFrame, months: int = SHARE_MONTHS) -> DataFrame:
    """Each category's share of the last months' sales.

    No share is defined when those months sold nothing.
    """
    usable = category_months.dropna(subset=["category", "sales_month", "total_sales"])
    latest = usable.agg(F.max("sales_month")).scalar()
    recent = (
        usable.filter(F.col("sales_month") >= F.add_months(latest, 1 - months))
        .groupBy("category")
        .agg(F.sum("total_sales").alias("recent_sales"))
    )
    # One row per category remains, so the unpartitioned window is small.
    whole = F.sum("recent_sales").over(Window.partitionBy())
    return recent.withColumn("_whole", whole).filter("_whole > 0").select(
        "category",
        F.col("recent_sales").cast("double").alias("recent_sales"),
        (F.col("recent_sales").cast("double") / F.col("_whole").cast("double")).alias("share"),
    )


def allocate(month_totals: DataFrame, shares: DataFrame, total: str = "predicted") -> DataFrame:
    """Split every month total by share so that the cents add up exactly.

    The month totals (at most one horizon of rows) travel as one array that each
    share row unfolds. Cents lost to rounding go to the last category by name.
    """
    months = month_totals.agg(
        F.collect_list(F.struct("sales_month", F.col(total).cast("double").alias("total")))
    ).scalar()
    rows = shares.select("category", "share", F.inline(months)).select(
        "category",
        "sales_month",
        F.round(F.col("total"), 2).cast("decimal(18,2)").alias("target"),
        F.round(F.col("total") * F.col("share"), 2).cast("decimal(18,2)").alias("sales"),
    )
    month = Window.partitionBy("sales_month")
    is_last = F.row_number().over(month.orderBy(F.col("category").desc())) == 1
    residual = F.col("target") - F.sum("sales").over(month)
    return rows.select(
        "category",
        "sales_month",
        (F.col("sales") + F.when(is_last, residual).otherwise(0)).cast("decimal(18,2)").alias("sales"),
    )


# --- models ---------------------------------------------------------------


def _feature_row(history: list[float], month: pd.Timestamp, lags, means) -> list[float]:
    row = [month.year, month.month]
    row += [history[-k] if len(history) >= k else history[-1] for k in lags]
    row += [np.mean(history[-n:]) if len(history) >= n else np.mean(history) for n in means]
    return row


def _training_rows(values: np.ndarray, months: list[pd.Timestamp], lags, means):
    """Complete feature rows of a series with the positions they belong to."""
    start = max([*lags, *means])
    places = list(range(start, len(values)))
    rows = [
        [months[i].year, months[i].month]
        + [values[i - k] for k in lags]
        + [values[i - n : i].mean() for n in means]
        for i in places
    ]
    return np.array(rows, dtype=float).reshape(len(places), 2 + len(lags) + len(means)), places


def _train_mask(years: np.ndarray) -> np.ndarray:
    mask = years < years.max()
    return mask if mask.any() else np.arange(len(years)) < int(len(years) * 0.8)


def _least_squares(x: np.ndarray, y: np.ndarray):
    """Ordinary least squares with an intercept, on centred columns."""
    mean_x, mean_y = x.mean(axis=0), y.mean()
    weights = np.linalg.lstsq(x - mean_x, y - mean_y, rcond=None)[0]
    return lambda rows: (rows - mean_x) @ weights + mean_y


def _forecast(monthly: DataFrame, series: Sequence[str], value: str, fit, lags, means, horizon, refit, min_rows):
    """Fit each series on its own and roll the model forward month by month.

    Returns the test rows with their prediction and the forecast rows. A group
    is one series of monthly totals; a series too short to fit gives no rows.
    """
    kinds = dict(monthly.dtypes)
    schema = ", ".join(
        [f"{k} {kinds[k]}" for k in series]
        + ["sales_month date", "kind string", "actual double", "predicted double"]
    )

    def one_series(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sales_month")
        values = pdf[value].to_numpy(dtype=float)
        months = [pd.Timestamp(m) for m in pdf["sales_month"]]
        x, places = _training_rows(values, months, lags, means)
        columns = [*series, "sales_month", "kind", "actual", "predicted"]
        empty = pd.DataFrame(columns=columns)
        if len(x) < max(min_rows, 2):
            return empty
        train = _train_mask(x[:, 0])
        if not train.any() or train.all():
            return empty
        y = values[places]
        predict = fit(x[train], y[train], key)
        rows = [
            (*key, months[i].date(), "test", values[i], p)
            for i, p in zip(np.array(places)[~train], predict(x[~train]))
        ]
        if refit:
            predict = fit(x, y, key)
        history, month = list(values), months[-1]
        for _ in range(horizon):
            month = month + pd.DateOffset(months=1)
            row = np.array([_feature_row(history, month, lags, means)], dtype=float)
            history.append(max(0.0, float(predict(row)[0])))
            rows.append((*key, month.date(), "forecast", None, history[-1]))
        return pd.DataFrame(rows, columns=columns)

    typed = monthly.select(*series, "sales_month", F.col(value).cast("double").alias(value)).dropna()
    # Fitting is the cost here, not bytes: a fixed number of parts keeps AQE from
    # folding the small shuffle into one task.
    parts = monthly.sparkSession.sparkContext.defaultParallelism
    return typed.repartition(parts, *series).groupBy(*series).applyInPandas(one_series, schema)


def forecast_sales(
    monthly: DataFrame,
    series: Sequence[str],
    value: str = "total_sales",
    horizon: int = HORIZON,
    refit: bool = False,
) -> DataFrame:
    """Linear regression on eight lag features, fed forward for ``horizon`` months.

    As in the analysed process the model is fitted on the training years only;
    ``refit`` fits it again on all rows before forecasting.
    """
    return _forecast(
        monthly, series, value, lambda x, y, key: _least_squares(x, y),
        SALES_LAGS, SALES_MEANS, horizon, refit, 2,
    )


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A small table written and read back, so that later steps do not work it out again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boosted_model(train: DataFrame, series: Sequence[str], value: str, trees: int, depth: int, rate: float, sample: float, seed: int) -> PipelineModel:
    """One gradient-boosted model over the rows of all series, which it tells apart by their number.

    Rows are placed by series and month first, so that the draws do not depend on how they came.
    """
    key = F.concat_ws("\x01", *series)
    parts = 1 + train.count() // ROWS_A_PART
    rows = train.withColumn("series_key", key).repartition(parts, "series_key").sortWithinPartitions("series_key", "sales_month")
    index = StringIndexer(inputCol="series_key", outputCol="series_no", stringOrderType="alphabetAsc").fit(rows)
    told_apart = len(index.labels) <= MOST_CATEGORIES  # beyond, the lags alone carry a series' level
    columns = [*(["series_no"] if told_apart else []), "year", "month", *[f"lag{k}" for k in COUNT_LAGS], *[f"rolling_mean{n}" for n in COUNT_MEANS]]
    gathered = VectorAssembler(inputCols=columns, outputCol="features")
    model = GBTRegressor(
        labelCol=value, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=sample, seed=seed,
        maxBins=max(32, len(index.labels) if told_apart else 0), cacheNodeIds=True,
    )
    return Pipeline(stages=[index, gathered, model]).fit(rows)


def forecast_transactions(
    monthly: DataFrame,
    series: Sequence[str] = ("category",),
    value: str = "transactions",
    horizon: int = HORIZON,
    trees: int = 30,
    depth: int = 4,
    rate: float = 0.1,
    sample: float = 0.8,
    seed: int = 42,
) -> DataFrame:
    """Spark ML's boosted trees over the lag features of all series, rolled forward month by month.

    The rows are those of ``lag_features``. A series needs twelve complete ones, some of them to
    train and some to test. Test rows come with their prediction; no prediction is below 0.
    """
    spark = monthly.sparkSession
    keys = list(series)
    typed = monthly.select(*keys, "sales_month", F.col(value).cast("double").alias(value)).dropna()
    features = with_split(lag_features(typed, value, keys, COUNT_LAGS, COUNT_MEANS), keys)
    learnt = F.count_if(F.col("split") == "train")
    enough = features.groupBy(*keys).agg(F.count("*").alias("n"), learnt.alias("learnt"))
    enough = enough.where((F.col("n") >= MIN_ROWS) & (F.col("learnt") > 0) & (F.col("learnt") < F.col("n"))).select(*keys)
    rows = _stored(features.join(enough, keys), "forecast-rows")
    names = [*keys, "sales_month", "kind", "actual", "predicted"]
    train = rows.where("split = 'train'")
    if train.isEmpty():
        kinds = dict(typed.dtypes)
        return spark.createDataFrame([], ", ".join([*(f"{k} {kinds[k]}" for k in keys), "sales_month date, kind string, actual double, predicted double"]))
    model = boosted_model(train, keys, value, trees, depth, rate, sample, seed)

    def predicted(frame: DataFrame) -> DataFrame:
        scored = model.transform(frame.withColumn("series_key", F.concat_ws("\x01", *keys)))
        return scored.withColumn("predicted", F.greatest(F.col("prediction"), F.lit(0.0)))  # a count is never below 0

    tested = predicted(rows.where("split = 'test'")).select(
        *keys, "sales_month", F.lit("test").alias("kind"), F.col(value).alias("actual"), "predicted"
    )
    # A series is at most a few hundred months; its last ones are all that the next month needs.
    kept = max(*COUNT_LAGS, *COUNT_MEANS)
    ordered = F.array_sort(F.collect_list(F.struct("sales_month", F.col(value).alias("value"))))
    state = typed.join(enough, keys).groupBy(*keys).agg(ordered.alias("_all")).select(
        *keys, F.element_at("_all", -1)["sales_month"].alias("sales_month"), F.slice(F.transform("_all", lambda m: m["value"]), -kept, kept).alias("history")
    )
    steps = []
    for _ in range(horizon):
        ahead = state.withColumn("sales_month", F.add_months("sales_month", 1))
        mean = {f"rolling_mean{n}": F.aggregate(F.slice("history", -n, n), F.lit(0.0), lambda total, x: total + x) / n for n in COUNT_MEANS}
        lags = {f"lag{k}": F.element_at("history", -k) for k in COUNT_LAGS}
        asked = ahead.withColumns({"year": F.year("sales_month"), "month": F.month("sales_month"), **lags, **mean})
        found = predicted(asked)
        history = F.slice(F.concat("history", F.array("predicted")), -kept, kept)
        state = _stored(found.select(*keys, "sales_month", "predicted", history.alias("history")), "forecast-month")
        steps.append(state.select(*keys, "sales_month", F.lit("forecast").alias("kind"), F.lit(None).cast("double").alias("actual"), half_even("predicted", 2).alias("predicted")))
    return reduce(DataFrame.unionByName, steps, tested).select(*names)


def only_forecast(scored: DataFrame, name: str, series: Sequence[str] = ("category",)) -> DataFrame:
    return scored.filter("kind = 'forecast'").select(
        *series, "sales_month", F.col("predicted").alias(name)
    )


def same_month_last_year(monthly: DataFrame, value: str, factor: str = "1.05") -> DataFrame:
    """A plain stand-in forecast: the same month one year earlier times a factor."""
    latest = monthly.agg(F.max("sales_month")).scalar()
    scaled = F.col(value).cast("decimal(28,4)") * F.lit(factor).cast("decimal(4,2)")
    return monthly.filter(F.col("sales_month") > F.add_months(latest, -12)).withColumns(
        {"sales_month": F.add_months("sales_month", 12), value: F.round(scaled, 2)}
    )
