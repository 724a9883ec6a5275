"""Aggregate and window expressions used by more than one operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.functions.scalars import as_column, half_even


def pearson(x: Column | str, y: Column | str, places: int = 4) -> Column:
    """Correlation over the rows where both sides are present.

    NULL for one row or for a constant side: the built-in ``corr`` raises a
    division error there under ANSI mode.
    """
    a, b = as_column(x).cast("double"), as_column(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when(F.count(a) > 1, half_even(F.try_divide(F.covar_pop(a, b), spread), places))


def mean_of_rounded(c: Column | str, places: int = 4) -> Column:
    """Mean of values that carry ``places`` decimals, summed exactly, so the
    result does not depend on how the rows were partitioned."""
    x = as_column(c)
    return F.try_divide(F.sum(x.cast(f"decimal(18,{places})")).cast("double"), F.count(x))


def rating_buckets(score: Column | str = "review_score") -> list[Column]:
    """Counts of good (>= 4), middling (= 3) and poor (<= 2) ratings."""
    s = as_column(score)
    return [
        F.count_if(s >= 4).alias("positive_reviews"),
        F.count_if(s == 3).alias("neutral_reviews"),
        F.count_if(s <= 2).alias("negative_reviews"),
    ]


def label_buckets(label: Column | str = "sentiment_label", names=("positive_reviews", "neutral_reviews", "negative_reviews")) -> list[Column]:
    s = as_column(label)
    return [
        F.count_if(s == want).alias(name)
        for want, name in zip(("Positive", "Neutral", "Negative"), names)
    ]


def top_n(df: DataFrame, n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First ``n`` rows in a total order, numbered.

    The limit keeps only n rows per task before anything is gathered; the
    numbering window then sees at most n rows.
    """
    best = df.orderBy(*order).limit(n)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def standings(
    df: DataFrame, ranks: dict[str, list[tuple[str, bool]]], path: str, slices: int = 256
) -> DataFrame:
    """Competition ranks (ties share a place) without a window over all rows.

    ``ranks`` maps a rank name to its keys, [(column, descending), ...]. Rows are
    first counted per distinct set of figures, so a figure shared by a third of
    the rows becomes one row; that reduced table is written to ``path`` and every
    rank is worked out on it. Its rows are cut into ``slices`` equal parts of the
    first key's range; places are counted inside a slice and moved on by the
    sizes of the better slices. Rows without a figure come last, in either
    direction, and share their places like any others.
    """
    spark = df.sparkSession
    columns = sorted({c for keys in ranks.values() for c, _ in keys})
    df.groupBy(*columns).agg(F.count("*").alias("_n")).write.parquet(path)
    figures = spark.read.parquet(path)
    placed = figures.drop("_n")
    for rank, keys in ranks.items():
        lead, descending = keys[0]
        names = [c for c, _ in keys]
        order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]
        low, high = figures.agg(F.min(lead)).scalar(), figures.agg(F.max(lead)).scalar()
        cut = F.floor(F.try_divide((F.col(lead) - low) * slices, high - low))
        tuples = (
            figures.groupBy(*names)
            .agg(F.sum("_n").alias("_n"))
            .withColumn("_slice", F.when(F.col(lead).isNotNull(), F.coalesce(cut, F.lit(0))))
        )
        better = Window.orderBy(F.col("_slice").desc_nulls_last() if descending else F.col("_slice").asc_nulls_last())
        inside = Window.partitionBy("_slice").orderBy(*order)
        ahead = (
            tuples.groupBy("_slice")
            .agg(F.sum("_n").alias("_rows"))
            .select(
                "_slice",
                (F.sum("_rows").over(better) - F.col("_rows")).alias("_ahead"),
            )
        )
        # At most slices + 1 rows of offsets, whatever the data.
        places = _matched(tuples, F.broadcast(ahead), ["_slice"]).select(
            *names,
            (F.col("_ahead") + F.sum("_n").over(inside) - F.col("_n") + 1).alias(rank),
        )
        placed = _matched(placed, places, names)
    return _matched(df, placed, columns)


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where NULL equals NULL; the keys come from the left."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in keys})
    same = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in keys]
    return left.join(renamed, same).drop(*[f"_right_{c}" for c in keys])
