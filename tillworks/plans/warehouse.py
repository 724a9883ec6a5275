"""From uploaded files to marts: ingest, clean, rebuild, forecast, roll back.

Layout under one root folder: raw and clean tables, partial aggregates and matched reviews,
all partitioned by batch; an append-only ledger; and versions of the marts behind a manifest
(see sources.versions). Every step is a function of tables on disk, so a failed step can
simply run again, and readers of marts see whole versions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.functions.scalars import category_key
from tillworks.operators import cleaning, dimensions, forecast, marts, partials, ratings, reviews, segments, text
from tillworks.session import released_shuffles, staged
from tillworks.sources import files, tables
from tillworks.sources.versions import Rebuild, Snapshot, rebuild

RAW = {"sales": "raw_sales", "reviews": "raw_reviews"}
CLEAN = {"sales": "sales", "reviews": "reviews"}
LOADED = ("clean_loaded", "completed")
ARRIVAL = "loaded_at"
LOADS = "batch_id string, load string, at timestamp"


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def mart(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A mart of the newest whole version."""
    return Snapshot(spark, root).mart(name)


def save_mart(df: DataFrame, root: str, name: str) -> None:
    """Publish a version that differs in one mart."""
    with rebuild(df.sparkSession, root) as build:
        build.save(df, name)


# --- batches --------------------------------------------------------------


def ledger(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(_path(root, "ledger"))


def set_status(spark: SparkSession, root: str, batch_id: str, status: str, number: int, **about) -> None:
    tables.record_status(spark, _path(root, "ledger"), batch_id, status, number, **about)


def ingest(
    spark: SparkSession, root: str, path: str, kind: str, year: int, batch_id: str | None = None
) -> DataFrame:
    """Load one upload as a new batch; returns its one-row load summary."""
    batch_id = batch_id or str(uuid.uuid4())
    rows = files.read_upload(spark, path, kind, batch_id).withColumns(files.arrival())
    name = path.rstrip("/").rsplit("/", 1)[-1]
    set_status(spark, root, batch_id, "uploaded", 0, dataset_year=year, dataset_type=kind, filename=name)
    tables.append_rows(rows, _path(root, RAW[kind]))
    set_status(spark, root, batch_id, "raw_loaded", 1)
    return files.load_summary(spark.read.parquet(_path(root, RAW[kind])), batch_id)


def clean_batch(spark: SparkSession, root: str, kind: str, batch_id: str, origin: str = "1970-01-01") -> None:
    """Raw rows of one batch to typed rows and partial aggregates; only that batch's folder is read."""
    raw = tables.read_batch(spark, _path(root, RAW[kind]), batch_id)
    if kind == "sales":
        store_sales(spark, root, cleaning.clean_sales(raw), [batch_id])
    else:
        store_reviews(spark, root, cleaning.with_review_id(cleaning.clean_reviews(raw, origin)), [batch_id])
    set_status(spark, root, batch_id, "clean_loaded", 2)


# --- what is stored per batch ---------------------------------------------
#
# Derived tables are written under the name of a load. A load becomes visible with one small
# append that says which batches it now speaks for, so a load that is broken off, or that finds
# no rows for a batch it had rows for before, never leaves a mixture behind.


def _of(spark: SparkSession, root: str, name: str, batches: list[str]) -> DataFrame:
    """Clean rows of some batches; the filter is on the partition column, so other folders are not read."""
    return spark.read.parquet(_path(root, name)).filter(F.col("batch_id").isin(batches))


def _loads(spark: SparkSession, root: str, batches: list[str] | None = None) -> list[str]:
    """``load/batch`` of the load that speaks for each of these batches (None: all); one entry per upload."""
    if not tables.exists(spark, _path(root, "loads")):
        return []
    loads = spark.read.schema(LOADS).parquet(_path(root, "loads"))
    if batches is not None:
        loads = loads.filter(F.col("batch_id").isin(batches))
    latest = loads.groupBy("batch_id").agg(F.max_by("load", F.struct("at", "load")).alias("load"))
    return sorted(f"{r['load']}/{r['batch_id']}" for r in latest.collect())


def _derived(spark: SparkSession, root: str, name: str, loads: list[str], like: T.StructType) -> DataFrame:
    """Rows of a derived table from these loads; other folders are not read. ``like`` has the columns to read."""
    if not tables.exists(spark, _path(root, name)):
        return spark.createDataFrame([], like)
    fields = [f for f in like.fields if f.name != "batch_id"]
    schema = T.StructType([*fields, T.StructField("load", T.StringType()), T.StructField("batch_id", T.StringType())])
    rows = spark.read.schema(schema).parquet(_path(root, name)).filter(F.concat_ws("/", "load", "batch_id").isin(loads))
    return rows.select(*like.names)


def _write(df: DataFrame, root: str, name: str, load: str) -> None:
    rows = df.withColumn("load", F.lit(load)).write.mode("append").option("compression", tables.COMPRESSION)
    with released_shuffles(df.sparkSession):
        rows.partitionBy("load", "batch_id").parquet(_path(root, name))


def _finish_load(spark: SparkSession, root: str, load: str, batches: list[str]) -> None:
    rows = spark.createDataFrame([(b, load, None) for b in batches], LOADS).withColumn("at", F.current_timestamp())
    rows.coalesce(1).write.mode("append").parquet(_path(root, "loads"))  # one file, so it is there or it is not


def _partial_schemas(spark: SparkSession, root: str) -> dict[str, T.StructType]:
    return {name: frame.schema for name, frame in partials.sales_partials(spark.read.parquet(_path(root, "sales"))).items()}


def store_sales(spark: SparkSession, root: str, clean: DataFrame, batches: list[str]) -> None:
    """Store clean sales of new batches with their partial aggregates."""
    tables.append_rows(clean, _path(root, "sales"))
    derive_sales(spark, root, batches)


def derive_sales(spark: SparkSession, root: str, batches: list[str]) -> None:
    """Partial aggregates of batches whose clean sales have just been stored.

    Orders that an earlier batch holds too become contested: the partials of both are worked
    out without them, and their rows are kept apart. That reads the narrow order ids of all
    batches once per load, and the rows of the batches that share orders; a rollback reads neither.
    Only rows of contested orders and of orders that come twice in a batch are compared with each other;
    all others are summed where they are read.
    """
    load = uuid.uuid4().hex
    named = _of(spark, root, "sales", batches).where("order_id IS NOT NULL")
    _write(named.groupBy("order_id", "batch_id").agg(F.count(F.lit(1)).alias("n")), root, "order_ids", load)
    counted = T.StructType.fromDDL("order_id string, batch_id string, n long")
    counts = _derived(spark, root, "order_ids", [f"{load}/{b}" for b in batches], counted)
    new = counts.drop("n")
    others = [one for one in _loads(spark, root) if one.split("/", 1)[1] not in batches]
    known = _derived(spark, root, "order_ids", others, new.schema)
    among = new.groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("order_id")
    among = staged(among, "orders-among") if len(batches) > 1 else new.limit(0).select("order_id")
    met = staged(known.join(new, "order_id", "left_semi"), "orders-met") if others else new.limit(0)
    # One name per uploaded batch that shares an order.
    touched = sorted(r["batch_id"] for r in met.select("batch_id").distinct().collect())
    affected = sorted({*touched, *batches})
    before = _loads(spark, root, touched)
    shared = among.union(met.select("order_id")).distinct()
    contested = _derived(spark, root, "contested_ids", before, new.schema).unionByName(met)
    contested = staged(contested.unionByName(new.join(staged(shared, "orders-shared"), "order_id", "left_semi")).distinct(), "contested-ids")
    _write(contested, root, "contested_ids", load)
    carried = _derived(spark, root, "order_ids", before, counted)
    if before:
        _write(carried, root, "order_ids", load)
    keys = ["batch_id", "order_id"]
    # ids stored without a count may come twice
    twice = counts.unionByName(carried).where("n IS NULL OR n > 1").select(*keys)
    apart = staged(twice.unionByName(contested).distinct(), "orders-apart")
    sales = _of(spark, root, "sales", affected)
    rows = staged(cleaning.last_per_order(sales.join(apart, keys, "left_semi"), ARRIVAL, within=("batch_id",)), "settled-sales", tables.COMPRESSION)
    _write(rows.join(contested, keys, "left_semi"), root, "contested_sales", load)
    plain = sales.join(apart, keys, "left_anti")
    for name, frame in partials.sales_partials(plain.unionByName(rows.join(contested, keys, "left_anti"))).items():
        _write(frame, root, f"partial_{name}", load)
    _finish_load(spark, root, load, affected)


def store_reviews(spark: SparkSession, root: str, clean: DataFrame, batches: list[str], match=cleaning.matched_reviews) -> None:
    """Store clean reviews of new batches, those that line up with sales, and their partial aggregates."""
    load = uuid.uuid4().hex
    tables.append_rows(clean, _path(root, "reviews"))
    matched = match(_of(spark, root, "reviews", batches))
    _write(matched, root, "matched_reviews", load)
    schema = matched.schema
    own = [f"{load}/{b}" for b in batches]
    rated = partials.review_partials(_derived(spark, root, "matched_reviews", own, schema))
    _write(rated, root, "partial_reviews", load)
    _finish_load(spark, root, load, batches)


def active_batches(spark: SparkSession, root: str, kind: str) -> list[str]:
    """The batches of a kind that count, by the ledger: one name per upload."""
    events = ledger(spark, root)
    kinds = events.where(F.col("dataset_type") == kind).select("batch_id").distinct()
    current = tables.current_status(events).where(F.col("status").isin(*LOADED))
    return sorted(r["batch_id"] for r in kinds.join(current, "batch_id").collect())


def active(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Clean rows of the batches that count; folders of others are not read."""
    return _of(spark, root, CLEAN[kind], active_batches(spark, root, kind))


def sales_fact(spark: SparkSession, root: str) -> DataFrame:
    """One row per order id, the last one loaded."""
    return cleaning.last_per_order(active(spark, root, "sales"), ARRIVAL)


def merged_sales(spark: SparkSession, root: str, batches: list[str]) -> dict[str, DataFrame]:
    """Partial rows of these batches. Only contested orders are looked at row by row."""
    loads = _loads(spark, root, batches)
    stored = {name: _derived(spark, root, f"partial_{name}", loads, schema) for name, schema in _partial_schemas(spark, root).items()}
    contested = _derived(spark, root, "contested_sales", loads, spark.read.parquet(_path(root, "sales")).schema)
    return partials.merged_sales(stored, contested, ARRIVAL)


def rated_reviews(spark: SparkSession, root: str, batches: list[str]) -> DataFrame:
    """Partial rows of the matched reviews of these batches."""
    like = T.StructType.fromDDL(partials.REVIEWS)
    return _derived(spark, root, "partial_reviews", _loads(spark, root, batches), like)


def roll_back(spark: SparkSession, root: str, batch_id: str) -> None:
    """Take a batch out: one ledger line. Rebuild the marts afterwards."""
    set_status(spark, root, batch_id, tables.ROLLED_BACK, 9)


# --- star schema and marts ------------------------------------------------


def build_star(sales: dict[str, DataFrame], rated: DataFrame | None = None) -> dict[str, DataFrame]:
    """Dimensions merged from the partials that count, so no orphan can remain."""
    days = sales["day_category"]
    months = [days.select(F.trunc("order_date", "MM").alias("m"))]
    if rated is not None:
        months.append(rated.select(F.col("review_month").alias("m")))
    return {
        "dim_customer": dimensions.customer_dimension(sales["customers"]),
        "dim_product": dimensions.product_dimension(sales["products"]),
        "dim_date": dimensions.date_dimension(days),
        "dim_month": dimensions.month_dimension(*months),
    }


def rebuild_marts(spark: SparkSession, root: str, with_reviews: bool = True, within: Rebuild | None = None) -> None:
    """Dimensions and marts from the partial aggregates, published as one version.

    No fact row is read: matched reviews are named by their batches, all else is merged from partials.
    """
    with rebuild(spark, root, within) as build:
        sales, rated = merged_sales(spark, root, active_batches(spark, root, "sales")), None
        if with_reviews:
            batches = active_batches(spark, root, "reviews")
            build.name_loads("customer_review_matched", "matched_reviews", _loads(spark, root, batches))
            rated = rated_reviews(spark, root, batches)
        days = build.save(sales["day_category"].drop("batch_id"), "sales_days")
        for name, frame in build_star(sales | {"day_category": days}, rated).items():
            build.save(frame, name)
        build.save(marts.new_customers(build.mart("dim_customer")), "new_customer")
        build.save(marts.sales_growth(days), "sales_growth")
        build.save(partials.category_months(days), "products_transactions")
        if rated is not None:
            build.save(partials.rating_by_category_month(rated), "review_score_category_monthly")
            build.save(partials.rating_by_category(rated), "review_score_category_summary")
            build.save(partials.rating_by_product_month(rated), "review_score_product_monthly")
            build.save(partials.sales_review_summary(days, rated), "sales_review_score_summary")


def review_content(
    spark: SparkSession, root: str, vectors: DataFrame, topics: DataFrame, lexicon: DataFrame,
    threshold: float = 0.35, top_n: int = 3, within: Rebuild | None = None,
) -> None:
    """Sentiment and topics of the matched reviews, and the marts on top.

    ``vectors`` holds (review_id, embedding); see text.encode_texts for making it.
    Reviews get their id in the clean step.
    """
    with rebuild(spark, root, within) as build:
        matched = build.mart("customer_review_matched").drop("load", "batch_id").join(vectors, "review_id")
        processed = build.save(text.enrich_reviews(matched, topics, lexicon, threshold, top_n), "review_processed")
        detail = build.save(text.explode_topics(processed), "review_topic_detail")
        monthly = build.save(reviews.category_month_mart(processed), "review_category_monthly")
        build.save(reviews.topic_month_mart(detail), "review_topic_category_monthly")
        sold = reviews.sales_by_month_and_key(build.mart("products_transactions"))
        both = reviews.combine_sales_and_reviews(sold, monthly)
        combined = build.save(reviews.ready_to_save(reviews.with_review_impact(both)), "sales_review_category_combined")
        build.save(reviews.category_correlations(combined), "review_sales_correlation")


def segmentation(spark: SparkSession, root: str, within: Rebuild | None = None) -> None:
    with rebuild(spark, root, within) as build:
        build.save(segments.segment_mart(build.mart("sales_review_category_combined")), "monthly_category_segmentation")


def forecasts(spark: SparkSession, root: str, within: Rebuild | None = None) -> None:
    """Total sales split over categories, and transactions per category, from the stored day totals."""
    with rebuild(spark, root, within) as build:
        days = build.mart("sales_days")
        monthly = forecast.monthly_sales(days).withColumn("series", F.lit("all"))
        ahead = forecast.only_forecast(forecast.forecast_sales(monthly, ["series"]), "predicted", ["series"])
        shares = forecast.recent_shares(build.mart("products_transactions"))
        key = category_key("category").alias("category_key")
        build.save(forecast.allocate(ahead, shares).select("*", key), "sales_forecast")
        scored = forecast.forecast_transactions(partials.monthly_orders(days, "category"))
        build.save(forecast.only_forecast(scored, "forecast_transactions").select("*", key), "products_forecast")


def score_analysis(spark: SparkSession, root: str, min_reviews: int = 5, min_total: int = 10) -> dict[str, DataFrame]:
    """All review-score results over the stored marts, as frames."""
    seen = Snapshot(spark, root)
    by_category = seen.mart("review_score_category_summary")
    by_month = seen.mart("review_score_category_monthly")
    by_product = seen.mart("review_score_product_monthly")
    both = seen.mart("sales_review_score_summary")
    return {
        "kpi_summary": ratings.review_kpis(by_category, both),
        "category_rankings": ratings.category_rankings(by_category),
        "monthly_overall": ratings.month_overall(by_month),
        "best_and_worst": ratings.best_and_worst_by_month(by_month),
        "product_months": ratings.product_month_rankings(by_product, min_reviews),
        "product_overall": ratings.product_overall_rankings(by_product, min_total),
        "correlations": ratings.sales_score_correlations(both),
        "low_rated_high_sellers": ratings.low_rated_high_sellers(both),
    }



# --- one run --------------------------------------------------------------


def loaded_kinds(spark: SparkSession, root: str) -> set[str]:
    """Which of sales and reviews have a cleaned batch that was not rolled back."""
    events = ledger(spark, root)
    kinds = events.where("dataset_type IS NOT NULL").select("batch_id", "dataset_type").distinct()
    current = tables.current_status(events).where(F.col("status").isin(*LOADED))
    return {r["dataset_type"] for r in kinds.join(current, "batch_id").select("dataset_type").distinct().collect()}


def refresh(
    spark: SparkSession, root: str, vectors: DataFrame | None = None, topics: DataFrame | None = None,
    lexicon: DataFrame | None = None, threshold: float = 0.35, top_n: int = 3,
) -> list[str]:
    """Everything that can be built from what is loaded; returns the steps that ran.

    Sales alone give marts and forecasts. Reviews add the score marts, and with
    vectors, topics and a lexicon the content marts and segments. Reviews alone
    give nothing, as every review mart is matched with sales.
    """
    kinds = loaded_kinds(spark, root)
    if "sales" not in kinds:
        return []
    steps = ["marts", "forecasts"]
    with rebuild(spark, root) as build:  # one version holds all of it
        rebuild_marts(spark, root, "reviews" in kinds, build)
        forecasts(spark, root, build)
        if "reviews" in kinds and vectors is not None and topics is not None and lexicon is not None:
            review_content(spark, root, vectors, topics, lexicon, threshold, top_n, build)
            segmentation(spark, root, build)
            steps += ["review_content", "segmentation"]
    return steps
