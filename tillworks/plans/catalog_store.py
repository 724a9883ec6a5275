"""Registered queries over a store that is filled from the given tables: batches, rollback, rebuild, publication.

Sales arrive as one batch per year and a later correction of one month; reviews as one batch per
year. The check SQL says the same over the given tables, without batches or partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.operators import marts
from tillworks.plans import warehouse
from tillworks.plans.oracle_views import buckets
from tillworks.plans.registry import query
from tillworks.session import fresh_path, stored_bytes
from tillworks.sources import tables
from tillworks.sources.star_views import review_events, sales_lines
from tillworks.sources.versions import Rebuild, Snapshot

CORRECTION = "sales-correction"


# Bytes of lineitem files whose lines are joined at a time; what is shuffled for them is about eight times as much.
PART_BYTES = 256 << 20


def sales_parts(spark: SparkSession, d: str) -> list[DataFrame]:
    """Every line as an order of its own, in the batch of its year; as many frames as the lines need, split by order."""
    parts = 1 + stored_bytes(spark, f"{d}/lineitem.parquet") // PART_BYTES
    lines = sales_lines(
        spark, d, "order_id", "line_number", "l_partkey", "l_suppkey", "l_extendedprice", "customer_key", "customer_name", "city", "category", "subcategory", "product_id", "order_date", "sales", "profit"
    )

    def rows(part: int) -> DataFrame:
        some = lines.where(F.pmod(F.xxhash64("order_id"), F.lit(parts)) == part) if parts > 1 else lines
        return some.select(
            F.concat_ws("-", "order_id", *[F.col(c).cast("string") for c in ("line_number", "l_partkey", "l_suppkey", "l_extendedprice")]).alias("order_id"),
            F.col("customer_key").alias("customer_id"), "customer_name", "city", "category", "subcategory", "product_id", "order_date", "sales", "profit",
            F.concat(F.lit("sales-"), F.year("order_date")).alias("batch_id"),
            F.year("order_date").alias(warehouse.ARRIVAL),
        ).where("batch_id IS NOT NULL")

    return [rows(part) for part in range(parts)]


def corrected(rows: DataFrame) -> DataFrame:
    """The lines of March 1997 once more with doubled sales and no profit, in a batch that arrives last."""
    return rows.where("order_date >= DATE '1997-03-01' AND order_date < DATE '1997-04-01'").withColumns(
        {
            "sales": (F.col("sales") * 2).cast(rows.schema["sales"].dataType),
            "profit": F.lit(0).cast(rows.schema["profit"].dataType),
            "batch_id": F.lit(CORRECTION),
            warehouse.ARRIVAL: F.lit(9999),
        }
    )


def review_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = review_events(spark, d, "review_id", "user_id", "review_date", "review_score", "product_id", "product_name", "category", "subcategory", "product_type")
    return rows.withColumn("batch_id", F.concat(F.lit("reviews-"), F.year("review_date")))


def _note(spark: SparkSession, root: str, kind: str, batches: list[str], status: str, number: int) -> None:
    rows = [(b, None, kind, None, status, number, None) for b in batches]
    events = spark.createDataFrame(rows, tables.LEDGER_SCHEMA).withColumn("at", F.current_timestamp())
    events.write.mode("append").parquet(f"{root}/ledger")


def _names(rows: DataFrame) -> list[str]:
    return sorted(r["batch_id"] for r in rows.select("batch_id").distinct().collect())  # one name per upload


def _load_sales(spark: SparkSession, root: str, parts: list[DataFrame]) -> DataFrame | None:
    """Store sales of batches that the store does not hold yet as the clean step would, with their ledger lines; returns them."""
    path = f"{root}/{warehouse.CLEAN['sales']}"
    batches = tables.append_parts(spark, parts, path)
    if not batches:
        return None
    warehouse.derive_sales(spark, root, batches)
    _note(spark, root, "sales", batches, "clean_loaded", 2)
    return spark.read.parquet(path).where(F.col("batch_id").isin(batches))


def _load_reviews(spark: SparkSession, root: str, rows: DataFrame) -> None:
    batches = _names(rows)
    if batches:
        warehouse.store_reviews(spark, root, rows, batches, match=lambda r: r)
        _note(spark, root, "reviews", batches, "clean_loaded", 2)


_STORES: dict[tuple, str] = {}


def filled_store(spark: SparkSession, d: str) -> str:
    """The root of a store with all batches loaded, written once per session and source."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        root = fresh_path(spark, "store")
        sales = _load_sales(spark, root, sales_parts(spark, d))
        if sales is not None:
            _load_sales(spark, root, [corrected(sales)])
        _load_reviews(spark, root, review_batches(spark, d))
        _STORES[key] = root
    return _STORES[key]


@contextmanager
def rolled_back(spark: SparkSession, root: str, **batches: list[str]) -> Iterator[None]:
    """Batches taken back for a while and then counted again, each by one ledger line. Published versions stay as they were."""
    for names in batches.values():
        for batch in names:
            warehouse.roll_back(spark, root, batch)
    try:
        yield
    finally:
        for kind, names in batches.items():
            _note(spark, root, kind, names, "completed", 10)


# --- what the queries show --------------------------------------------------


def _star_rows(seen: Snapshot) -> DataFrame:
    """All four dimensions as rows of one shape."""
    none = F.lit(None).cast("string")
    customer = seen.mart("dim_customer").select(F.lit("customer").alias("dimension"), F.col("customer_id").alias("key"), F.col("customer_name").alias("name"), F.col("city").alias("part"), F.col("first_month").alias("day"))
    product = seen.mart("dim_product").select(F.lit("product").alias("dimension"), F.col("product_id").alias("key"), F.col("category").alias("name"), F.col("subcategory").alias("part"), F.lit(None).cast("date").alias("day"))
    day = seen.mart("dim_date").select(F.lit("date").alias("dimension"), none.alias("key"), none.alias("name"), none.alias("part"), F.col("sales_date").alias("day"))
    month = seen.mart("dim_month").select(F.lit("month").alias("dimension"), F.col("year_month").alias("key"), F.col("month_name").alias("name"), none.alias("part"), F.col("month_start").alias("day"))
    return customer.unionByName(product).unionByName(day).unionByName(month)


MART_ROWS = "mart string, category string, month date, total double, amount double, n bigint, good bigint, middling bigint, poor bigint"


def _mart_rows(seen: Snapshot) -> DataFrame:
    """The additive marts as rows of one shape."""

    def rows(name: str, **columns) -> DataFrame:
        kinds = dict(c.split() for c in MART_ROWS.split(", "))
        given = {"mart": F.lit(name)} | {k: F.col(v) for k, v in columns.items()}
        return seen.mart(name).select(*[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])

    scores = {"good": "positive_reviews", "middling": "neutral_reviews", "poor": "negative_reviews", "n": "total_reviews", "amount": "avg_review_score"}
    out = rows("new_customer", month="first_month", n="new_customers")
    for more in (
        rows("sales_growth", month="sales_month", total="total_sales", amount="total_profit"),
        rows("products_transactions", category="category", month="sales_month", total="total_sales", n="total_transactions"),
        rows("review_score_category_summary", category="category", **scores),
        rows("review_score_category_monthly", category="category", month="review_month", **scores),
        rows("sales_review_score_summary", category="category", total="total_sales", amount="avg_review_score", n="total_reviews"),
    ):
        out = out.unionByName(more)
    return out


# --- the check SQL ----------------------------------------------------------


def _loaded(sales: str, reviews: str, corrected: bool = True) -> str:
    """Sales and reviews that count, as common table expressions."""
    fixed = "order_date >= DATE '1997-03-01' AND order_date < DATE '1997-04-01'" if corrected else "FALSE"
    return f"""WITH counted AS (
  SELECT customer_key AS customer_id, customer_name, city, category, subcategory, product_id, order_date, sales_month,
    CASE WHEN {fixed} THEN sales * 2 ELSE sales END AS sales, CASE WHEN {fixed} THEN 0 ELSE profit END AS profit
  FROM sales_lines WHERE {sales}
), rated AS (SELECT *, CAST(date_trunc('month', review_date) AS DATE) AS review_month FROM review_events WHERE {reviews})"""


FIRST = "arg_min(struct_pack(n := customer_name, c := city), struct_pack(d := order_date, n := customer_name, c := city))"


def _star_sql(sales: str, reviews: str, corrected: bool = True) -> str:
    return f"""{_loaded(sales, reviews, corrected)}
SELECT 'customer' AS dimension, customer_id AS key, ({FIRST}).n AS name, ({FIRST}).c AS part,
  CAST(date_trunc('month', min(order_date)) AS DATE) AS day FROM counted GROUP BY customer_id
UNION ALL SELECT 'product', product_id, min(category), arg_min(subcategory, struct_pack(c := category, s := subcategory)), NULL FROM counted GROUP BY product_id
UNION ALL SELECT DISTINCT 'date', NULL, NULL, NULL, order_date FROM counted
UNION ALL SELECT DISTINCT 'month', strftime(m, '%Y-%m'), strftime(m, '%B'), NULL, m FROM (SELECT sales_month AS m FROM counted UNION SELECT review_month FROM rated)"""


def _mart_sql(sales: str, reviews: str, corrected: bool = True) -> str:
    empty = "NULL::BIGINT"
    score = "sum(review_score)::DOUBLE / count(review_score)"
    return f"""{_loaded(sales, reviews, corrected)}, firsts AS (SELECT CAST(date_trunc('month', min(order_date)) AS DATE) AS m FROM counted GROUP BY customer_id),
scores AS (SELECT category, count(*) AS n, {score} AS mean, {buckets('review_score')} FROM rated GROUP BY category)
SELECT 'new_customer' AS mart, NULL::VARCHAR AS category, m AS month, NULL::DOUBLE AS total, NULL::DOUBLE AS amount, count(*) AS n,
  {empty} AS good, {empty} AS middling, {empty} AS poor FROM firsts GROUP BY m
UNION ALL SELECT 'sales_growth', NULL, sales_month, sum(sales)::DOUBLE, sum(profit)::DOUBLE, NULL, NULL, NULL, NULL FROM counted GROUP BY sales_month
UNION ALL SELECT 'products_transactions', category, sales_month, sum(sales)::DOUBLE, NULL, count(category), NULL, NULL, NULL FROM counted GROUP BY category, sales_month
UNION ALL SELECT 'review_score_category_summary', category, NULL, NULL, mean, n, positive_reviews, neutral_reviews, negative_reviews FROM scores
UNION ALL SELECT 'review_score_category_monthly', category, review_month, NULL, {score}, count(*), {buckets('review_score')} FROM rated GROUP BY category, review_month
UNION ALL SELECT 'sales_review_score_summary', s.category, NULL, s.total, coalesce(mean, 0), coalesce(n, 0), NULL, NULL, NULL
FROM (SELECT category, sum(sales)::DOUBLE AS total FROM counted GROUP BY category) s LEFT JOIN scores USING (category)"""


BOTH = ("sales_lines", "review_events")


@query("star_build", BOTH, f"SELECT * FROM ({_star_sql('TRUE', 'TRUE')})")
def star_build(spark: SparkSession, d: str) -> DataFrame:
    """Customer, product, date and month dimensions, merged from the partials of all batches and published."""
    root = filled_store(spark, d)
    warehouse.rebuild_marts(spark, root)
    return _star_rows(Snapshot(spark, root))


@query("mart_rebuild", BOTH, f"SELECT * FROM ({_mart_sql('TRUE', 'TRUE')})")
def mart_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """All additive marts, merged from the partials of all batches and published as one version."""
    root = filled_store(spark, d)
    warehouse.rebuild_marts(spark, root)
    return _mart_rows(Snapshot(spark, root))


WITHOUT = "year(order_date) <> 1998", "year(review_date) <> 1999"


@query(
    "batch_rollback",
    BOTH,
    f"SELECT 'star' AS layer, dimension AS mart, key AS category, name, part, day AS month, NULL::DOUBLE AS total, NULL::DOUBLE AS amount, NULL::BIGINT AS n "
    f"FROM ({_star_sql(*WITHOUT, corrected=False)}) UNION ALL SELECT 'mart', mart, category, NULL, NULL, month, total, amount, n FROM ({_mart_sql(*WITHOUT, corrected=False)})",
)
def batch_rollback(spark: SparkSession, d: str) -> DataFrame:
    """Take back a year of sales, a correction that had replaced orders of another batch, and a year of reviews.

    The orders that were corrected count as they were first loaded. Partials are merged again; no fact is read.
    """
    root = filled_store(spark, d)
    with rolled_back(spark, root, sales=["sales-1998", CORRECTION], reviews=["reviews-1999"]):
        warehouse.rebuild_marts(spark, root)
    seen = Snapshot(spark, root)
    star = _star_rows(seen).select(
        F.lit("star").alias("layer"), F.col("dimension").alias("mart"), F.col("key").alias("category"), "name", "part", F.col("day").alias("month"),
        F.lit(None).cast("double").alias("total"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("bigint").alias("n"),
    )
    none = F.lit(None).cast("string")
    return star.unionByName(
        _mart_rows(seen).select(F.lit("mart").alias("layer"), "mart", "category", none.alias("name"), none.alias("part"), "month", "total", "amount", "n")
    )


@query("read_during_rebuild", BOTH, f"SELECT * FROM ({_mart_sql('TRUE', 'TRUE')})")
def read_during_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """What readers see while a rebuild without two batches is broken off half-way: the version before, whole."""
    root = filled_store(spark, d)
    warehouse.rebuild_marts(spark, root)
    with rolled_back(spark, root, sales=["sales-1998"], reviews=["reviews-1999"]):
        broken = Rebuild(spark, root)
        sales = warehouse.merged_sales(spark, root, warehouse.active_batches(spark, root, "sales"))
        broken.save(marts.sales_growth(sales["day_category"]), "sales_growth")
        broken.save(sales["day_category"].drop("batch_id"), "sales_days")
    return _mart_rows(Snapshot(spark, root))  # nothing of the broken version has been published
