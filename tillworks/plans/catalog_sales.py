"""Registered queries: star schema, sales marts and sales dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.functions.scalars import category_key, compact_key, to_money_or_null, without_spaces
from tillworks.operators import cleaning, dimensions, marts
from tillworks.plans import dashboards as dash
from tillworks.plans.oracle_views import KEY, MONTH, STANDARD, pct
from tillworks.plans.registry import query
from tillworks.plans.rollup import sales_for
from tillworks.session import fresh_path
from tillworks.sources import files, tables
from tillworks.sources.star_views import customers, products, read_table, review_docs, review_events, sales_lines

SL = ("sales_lines",)


def fact(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    return sales_lines(spark, d, "order_date", "sales", "profit", *extra)


def days(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """Totals to add up: of the stored rollup, which has what the dashboards below ask for."""
    return sales_for(spark, d, "order_date", "sales", "profit", *extra)


def key_sales(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose customer id is the surrogate key, as the clean step makes it."""
    return sales_lines(spark, d, "customer_key", "customer_name", "city", "order_date").withColumnRenamed(
        "customer_key", "customer_id"
    )


def customer_dim(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).select(F.col("c_custkey").cast("string").alias("customer_id"), "customer_name")


def product_dim(spark: SparkSession, d: str) -> DataFrame:
    return dimensions.product_dimension(products(spark, d))


# --- sources --------------------------------------------------------------


@query(
    "csv_sales_load",
    SL,
    """SELECT category, city, count(*) AS n_rows, CAST(sum(round(sales, 2)) AS DOUBLE) AS sales,
  CAST(sum(discount) AS DOUBLE) AS discount, CAST(sum(round(profit, 2)) AS DOUBLE) AS profit,
  min(order_date) AS first_order, max(order_date) AS last_order,
  count(DISTINCT customer_key) AS customers, count(DISTINCT product_id) AS products, 'batch-1' AS batch_id
FROM sales_lines GROUP BY category, city""",
)
def csv_sales_load(spark: SparkSession, d: str) -> DataFrame:
    """All sales lines through a CSV file: write, scan, check, rename, type, key."""
    names = {v: k for k, v in files.headers_of("sales").items()}
    rows = sales_lines(
        spark, d, "order_id", "customer_name", "category", "subcategory", "city", "region",
        "order_date", "sales", "discount", "profit",
    ).withColumns(
        {
            "province": F.col("region"),
            "sales": F.round("sales", 2),
            "profit": F.round("profit", 2),
        }
    )
    path = fresh_path(spark, "sales-csv")
    rows.select(*[F.col(c).alias(h) for c, h in names.items()]).write.option("header", True).csv(path)
    clean = cleaning.clean_sales(files.read_upload(spark, path, "sales", "batch-1"))
    return clean.groupBy("category", "city", "batch_id").agg(
        F.count("*").alias("n_rows"),
        *[F.sum(c).cast("double").alias(c) for c in ("sales", "discount", "profit")],
        F.min("order_date").alias("first_order"),
        F.max("order_date").alias("last_order"),
        F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("product_id").alias("products"),
    )


@query(
    "csv_reviews_load",
    ("review_docs", "cleaned_docs"),
    f"""SELECT {KEY.format('r.category')} AS category, count(*) AS n_rows,
  count(nullif(trim(r.review_text), '')) AS with_text, sum(r.review_score)::BIGINT AS score_points,
  min(r.review_date) AS first_review, max(r.review_date) AS last_review,
  sum(length(c.clean_review_text))::BIGINT AS clean_length
FROM review_docs r JOIN cleaned_docs c USING (review_id) GROUP BY 1""",
)
def csv_reviews_load(spark: SparkSession, d: str) -> DataFrame:
    """All written reviews through a CSV file with quoted, multi-line texts."""
    from tillworks.functions.scalars import clean_text

    docs = review_docs(spark, d)
    seconds = F.unix_date("review_date").cast("bigint") * 86400
    rows = docs.select(
        F.concat_ws(" ", "category", "vec_id").alias("productId"),
        F.col("category").alias("Title"),
        F.col("review_id").cast("string").alias("userId"),
        seconds.alias("Time"),
        F.col("review_score").alias("Score"),
        F.col("review_text").alias("Text"),
        F.col("category").alias("Cat1"),
        F.col("category").alias("Cat2"),
        F.col("category").alias("Cat3"),
    )
    path = fresh_path(spark, "reviews-csv")
    files.write_csv(rows, path)
    raw = files.read_upload(spark, path, "reviews", "batch-1")
    clean = cleaning.clean_reviews(raw, years=None, excluded=None)
    return clean.groupBy("category").agg(
        F.count("*").alias("n_rows"),
        F.count("review_text").alias("with_text"),
        F.sum("review_score").alias("score_points"),
        F.min("review_date").alias("first_review"),
        F.max("review_date").alias("last_review"),
        F.sum(F.length(clean_text("review_text"))).alias("clean_length"),
    )


UPLOADS = 5
LACKED = list(enumerate(files.headers_of("sales")))


@query(
    "missing_headers",
    (),
    f"""SELECT 'region-' || r_regionkey AS upload, h.header AS missing
FROM region JOIN (VALUES {", ".join(f"({place}, '{header}')" for place, header in LACKED)}) h(place, header) ON h.place % {UPLOADS} = r_regionkey""",
)
def missing_headers(spark: SparkSession, d: str) -> DataFrame:
    """One upload of all orders per region, each without every fifth required column; what every file lacks."""
    orders = read_table(spark, d, "orders")
    path = fresh_path(spark, "uploads")
    for key in sorted(r["r_regionkey"] for r in read_table(spark, d, "region").select("r_regionkey").collect()):
        kept = [F.col("o_orderkey").cast("string").alias(header) for place, header in LACKED if place % UPLOADS != key]
        files.write_csv(orders.select(*kept), f"{path}/region-{key}")
    found = files.missing_headers(spark, path, "sales")
    return found.select(F.regexp_extract("file", "(region-[0-9]+)/", 1).alias("upload"), "missing").distinct()


@query(
    "load_summary",
    SL,
    """SELECT 'sales-1998' AS batch_id, count(*) FILTER (WHERE year(order_date) = 1998) AS rows_inserted,
  count(*) AS table_total_rows FROM sales_lines""",
)
def load_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = sales_lines(spark, d, "order_date").select(
        F.concat(F.lit("sales-"), F.year("order_date")).alias("batch_id")
    )
    return files.load_summary(lines, "sales-1998")


@query(
    "batch_scan",
    SL,
    """SELECT category, count(*) AS n_rows, CAST(sum(sales) AS DOUBLE) AS sales
FROM sales_lines WHERE year(order_date) = 1999 GROUP BY category""",
)
def batch_scan(spark: SparkSession, d: str) -> DataFrame:
    """Append all lines by batch, then read one batch; its folder alone is scanned."""
    path = fresh_path(spark, "raw-sales")
    tables.append_rows(_batched(spark, d), path)
    rows = tables.read_batch(spark, path, "sales-1999")
    return rows.groupBy("category").agg(
        F.count("*").alias("n_rows"), F.sum("sales").cast("double").alias("sales")
    )


def _batched(spark: SparkSession, d: str) -> DataFrame:
    lines = fact(spark, d, "order_id", "category")
    return lines.withColumn("batch_id", F.concat(F.lit("sales-"), F.year("order_date")))


@query(
    "batch_ledger_current",
    (),
    """SELECT batch_id, status, n_events FROM (
  SELECT CAST(user_id AS VARCHAR) AS batch_id, event_type AS status,
    count(*) OVER (PARTITION BY user_id) AS n_events,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
  FROM events) WHERE n = 1""",
)
def batch_ledger_current(spark: SparkSession, d: str) -> DataFrame:
    """Current status per batch; the event log stands in for the status log."""
    events = read_table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("batch_id"),
        F.col("event_type").alias("status"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("status_no"),
    )
    return tables.current_status(events)


@query(
    "data_presence",
    ("sales_lines", "review_events"),
    """SELECT (SELECT count(*) > 0 FROM sales_lines) AS has_sales, (SELECT count(*) > 0 FROM review_events) AS has_reviews""",
)
def data_presence(spark: SparkSession, d: str) -> DataFrame:
    """Whether there are sales and reviews; one row of each is enough to know."""
    one = F.lit(1).alias("one")
    sold = sales_lines(spark, d, "order_id").limit(1).agg(F.count("*") > 0).scalar()
    rated = read_table(spark, d, "events").select(one).limit(1)
    return rated.agg((F.count("*") > 0).alias("has_reviews")).select(sold.alias("has_sales"), "has_reviews")


@query(
    "file_preview",
    (),
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus
FROM orders ORDER BY orders.o_orderkey LIMIT 20""",
)
def file_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of a CSV upload, by order number; values are text as in the file."""
    path = fresh_path(spark, "orders-csv")
    files.write_csv(read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path)
    rows = files.scan_csv(spark, path, multi_line=False)
    return files.preview(rows.orderBy(F.col("o_orderkey").cast("bigint")), 20)


# --- cleaning -------------------------------------------------------------


@query(
    "clean_sales_keys",
    SL,
    f"""SELECT customer_key, product_id, category_key, sales_month, count(*) AS n_lines,
  CAST(sum(sales) AS DOUBLE) AS sales FROM sales_lines GROUP BY customer_key, product_id, category_key, sales_month""",
)
def clean_sales_keys(spark: SparkSession, d: str) -> DataFrame:
    lines = sales_lines(spark, d, "customer_key", "product_id", "category_key", "sales_month", "sales")
    return lines.groupBy("customer_key", "product_id", "category_key", "sales_month").agg(
        F.count("*").alias("n_lines"), F.sum("sales").cast("double").alias("sales")
    )


@query(
    "coerced_values",
    (),
    """SELECT l_returnflag, count(try_cast(l_shipdate_text AS DATE)) AS valid_dates,
  CAST(sum(try_cast(price_text AS DECIMAL(18,2))) AS DOUBLE) AS price, count(try_cast(price_text AS DECIMAL(18,2))) AS valid_prices
FROM (SELECT l_returnflag, CASE WHEN l_linenumber = 3 THEN 'not a date' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS l_shipdate_text,
             CASE WHEN l_linenumber = 5 THEN 'n/a' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS price_text FROM lineitem)
GROUP BY l_returnflag""",
)
def coerced_values(spark: SparkSession, d: str) -> DataFrame:
    """Dates and amounts from text, with unreadable values as NULL."""
    from tillworks.functions.scalars import to_date_or_null

    line = F.col("l_linenumber")
    text = read_table(spark, d, "lineitem").select(
        "l_returnflag",
        F.when(line == 3, "not a date").otherwise(F.col("l_shipdate").cast("date").cast("string")).alias("day"),
        F.when(line == 5, "n/a").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("price"),
    )
    typed = text.select("l_returnflag", to_date_or_null("day").alias("day"), to_money_or_null("price").alias("price"))
    return typed.groupBy("l_returnflag").agg(
        F.count("day").alias("valid_dates"),
        F.sum("price").cast("double").alias("price"),
        F.count("price").alias("valid_prices"),
    )


@query(
    "standard_categories",
    (),
    f"""SELECT {STANDARD.format("concat(' ', p_type, ' &  ', p_brand, ', ', p_name, ' ')")} AS category_key,
  {KEY.format("concat(p_type, ' - ', p_brand, '_', p_name)")} AS compact_key,
  {KEY.format('p_name')} AS no_spaces, count(*) AS n FROM part GROUP BY 1, 2, 3""",
)
def standard_categories(spark: SparkSession, d: str) -> DataFrame:
    messy = F.concat(F.lit(" "), "p_type", F.lit(" &  "), "p_brand", F.lit(", "), "p_name", F.lit(" "))
    dashed = F.concat("p_type", F.lit(" - "), "p_brand", F.lit("_"), "p_name")
    return (
        read_table(spark, d, "part")
        .select(
            category_key(messy).alias("category_key"),
            compact_key(dashed).alias("compact_key"),
            without_spaces("p_name").alias("no_spaces"),
        )
        .groupBy("category_key", "compact_key", "no_spaces")
        .agg(F.count("*").alias("n"))
    )


@query(
    "epoch_dates",
    (),
    f"""SELECT day, day + 2557 AS shifted_day, {MONTH.format('day')} AS month, n FROM (
  SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)""",
)
def epoch_dates(spark: SparkSession, d: str) -> DataFrame:
    """Epoch seconds to dates, with the usual and with the shifted origin."""
    from tillworks.functions.lookups import REVIEW_EPOCH_ORIGIN
    from tillworks.functions.scalars import epoch_to_date, month_start

    ts = F.col("ts").cast("timestamp_ntz")
    seconds = F.unix_date(ts.cast("date")).cast("bigint") * 86400 + F.hour(ts) * 3600
    counted = read_table(spark, d, "events").select(seconds.alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    return (
        counted.select(
            epoch_to_date("s").alias("day"), epoch_to_date("s", REVIEW_EPOCH_ORIGIN).alias("shifted_day"), "n"
        )
        .groupBy("day", "shifted_day", month_start("day").alias("month"))
        .agg(F.sum("n").alias("n"))
    )


@query(
    "duplicate_orders",
    SL,
    "SELECT order_id, count(*) AS n_rows FROM sales_lines GROUP BY order_id HAVING count(*) > 1",
)
def duplicate_orders(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.duplicate_orders(sales_lines(spark, d, "order_id"))


# --- dimensions -----------------------------------------------------------


@query(
    "dim_customer_first_visit",
    SL,
    f"""SELECT customer_key AS customer_id, customer_name, city, {MONTH.format('order_date')} AS first_month FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY order_date NULLS LAST, customer_name, city) AS n FROM sales_lines)
WHERE n = 1""",
)
def dim_customer_first_visit(spark: SparkSession, d: str) -> DataFrame:
    return dimensions.customer_dimension(key_sales(spark, d))


@query(
    "dim_product",
    SL,
    """SELECT product_id, category, subcategory FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY category, subcategory) AS n FROM sales_lines) WHERE n = 1""",
)
def dim_product(spark: SparkSession, d: str) -> DataFrame:
    return dimensions.product_dimension(sales_lines(spark, d, "product_id", "category", "subcategory"))


@query(
    "dim_month_union",
    ("sales_lines", "review_events"),
    f"""SELECT month_start, CAST(year(month_start) AS INTEGER) AS year, CAST(month(month_start) AS INTEGER) AS month_number,
  strftime(month_start, '%B') AS month_name, strftime(month_start, '%Y-%m') AS year_month
FROM (SELECT sales_month AS month_start FROM sales_lines UNION SELECT {MONTH.format('review_date')} FROM review_events)
WHERE month_start IS NOT NULL""",
)
def dim_month_union(spark: SparkSession, d: str) -> DataFrame:
    sold = sales_lines(spark, d, "sales_month")
    rated = review_events(spark, d, "review_date").select(F.trunc("review_date", "MM"))
    return dimensions.month_dimension(sold, rated)


@query(
    "dim_month_except",
    ("sales_lines", "review_events"),
    f"""SELECT sales_month AS month_start FROM sales_lines EXCEPT SELECT {MONTH.format('review_date')} FROM review_events""",
)
def dim_month_except(spark: SparkSession, d: str) -> DataFrame:
    sold = sales_lines(spark, d, "sales_month").toDF("month_start")
    rated = review_events(spark, d, "review_date").select(F.trunc("review_date", "MM"))
    return dimensions.missing_values(sold, rated)


@query(
    "dim_date",
    SL,
    "SELECT DISTINCT order_date AS sales_date FROM sales_lines WHERE order_date IS NOT NULL",
)
def dim_date(spark: SparkSession, d: str) -> DataFrame:
    return dimensions.date_dimension(sales_lines(spark, d, "order_date"))


@query(
    "dim_anti_insert",
    SL,
    """SELECT customer_id, min(order_date) AS first_order, 'kept' AS origin FROM sales_lines
WHERE order_date < DATE '1998-01-01' GROUP BY customer_id
UNION ALL
SELECT customer_id, min(order_date), 'added' FROM sales_lines s WHERE order_date >= DATE '1998-01-01'
  AND NOT EXISTS (SELECT 1 FROM sales_lines p WHERE p.customer_id = s.customer_id AND p.order_date < DATE '1998-01-01')
GROUP BY customer_id""",
)
def dim_anti_insert(spark: SparkSession, d: str) -> DataFrame:
    """A later batch adds only customers the dimension does not hold."""
    lines = sales_lines(spark, d, "customer_id", "order_date")
    early = F.col("order_date") < F.lit("1998-01-01").cast("date")

    def first_orders(rows: DataFrame, origin: str) -> DataFrame:
        return rows.groupBy("customer_id").agg(F.min("order_date").alias("first_order")).withColumn("origin", F.lit(origin))

    return dimensions.upsert_new(first_orders(lines.filter(early), "kept"), first_orders(lines.filter(~early), "added"), "customer_id")


@query(
    "orphan_dimension_cleanup",
    (),
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
)
def orphan_dimension_cleanup(spark: SparkSession, d: str) -> DataFrame:
    customer = read_table(spark, d, "customer").select("c_custkey", "c_name")
    return dimensions.drop_orphans(customer, read_table(spark, d, "orders"), "c_custkey", "o_custkey")


# --- marts ----------------------------------------------------------------


@query(
    "sales_growth_monthly",
    SL,
    """SELECT sales_month, CAST(total_sales AS DOUBLE) AS total_sales, CAST(total_profit AS DOUBLE) AS total_profit,
  (CAST(total_sales AS DOUBLE) - p_sales) / nullif(p_sales, 0) AS sales_growth,
  (CAST(total_profit AS DOUBLE) - p_profit) / nullif(p_profit, 0) AS profit_growth
FROM (SELECT *, CAST(lag(total_sales) OVER (ORDER BY sales_month) AS DOUBLE) AS p_sales,
             CAST(lag(total_profit) OVER (ORDER BY sales_month) AS DOUBLE) AS p_profit
      FROM (SELECT sales_month, sum(sales) AS total_sales, sum(profit) AS total_profit FROM sales_lines GROUP BY sales_month))""",
)
def sales_growth_monthly(spark: SparkSession, d: str) -> DataFrame:
    return marts.sales_growth(fact(spark, d))


@query(
    "new_customers_monthly",
    SL,
    f"""SELECT first_month, count(*) AS new_customers FROM (
  SELECT customer_key, {MONTH.format('min(order_date)')} AS first_month FROM sales_lines GROUP BY customer_key)
GROUP BY first_month""",
)
def new_customers_monthly(spark: SparkSession, d: str) -> DataFrame:
    return marts.new_customers(dimensions.customer_dimension(key_sales(spark, d)))


@query(
    "category_transactions_monthly",
    ("category_months",),
    "SELECT category, sales_month, CAST(total_sales AS DOUBLE) AS total_sales, total_transactions FROM category_months",
)
def category_transactions_monthly(spark: SparkSession, d: str) -> DataFrame:
    return marts.category_transactions(fact(spark, d, "category"))


# --- dashboards -----------------------------------------------------------

TOTALS = "CAST(sum(sales) AS DOUBLE) AS sales, CAST(sum(profit) AS DOUBLE) AS profit"
DAYS = "year(order_date) IN (1997, 1999) AND month(order_date) IN (2, 3, 11) AND day(order_date) <= 15"
FILTER = {"years": [1997, 1999], "months": [2, 3, 11], "days": list(range(1, 16))}
MONTHS = "year(order_date) IN (1998, 1999) AND month(order_date) IN (1, 2, 6)"
PERIOD = {"years": [1998, 1999], "months": [1, 2, 6]}


@query(
    "quarterly_sales",
    SL,
    f"""SELECT CAST(year(order_date) AS INTEGER) AS year, CAST(quarter(order_date) AS INTEGER) AS quarter, {TOTALS}
FROM sales_lines GROUP BY 1, 2""",
)
def quarterly_sales(spark: SparkSession, d: str) -> DataFrame:
    return dash.quarterly_sales(days(spark, d))


MARGIN = pct("sum(profit)", "sum(sales)")


@query(
    "yearly_margin",
    SL,
    f"""SELECT CAST(year(order_date) AS INTEGER) AS year, CAST(sum(sales) AS DOUBLE) AS revenue,
  CAST(sum(profit) AS DOUBLE) AS profit, {MARGIN} AS margin, 0 AS is_total FROM sales_lines GROUP BY 1
UNION ALL SELECT NULL, CAST(sum(sales) AS DOUBLE), CAST(sum(profit) AS DOUBLE), {MARGIN}, 1 FROM sales_lines""",
)
def yearly_margin(spark: SparkSession, d: str) -> DataFrame:
    return dash.yearly_margin(days(spark, d))


@query(
    "top_products_profit",
    SL,
    """SELECT product_id, CAST(p AS DOUBLE) AS profit, CAST(n AS INTEGER) AS rank FROM (
  SELECT product_id, sum(profit) AS p, row_number() OVER (ORDER BY sum(profit) DESC, product_id) AS n
  FROM sales_lines GROUP BY product_id) WHERE n <= 5""",
)
def top_products_profit(spark: SparkSession, d: str) -> DataFrame:
    return dash.top_products_by_profit(sales_lines(spark, d, "product_id", "profit"))


@query(
    "top_products_txn",
    SL,
    """SELECT product_id, transactions, CAST(n AS INTEGER) AS rank FROM (
  SELECT product_id, count(*) AS transactions, row_number() OVER (ORDER BY count(*) DESC, product_id) AS n
  FROM sales_lines GROUP BY product_id) WHERE n <= 5""",
)
def top_products_txn(spark: SparkSession, d: str) -> DataFrame:
    return dash.top_products_by_transactions(sales_lines(spark, d, "product_id"))


def _top_customers_sql(n: int, where: str = "TRUE") -> str:
    return f"""SELECT customer_name, transactions, CAST(n AS INTEGER) AS rank FROM (
  SELECT customer_name, count(order_id) AS transactions, row_number() OVER (ORDER BY count(order_id) DESC, customer_name) AS n
  FROM sales_lines WHERE {where} GROUP BY customer_name) WHERE n <= {n}"""


@query("top_customers", SL, _top_customers_sql(5))
def top_customers(spark: SparkSession, d: str) -> DataFrame:
    lines = sales_lines(spark, d, "customer_id", "order_id", "order_date")
    return dash.top_customers(lines, customer_dim(spark, d))


@query("top_customers_period", SL, _top_customers_sql(7, MONTHS))
def top_customers_period(spark: SparkSession, d: str) -> DataFrame:
    lines = sales_lines(spark, d, "customer_id", "order_id", "order_date")
    return dash.top_customers(lines, customer_dim(spark, d), 7, **PERIOD)


@query(
    "top_subcategories_profit",
    SL,
    f"""SELECT subcategory, CAST(p AS DOUBLE) AS profit, CAST(n AS INTEGER) AS rank FROM (
  SELECT subcategory, sum(profit) AS p, row_number() OVER (ORDER BY sum(profit) DESC, subcategory) AS n
  FROM sales_lines WHERE {MONTHS} GROUP BY subcategory) WHERE n <= 7""",
)
def top_subcategories_profit(spark: SparkSession, d: str) -> DataFrame:
    lines = sales_lines(spark, d, "product_id", "order_date", "profit")
    return dash.top_subcategories_by_profit(lines, product_dim(spark, d), **PERIOD)


@query(
    "top_subcategories_txn",
    SL,
    f"""SELECT subcategory, transactions, CAST(n AS INTEGER) AS rank FROM (
  SELECT subcategory, count(product_id) AS transactions, row_number() OVER (ORDER BY count(product_id) DESC, subcategory) AS n
  FROM sales_lines WHERE {MONTHS} GROUP BY subcategory) WHERE n <= 7""",
)
def top_subcategories_txn(spark: SparkSession, d: str) -> DataFrame:
    lines = sales_lines(spark, d, "product_id", "order_date")
    return dash.top_subcategories_by_transactions(lines, product_dim(spark, d), **PERIOD)


@query(
    "sales_filter_options",
    SL,
    """SELECT DISTINCT 'year' AS option, CAST(year(order_date) AS INTEGER) AS value, CAST(year(order_date) AS VARCHAR) AS label FROM sales_lines
UNION ALL SELECT DISTINCT 'month', CAST(month(order_date) AS INTEGER), strftime(order_date, '%B') FROM sales_lines WHERE year(order_date) IN (1998, 2000)
UNION ALL SELECT DISTINCT 'day', CAST(day(order_date) AS INTEGER), CAST(day(order_date) AS VARCHAR) FROM sales_lines
  WHERE year(order_date) IN (1998, 2000) AND month(order_date) IN (2, 7)
UNION ALL SELECT 'default_year', CAST(year(max(order_date)) AS INTEGER), CAST(year(max(order_date)) AS VARCHAR) FROM sales_lines
UNION ALL SELECT 'default_month', CAST(month(max(order_date)) AS INTEGER), CAST(month(max(order_date)) AS VARCHAR) FROM sales_lines
UNION ALL SELECT 'default_day', CAST(day(max(order_date)) AS INTEGER), CAST(day(max(order_date)) AS VARCHAR) FROM sales_lines""",
)
def sales_filter_options(spark: SparkSession, d: str) -> DataFrame:
    return dash.sales_filter_options(sales_for(spark, d, "order_date"), [1998, 2000], [2, 7])


@query(
    "category_summary_filtered",
    SL,
    f"""SELECT category, {TOTALS}, count(*) AS transactions, 0 AS is_total FROM sales_lines WHERE {DAYS} GROUP BY category
UNION ALL SELECT NULL, {TOTALS}, count(*), 1 FROM sales_lines WHERE {DAYS}""",
)
def category_summary_filtered(spark: SparkSession, d: str) -> DataFrame:
    return dash.category_summary(days(spark, d, "category", "lines"), **FILTER)


@query(
    "category_summary_all",
    SL,
    f"""SELECT category, {TOTALS}, count(*) AS transactions, 0 AS is_total FROM sales_lines GROUP BY category
UNION ALL SELECT NULL, {TOTALS}, count(*), 1 FROM sales_lines""",
)
def category_summary_all(spark: SparkSession, d: str) -> DataFrame:
    return dash.category_summary(days(spark, d, "category", "lines"))


@query(
    "avg_transaction",
    SL,
    f"SELECT round_even(CAST(sum(sales) AS DOUBLE) / count(*), 2) AS avg_transaction_value FROM sales_lines WHERE {DAYS}",
)
def avg_transaction(spark: SparkSession, d: str) -> DataFrame:
    return dash.avg_transaction(days(spark, d, "lines"), **FILTER)


@query(
    "orders_by_category",
    SL,
    f"SELECT category, count(*) AS transactions FROM sales_lines WHERE {DAYS} GROUP BY category",
)
def orders_by_category(spark: SparkSession, d: str) -> DataFrame:
    return dash.orders_by_category(days(spark, d, "category", "lines"), **FILTER)


@query(
    "sales_by_category",
    SL,
    f"SELECT category, CAST(sum(sales) AS DOUBLE) AS sales FROM sales_lines WHERE {DAYS} GROUP BY category",
)
def sales_by_category(spark: SparkSession, d: str) -> DataFrame:
    return dash.sales_by_category(days(spark, d, "category"), **FILTER)


@query(
    "profit_by_category",
    SL,
    f"SELECT category, CAST(sum(profit) AS DOUBLE) AS profit FROM sales_lines WHERE {DAYS} GROUP BY category",
)
def profit_by_category(spark: SparkSession, d: str) -> DataFrame:
    return dash.profit_by_category(days(spark, d, "category"), **FILTER)


@query(
    "day_of_month_series",
    SL,
    f"SELECT CAST(day(order_date) AS INTEGER) AS day, {TOTALS} FROM sales_lines WHERE {MONTHS} GROUP BY 1",
)
def day_of_month_series(spark: SparkSession, d: str) -> DataFrame:
    return dash.day_of_month_series(days(spark, d), **PERIOD)


KPIS = f"""SELECT coalesce(CAST(round(sum(sales), 2) AS DOUBLE), 0.0) AS total_revenue,
  coalesce(CAST(round(sum(profit), 2) AS DOUBLE), 0.0) AS total_profit,
  coalesce({pct('sum(profit)', 'sum(sales)')}, 0.0) AS profit_margin,
  count(DISTINCT customer_id) AS customer_visit FROM sales_lines"""


@query("period_kpis", SL, f"{KPIS} WHERE {MONTHS}")
def period_kpis(spark: SparkSession, d: str) -> DataFrame:
    return dash.period_kpis(fact(spark, d, "customer_id"), **PERIOD)


@query("overall_kpis", SL, KPIS)
def overall_kpis(spark: SparkSession, d: str) -> DataFrame:
    return dash.period_kpis(fact(spark, d, "customer_id"))


@query(
    "comparison_options",
    SL,
    """SELECT 'year' AS option, y AS value, CAST(y AS VARCHAR) AS label FROM (SELECT DISTINCT CAST(year(order_date) AS INTEGER) AS y FROM sales_lines)
UNION ALL SELECT DISTINCT 'month', CAST(month(order_date) AS INTEGER), strftime(order_date, '%B') FROM sales_lines
UNION ALL SELECT 'default_year2', y, CAST(y AS VARCHAR) FROM (SELECT CAST(max(year(order_date)) AS INTEGER) AS y FROM sales_lines)
UNION ALL SELECT 'default_year1', y, CAST(y AS VARCHAR) FROM (SELECT CAST(min(y) AS INTEGER) AS y FROM
  (SELECT DISTINCT year(order_date) AS y FROM sales_lines ORDER BY y DESC LIMIT 2))""",
)
def comparison_options(spark: SparkSession, d: str) -> DataFrame:
    return dash.comparison_options(sales_for(spark, d, "order_date"))


def _pair(value: str, i: int, when: str) -> str:
    return f"coalesce(CAST(round(sum({value}) FILTER (WHERE {when}), 2) AS DOUBLE), 0.0) AS {value}_{i}"


@query(
    "compare_yoy",
    SL,
    f"""SELECT CAST(month(order_date) AS INTEGER) AS month, strftime(order_date, '%B') AS label,
  {', '.join(_pair(v, i, f'year(order_date) = {y}') for i, y in ((1, 1998), (2, 1999)) for v in ('sales', 'profit'))}
FROM sales_lines WHERE year(order_date) IN (1998, 1999) GROUP BY 1, 2""",
)
def compare_yoy(spark: SparkSession, d: str) -> DataFrame:
    return dash.compare_years(days(spark, d), 1998, 1999)


@query(
    "compare_mom",
    SL,
    f"""SELECT CAST(day(order_date) AS INTEGER) AS day,
  {', '.join(_pair(v, i, f'year(order_date) = {y} AND month(order_date) = {m}') for i, (y, m) in ((1, (1998, 2)), (2, (1998, 3))) for v in ('sales', 'profit'))}
FROM sales_lines WHERE year(order_date) = 1998 AND month(order_date) IN (2, 3) GROUP BY 1""",
)
def compare_mom(spark: SparkSession, d: str) -> DataFrame:
    return dash.compare_months(days(spark, d), (1998, 2), (1998, 3))


@query(
    "share_of_total",
    SL,
    """SELECT category, CAST(s AS DOUBLE) AS sales,
  round_even(CAST(s AS DOUBLE) * 100.0 / sum(CAST(s AS DOUBLE)) OVER (), 1) AS share_pct
FROM (SELECT category, sum(sales) AS s FROM sales_lines GROUP BY category)""",
)
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return dash.share_of_total(dash.sales_by_category(days(spark, d, "category")), "sales")


@query(
    "table_totals",
    SL,
    """SELECT category, subcategory, CAST(sum(sales) AS DOUBLE) AS sales, count(*) AS transactions
FROM sales_lines GROUP BY ROLLUP (category, subcategory)""",
)
def table_totals(spark: SparkSession, d: str) -> DataFrame:
    """Table rows with subtotals and a grand total, rolled up from grouped rows."""
    rows = sales_lines(spark, d, "category", "subcategory", "sales").groupBy("category", "subcategory").agg(
        F.sum("sales").alias("s"), F.count("*").alias("n")
    )
    rolled = rows.rollup("category", "subcategory").agg(F.sum("s").alias("sales"), F.sum("n").alias("transactions"))
    return rolled.withColumn("sales", F.col("sales").cast("double"))
