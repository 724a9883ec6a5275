"""Business frames over the given tables.

``sales_lines``   one row per order line, with its customer and product keys
``review_events`` one rating per event
``review_docs``   one written review per document
``vectors`` / ``topic_vectors`` / ``lexicon`` inputs of the text jobs

Each builder takes the columns the caller needs and joins only the dimensions
those columns come from. Every line has its order, customer and product (the
clean step drops orphans), so a skipped inner join changes no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.functions import lookups
from tillworks.functions.scalars import (
    category_key,
    compact_key,
    month_start,
)
from tillworks.operators.text import exploded_words

REVIEW_START = "1998-01-01"
REVIEW_DAYS = 1096
TEST_TOPIC_THRESHOLD = 0.10


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sales ----------------------------------------------------------------

PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
LINE = {
    "order_id": "CAST(l_orderkey AS STRING)",
    "line_number": "l_linenumber",
    "sales": f"{PRICE} * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))",
    "discount": "CAST(l_discount AS DECIMAL(4,2))",
    "profit": f"{PRICE} * (CAST(0.06 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))",
}
ORDER = {
    "customer_id": "CAST(o_custkey AS STRING)",
    "order_date": "CAST(o_orderdate AS DATE)",
}
CUSTOMER = ("customer_name", "city", "region", "customer_key")
PRODUCT = ("category", "subcategory", "product_raw", "product_id", "category_key")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").join(
        read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        read_table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey",
            F.col("c_name").alias("customer_name"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("region"),
            compact_key("c_name", "n_name").alias("customer_key"),
        )
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product keys are derived here, once per product instead of once per line."""
    return read_table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.concat("p_type", "p_brand").alias("product_raw"),
        compact_key("p_type", "p_brand").alias("product_id"),
        category_key("p_type").alias("category_key"),
    )


def sales_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    need_order = any(c in ORDER or c in CUSTOMER or c == "sales_month" for c in columns)
    if need_order:
        orders = read_table(spark, sf_dir, "orders")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if any(c in CUSTOMER for c in columns):
        lines = lines.join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    if any(c in PRODUCT for c in columns):
        lines = lines.join(products(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))

    def expression(name: str) -> Column:
        if name == "sales_month":
            return month_start(F.expr(ORDER["order_date"])).alias(name)
        if name in LINE or name in ORDER:
            return F.expr({**LINE, **ORDER}[name]).alias(name)
        return F.col(name)

    return lines.select(*[expression(c) for c in columns])


# --- ratings --------------------------------------------------------------


def _with_part(
    rows: DataFrame, spark: SparkSession, sf_dir: str, id_col: str, *part_columns: str
) -> DataFrame:
    parts = read_table(spark, sf_dir, "part")
    n_parts = parts.agg(F.count("*")).scalar()
    return rows.withColumn("part_key", F.col(id_col) % n_parts).join(
        parts.select("p_partkey", *part_columns), F.col("part_key") == F.col("p_partkey")
    )


def _spread_date(id_col: str) -> Column:
    return F.date_add(F.lit(REVIEW_START).cast("date"), (F.col(id_col) % REVIEW_DAYS).cast("int"))


def review_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("review_id"),
        F.col("user_id").cast("string").alias("user_id"),
        _spread_date("event_id").alias("review_date"),
        (F.lit(1) + F.floor("value").cast("int") % 5).cast("int").alias("review_score"),
    )
    joined = _with_part(events, spark, sf_dir, "review_id", "p_brand", "p_name", "p_type")
    derived = joined.select(
        "review_id",
        "user_id",
        "review_date",
        "review_score",
        F.concat("p_brand", "p_name").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.col("p_name").alias("product_type"),
    )
    return derived.select(*columns) if columns else derived


# --- written reviews ------------------------------------------------------


def read_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier and text of the written reviews; nothing is joined to them."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), F.col("text").alias("review_text"))


def review_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written reviews without their texts."""
    n_vectors = read_table(spark, sf_dir, "embeddings").agg(F.count("*")).scalar()
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"),
        _spread_date("doc_id").alias("review_date"),
        (F.lit(1) + F.col("n_chars") % 5).cast("int").alias("review_score"),
        (F.col("doc_id") % n_vectors).alias("vec_id"),
    )
    return _with_part(docs, spark, sf_dir, "review_id", "p_type").select(
        "review_id", "review_date", "review_score", F.col("p_type").alias("category"), "vec_id"
    )


def review_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written reviews; their texts are joined by identifier to the finished heads."""
    return review_heads(spark, sf_dir).join(read_docs(spark, sf_dir), "review_id").select(
        "review_id", "review_date", "review_score", "category", "review_text", "vec_id"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def topic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of labels 0..6, named after the seven topics; vectors with other labels take no part."""
    names = lookups.lookup_frame(
        spark, list(enumerate(lookups.TOPICS)), "label int, topic string"
    )
    cells = (
        read_table(spark, sf_dir, "embeddings")
        .select("label", F.posexplode("embedding").alias("dim", "value"))
        .join(F.broadcast(names), "label")
        .groupBy("label", "topic", "dim")
        .agg(F.avg("value").alias("value"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("dim", "value")))
    return cells.groupBy("label", "topic").agg(
        F.transform(ordered, lambda cell: cell["value"]).alias("vector")
    ).select(F.col("label").alias("topic_no"), "topic", "vector")


# A stand-in lexicon of words that the given texts use. Their valences go round
# STEPS by place, so the check SQL can say the same.
LEXICON_WORDS = (
    "the ci in la der is que that le on for as was be die ou an with ch des und by es et this are tion at from les un eau ment den "
    "tre zu von ein eux elle sch thatin ier orantion hehely aux ing une das ung kind"
).split()
LEXICON_STEPS = (-2.7, -1.8, -0.9, 0.9, 1.8, 2.7)
LEXICON = [(word, LEXICON_STEPS[i % len(LEXICON_STEPS)]) for i, word in enumerate(LEXICON_WORDS)]


# Frequent words of the given texts as modifiers in place of the English lists; one has a valence of its own.
RULE_MODIFIERS = [("de", 0.293, False), ("of", 0.293, False), ("to", -0.293, False), ("der", -0.293, False), ("en", 0.0, True), ("and", 0.0, True)]
RULE_CONTRAST = "that"


def lexicon(spark: SparkSession) -> DataFrame:
    """A literal of a few dozen words with their valence; it does not grow with the texts."""
    return spark.createDataFrame(LEXICON, "token string, valence double")


def text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cleaned word of the texts but the modifiers, with valence (length mod 5 - 2) * 0.9.

    It grows with the texts, so nothing may collect or broadcast it unchecked.
    """
    words = exploded_words(read_table(spark, sf_dir, "documents").select("text"), "text").distinct()
    valence = (F.length("token") % 5 - 2).cast("decimal(4,1)") * F.lit("0.9").cast("decimal(2,1)")
    plain = words.where(~F.col("token").isin([word for word, _, _ in RULE_MODIFIERS]))
    return plain.select("token", valence.cast("double").alias("valence"))
