"""Uploaded CSV files: scan, header check, renaming, batch stamp, preview."""

from __future__ import annotations

import csv
from collections.abc import Mapping
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.functions.lookups import REVIEW_HEADERS, SALES_HEADERS
from tillworks.functions.scalars import blank_to_null, finite_or_null

HEADERS = {"sales": SALES_HEADERS, "reviews": REVIEW_HEADERS}
CSV = {"escape": '"', "mode": "PERMISSIVE"}
PREVIEW_ROWS = 20
PREVIEW_LIMIT = 100


def headers_of(kind: str) -> Mapping[str, str]:
    if kind not in HEADERS:
        raise ValueError("dataset kind must be 'sales' or 'reviews'")
    return HEADERS[kind]


def scan_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as text, without a pass to infer types; typing comes later
    with try_cast.

    Files whose columns come in another order are read by their own header and
    united by name; one pass finds the headers of all files. Quoted fields of reviews span
    lines, which makes a file one task: upload many reviews as a folder of files. Sales
    files are split.
    """
    if path.rsplit("/", 1)[-1].lower().endswith((".xlsx", ".xls", ".ods", ".json")):
        raise ValueError("only .csv files or folders of them can be read")
    options = {"header": True, "multiLine": multi_line, **CSV}
    by_header: dict[tuple[str, ...], list[str]] = {}
    for columns, paths in headers_found(spark, path).values():
        by_header.setdefault(columns, []).extend(paths)
    if not by_header:
        return spark.read.options(**options).csv([path])
    parts = [spark.read.options(**options).csv(sorted(paths)) for _, paths in sorted(by_header.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line``: the first line of every file under a path, found in one pass without a task of the driver per file.

    Only the split at a file's beginning can hold it; its rows are reduced where they are read.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value"), F.monotonically_increasing_id().alias("place")
    )
    return lines.where("begin = 0").groupBy("file").agg(F.min_by("value", "place").alias("line"))


def headers_found(spark: SparkSession, path: str) -> dict[str, tuple[tuple[str, ...], list[str]]]:
    """Each distinct header line with its columns and files. A header is one line; files without lines have none.

    The driver gets one row per uploaded file and parses one line per distinct header.
    """
    by_line: dict[str, list[str]] = {}
    for row in first_lines(spark, path).collect():
        by_line.setdefault(row["line"], []).append(unquote(row["file"]))
    return {line: (_columns_of(line), sorted(paths)) for line, paths in by_line.items()}


def _columns_of(line: str) -> tuple[str, ...]:
    """Column names of a header line, as Spark's reader names them: repeated and empty ones carry their place."""
    names = next(csv.reader([line.removeprefix("\ufeff")]), [])
    seen = [n.lower() for n in names]
    return tuple(f"_c{i}" if not n else f"{n}{i}" if seen.count(n.lower()) > 1 else n for i, n in enumerate(names))


def missing_headers(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``file, missing``: the required columns that each uploaded file lacks; a row per file and column, none for a fit file.

    The lines of all files are found in one pass and compared in the cluster; only the
    distinct header lines are parsed in the driver.
    """
    wanted = list(headers_of(kind))
    lines = first_lines(spark, path)
    parsed = [(r["line"], sorted(set(wanted) - set(_columns_of(r["line"])))) for r in lines.select("line").distinct().collect()]
    lacking = spark.createDataFrame(parsed, "line string, missing array<string>")
    return lines.join(F.broadcast(lacking), "line").select("file", F.explode("missing").alias("missing"))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files that ``scan_csv`` reads back unchanged."""
    (
        df.write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def check_headers(df: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    missing = sorted(set(headers) - set(df.columns))
    if missing:
        raise ValueError(f"the upload lacks the columns {missing}")
    return df


def stamp_batch(df: DataFrame, batch_id: str) -> DataFrame:
    return df.withColumn("batch_id", F.lit(batch_id))


def nulls_for_blanks(df: DataFrame) -> DataFrame:
    """Blank text, NaN and infinities become NULL."""
    fixes = {}
    for name, kind in df.dtypes:
        if kind == "string":
            fixes[name] = blank_to_null(name)
        elif kind in ("double", "float"):
            fixes[name] = finite_or_null(name)
    return df.withColumns(fixes) if fixes else df


def raw_rows(df: DataFrame, kind: str, batch_id: str) -> DataFrame:
    """File columns -> raw table columns, in table order, with the batch id."""
    headers = headers_of(kind)
    checked = check_headers(df, headers).withColumnsRenamed(dict(headers))
    return nulls_for_blanks(stamp_batch(checked, batch_id).select(*headers.values(), "batch_id"))


def arrival() -> dict[str, Column]:
    """When a row was loaded, and its place in its batch, from which lasting ids are made."""
    return {"loaded_at": F.current_timestamp(), "row_no": F.monotonically_increasing_id()}


def read_upload(spark: SparkSession, path: str, kind: str, batch_id: str) -> DataFrame:
    headers_of(kind)
    return raw_rows(scan_csv(spark, path, multi_line=kind == "reviews"), kind, batch_id)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows, between 1 and 100 of them."""
    return df.limit(max(1, min(rows, PREVIEW_LIMIT)))


def load_summary(rows: DataFrame, batch_id: str) -> DataFrame:
    """Rows in the table and rows of one batch, in one pass."""
    return rows.agg(
        F.count("*").alias("table_total_rows"),
        F.count_if(F.col("batch_id") == batch_id).alias("rows_inserted"),
    ).select(F.lit(batch_id).alias("batch_id"), "rows_inserted", "table_total_rows")
