"""Exact duplicates by a tree of merges over sorted runs of text digests.

Every document becomes one digest row. The rows are dealt to runs; in each round
``fan_in`` neighbouring runs meet in one, all runs of a level at the same time, and
rows with the same digest merge into one that keeps the smallest identifier and
the number of documents. A merge is a window over rows sorted by run and digest,
so no task ever holds more than ``fan_in`` rows of one text, however often the text
occurs: copies were counted inside their first run before anything moved.

Digest rows only merge when SHA-256, byte length and a second, independent 64-bit
hash agree, which is the check behind the identifier that is kept.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillworks.llm.common import keep_rows, staged, text_of

SPACES = r"[\x20\x09-\x0D]+"
RUNS = 64
FAN_IN = 8
KEY = ["text_sha256", "n_bytes", "second_hash"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document: identifier, digest of the normalised text, length and second hash."""
    normal = F.regexp_replace(text_of(text_col), SPACES, " ")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normal, 256).alias("text_sha256"),
        F.octet_length(normal).alias("n_bytes"),
        F.xxhash64(normal).alias("second_hash"),
    )


def merge_runs(rows: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """Merge the runs level by level; one row per distinct text with ``keep_id`` and ``group_size``."""
    if runs < 1 or fan_in < 2:
        raise ValueError("at least one run and a fan-in of two")
    run = F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int")
    level = (
        rows.withColumn("run", run)
        .groupBy("run", *KEY)
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    while runs > 1:
        runs = -(-runs // fan_in)
        together = Window.partitionBy("run", *KEY)
        first = together.orderBy(F.col("keep_id").asc_nulls_last())
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .withColumn("place", F.row_number().over(first))
            .withColumn("group_size", F.sum("group_size").over(together))
            .where("place = 1")
            .drop("place")
        )
    return level.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after each run of white space becomes one
    space. A null text counts as empty. A null identifier never stays while
    another document has the same text. Repeated rows of one identifier are
    counted each and share one decision. An empty table gives no rows; other
    columns are not read.
    """
    rows = staged(digest_rows(docs, id_col, text_col), "digests")
    groups = staged(merge_runs(rows), "digest-groups")
    return rows.join(groups, KEY).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select("doc_id", "text_sha256")
    own = F.sha2(F.regexp_replace(text_of(text_col), SPACES, " "), 256)
    return keep_rows(docs, [F.col(id_col), own], kept)
