import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["fp", "run", "keep_id", "mark", "chunk", "posting", "score", "curve_key", "sample_key", "text_sha256", "u", "v", "_id"]


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty, blank and long texts, copies, near copies, repeated rows; more columns whose names clash."""
    base = words(1, 80)
    rows = [
        (1, base),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (5, base),
        (5, base),
        (6, base.replace(" ", "  \n", 3)),
        (7, base + " extra"),
        (8, words(2, 30) + " " + base[100:300] + " " + words(3, 30)),
        (9, "Ünïcödé ÀÉ " + base[:120].upper()),
        (None, base),
        (None, None),
        (10, words(4, 20000)),
        (11, "a"),
        (12, "a b c d"),
        (13, "a b  c d"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest given documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
