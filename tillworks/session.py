"""Session settings the jobs rely on, and where written intermediates go."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when a count proves it has at most this many rows.
BROADCAST_ROWS = 100_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tillworks")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests, the benchmark) gets one folder of its own
    process; any other master is refused, as its executors could not read such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="tillworks-"))
    return _OWN_FOLDER[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder, so no run overwrites another."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as each run ends.

    Otherwise they stay until the driver happens to collect its garbage, which it does the
    more seldom the longer its steps take, so that the disk holds many steps at a time.
    """
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back; this also ends the lineage, and what was shuffled for it goes."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with released_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Hint a broadcast only after a count shows at most ``max_rows`` rows.

    The count stops at ``max_rows + 1``. Larger frames come back unhinted, so
    the join falls through to a shuffle join that AQE can split on skew.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df), True
    return df, False


_MARTS: dict[tuple, str] = {}


def _listing(spark: SparkSession, source: str) -> tuple:
    """Names, sizes and times of the table files, so that a changed file means a new mart."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return tuple(files.load(source).select("path", "length", "modificationTime").orderBy("path").collect())


def stored_bytes(spark: SparkSession, source: str) -> int:
    """Size of the files of a table; only their names are listed."""
    return sum(row["length"] for row in _listing(spark, source))


def stored_mart(
    spark: SparkSession, name: str, source: str, build: Callable[[SparkSession, str], DataFrame]
) -> DataFrame:
    """A mart written once per session and state of the source folder, then read back.

    Dashboards and reports read marts; they do not rebuild them per request. The
    written table also ends the lineage, so a lost executor re-reads a file.
    """
    key = (spark.sparkContext.applicationId, source, name, _listing(spark, source))
    if key not in _MARTS:
        path = fresh_path(spark, f"mart-{name}")
        with released_shuffles(spark):
            build(spark, source).write.parquet(path)
        _MARTS[key] = path
    return spark.read.parquet(_MARTS[key])
