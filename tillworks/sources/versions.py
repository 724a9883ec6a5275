"""Marts behind a manifest: a rebuild is seen as a whole or not at all.

A rebuild writes every mart into a folder of its own version. The manifest, an append-only
table, gets the names and places of all marts of that version in one file, last. Readers take
the newest whole manifest and resolve names through it, so they never meet a half-built
version, and what a broken rebuild left behind is simply never read.

An entry may also name a table that is partitioned by load and batch and the pairs that count.
Such a table is part of a version without being copied.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.session import released_shuffles
from tillworks.sources import tables

ENTRY = "version string, number bigint, name string, path string, loads array<string>, at timestamp"


class Snapshot:
    """The marts of one version; it stays the same while others publish."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.version, self.number, self.entries = None, 0, {}
        if not tables.exists(spark, f"{self.root}/manifest"):
            return
        manifest = spark.read.schema(ENTRY).parquet(f"{self.root}/manifest")
        newest = manifest.agg(F.max(F.struct("number", "at", "version")).alias("newest")).select("newest.version", "newest.number")
        # One row per mart of one version: a few dozen.
        for row in manifest.join(newest, ["version", "number"]).collect():
            self.version, self.number = row["version"], row["number"]
            self.entries[row["name"]] = (row["path"], row["loads"])

    def mart(self, name: str) -> DataFrame:
        if name not in self.entries:
            raise KeyError(f"no version holds a mart named {name}")
        path, loads = self.entries[name]
        rows = self.spark.read.parquet(f"{self.root}/{path}")
        # The filter is on the partition columns: other folders are not read.
        return rows if loads is None else rows.filter(F.concat_ws("/", "load", "batch_id").isin(loads))


class Rebuild:
    """A version under construction. Frames read back from it see what it has saved so far."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.before = Snapshot(spark, root)
        self.version = uuid.uuid4().hex
        self.saved: dict[str, tuple[str, list[str] | None]] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a mart into this version and read it back; nobody else sees it yet."""
        path = f"versions/{self.version}/{name}"
        with released_shuffles(self.spark):
            df.write.parquet(f"{self.root}/{path}")
        self.saved[name] = (path, None)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}")

    def name_loads(self, name: str, table: str, loads: list[str]) -> None:
        """Make some ``load/batch`` folders of a stored table a mart of this version, without a copy."""
        self.saved[name] = (table, loads)

    def mart(self, name: str) -> DataFrame:
        entries = Snapshot.__new__(Snapshot)
        entries.spark, entries.root, entries.entries = self.spark, self.root, self.before.entries | self.saved
        return entries.mart(name)

    def publish(self) -> None:
        """Write the manifest. Marts that were not saved again keep their place."""
        rows = [(self.version, self.before.number + 1, name, path, loads, None) for name, (path, loads) in (self.before.entries | self.saved).items()]
        schema = T.StructType.fromDDL(ENTRY)
        entries = self.spark.createDataFrame(rows, schema).withColumn("at", F.current_timestamp())
        entries.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")  # one file, so it is there or it is not


@contextmanager
def rebuild(spark: SparkSession, root: str, within: Rebuild | None = None) -> Iterator[Rebuild]:
    """A rebuild that publishes when its body ends without an error; ``within`` another one leaves that to it."""
    build = within or Rebuild(spark, root)
    yield build
    if within is None:
        build.publish()


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the folders of versions that the newest ``keep`` manifests do not name; returns them.

    Not while a rebuild runs: what it has saved is in no manifest yet.
    """
    root = root.rstrip("/")
    manifest = spark.read.schema(ENTRY).parquet(f"{root}/manifest")
    newest = [r["version"] for r in manifest.select("version", "number").distinct().orderBy(F.col("number").desc()).limit(max(1, keep)).collect()]
    named = {r["path"].split("/")[1] for r in manifest.where(F.col("version").isin(newest) & F.col("path").startswith("versions/")).select("path").distinct().collect()}
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName() not in named]
    for path in gone:
        system.delete(path, True)
    return sorted(path.getName() for path in gone)
