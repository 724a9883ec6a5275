"""Connected components of a link table by alternating large-star and small-star rounds.

Every round reads and writes tables in the shared folder. A node with very many
links is never one task's work: its minimum is aggregated with map-side combining,
and the join that brings it back reads two written tables, so Spark can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import staged


def _star(links: DataFrame, seen_from: DataFrame) -> DataFrame:
    """Tie the neighbours of every node to the least of them and the node itself."""
    least = seen_from.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return links.join(staged(least, "least"), "u")


def _distinct(links: DataFrame) -> DataFrame:
    return links.where("u <> v").distinct()


def _fingerprint(links: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), total).first())


def components(links: DataFrame) -> DataFrame:
    """``u, v`` links of long nodes to ``node, root``: root is the least node that can be reached.

    Roots themselves and nodes without links have no row. Links with a null end and
    links of a node to itself are not links; repeated links count once; an empty
    table gives no rows.
    """
    pairs = links.where("u IS NOT NULL AND v IS NOT NULL").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = staged(_distinct(pairs), "links")
    before = _fingerprint(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        tied = _star(both, both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(_distinct(tied), "large-star")
        tied = _star(edges, edges)
        nodes = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            tied.select("u", F.col("m").alias("v"))
        )
        edges = staged(_distinct(nodes), "small-star")
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
