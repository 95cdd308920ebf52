"""Connected components of a graph of text nodes (large-star / small-star rounds,
after Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import checkpoint


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)")).alias("a"),
        F.sum(F.xxhash64("dst", F.lit(1), "src").cast("decimal(20,0)")).alias("b"),
    ).first()
    return row["n"], row["a"], row["b"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour.

    `edges` point from larger to smaller, once each. The least neighbour comes from
    a partial aggregation; a hub is the skewed probe side of a join against one row
    per node.
    """
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    return (
        edges.select(F.col("dst").alias("src"), F.col("src").alias("far"))
        .join(least, "src")
        .filter(F.col("far") != F.col("low"))
        .select(F.col("far").alias("src"), F.col("low").alias("dst"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    others = (
        edges.join(least, "src")
        .filter(F.col("dst") != F.col("low"))
        .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    )
    return others.unionByName(least.select("src", F.col("low").alias("dst"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for all nodes of `links` (src, dst): a component is labelled by
    its least node. Nodes without links are not listed; they are their own.

    Rounds stop when an edge set repeats. Every round is written to reliable
    storage, so losing an executor does not restart the loop.
    """
    edges = checkpoint(
        links.filter(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )
    seen = _fingerprint(edges)
    while seen[0]:
        edges = checkpoint(_small_star(_large_star(edges)))
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    labelled = edges.select(F.col("src").alias("node"), F.col("dst").alias("label"))
    tops = edges.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct()
    return labelled.unionByName(tops)
