"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.sources.shared import discard, saved

__all__ = ["connected_components"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _outside_stars(edges: DataFrame) -> int:
    """How many nodes have several smaller neighbours, or a smaller and a larger one. If none has, every link joins a node to its component's smallest."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("n")).first()["n"]


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (u, v: any type with an order); component is the smallest node.

    Rows with a null end are left out; loops and repeated links change nothing.
    Each round is written to the shared folder, so that lineage stays short, and
    the round before is removed.
    It ends when all components are stars, without a round that only confirms it.
    The number of links never grows, and rounds grow with the logarithm of the
    longest chain. An empty table gives an empty result.
    """
    links = edges.where("u is not null and v is not null and u != v")
    now = saved(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while _outside_stars(now):
        last = now
        now = saved(_small_star(_large_star(last)), "links")
        discard(last)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
