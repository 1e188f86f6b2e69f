"""Connected components of a link table, by alternating large and small stars.

Every round is a pair of grouped minima and joins, written to the shared folder, so
a lost executor re-reads files.  The minima of hubs are taken on the map side first and
written apart, so that AQE can split a hub in the joins.  Nothing but counters reaches
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waybill.llm.common import stage


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself."""
    child, parent = F.lit(1).alias("up"), F.lit(1).alias("down")
    nodes = edges.select(F.col("a").alias("node"), child, F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), parent)
    )
    seen = nodes.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b) that is not its smallest.

    Links of a node to itself and repeated links change nothing.  A node that is
    missing from the result is the smallest of its component.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stage(edges.distinct(), "links")
    while not _is_forest_of_stars(edges):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.distinct(), "large")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least, "a")
        small = moved.select(F.col("b").alias("a"), "m").unionByName(least).filter("a <> m")
        edges = stage(small.select("a", F.col("m").alias("b")).distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def roots(parents: DataFrame) -> DataFrame:
    """(node, component) of a forest given as links (a, b) with one smaller b per a.

    Every round each link jumps to its parent's parent, so paths halve.
    """
    links = stage(parents, "parents")
    while True:
        up = links.select(F.col("a").alias("b"), F.col("b").alias("above"))
        moved = links.join(up, "b", "left")
        moved = stage(moved.select("a", F.coalesce("above", "b").alias("b"), F.col("above").isNotNull().alias("far")), "parents")
        links = moved.select("a", "b")
        if moved.filter("far").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
