"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narae.llm.shared import materialise


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Each node passes the least of its neighbourhood to its larger (large) or smaller neighbours."""
    around = both if large else both.where("v < u")
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else around.groupBy("u").agg(F.min("v").alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is its smallest node.

    Links may repeat, run either way or join a node to itself. Each step is written, so its cost is
    that of the links alone; hot nodes are reduced before the shuffle.
    """
    edges = materialise(links.select("a", "b").where("a != b").distinct(), "links")
    seen = None
    while True:
        for large in (True, False):
            both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
            edges = materialise(_star(both, large), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select("b", "b")).distinct()
