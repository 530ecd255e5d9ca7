"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, stored


def _stars(edges: DataFrame, own: bool, limit: int) -> DataFrame:
    """One step of alternating stars over ``(u, v)``: every node's neighbours are joined to the smallest one it knows.

    ``own`` false: of all neighbours, the larger ones are moved (large star); true: of the smaller ones, all, and the node
    itself (small star). Minima are taken in each task first; a node with more than ``limit`` links is broadcast to them.
    """
    both = edges if own else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n")))
    small = least.select("u", F.least("u", "_m").alias("_m"))
    moved = joined(both if own else both.where(F.col("v") > F.col("u")), small, "u", least.where(F.col("_n") > limit).select("u"), "inner")
    out = moved.select(F.col("v").alias("u"), F.col("_m").alias("v"))
    if own:
        out = out.unionByName(small.select("u", F.col("_m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, limit: int = 100_000) -> DataFrame:
    """``(node, root)`` of every node with a link in ``(a, b)``: the smallest node it is connected with.

    Large and small stars in turn (Kiveris and others, 2014) until nothing changes; every round is a stored table, and no
    task ever holds a component. A round at least halves the longest way to a root in practice; only a count and a checksum
    come to the driver.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen = None
    while True:
        edges = stored(_stars(stored(_stars(edges, False, limit)), True, limit))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
