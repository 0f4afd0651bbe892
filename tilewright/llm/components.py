"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _digest(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return r[0], r[1] or 0


def _star(neighbours: DataFrame, large: bool) -> DataFrame:
    """Link each node's greater (large) or all (small) neighbours with the least of its neighbourhood."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = neighbours.join(least, "u")
    if large:
        return out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u > v")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, root): each node that has an edge, with the least node it reaches.

    Null ends and loops are ignored, repeated edges count once, no edges give no rows. Work per
    round is linear in the edges; rounds grow with the logarithm of the nodes.
    """
    e = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _digest(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True).distinct()
        e = materialise(_star(large, False).distinct())
        after = _digest(e)
        if after == before:
            break
        before = after
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
