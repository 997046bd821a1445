"""Connected components by alternating large and small stars, with a written table for each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a, b) with a > b. Minima are written before the join, so that both of its sides are dealt anew and a hub can be split."""
    sides = edges.unionByName(edges.selectExpr("b as a", "a as b")) if large else edges
    least = written(sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
    joined = sides.join(least, "a")
    if large:
        return joined.where("b > a").selectExpr("b as a", "m as b").distinct()
    return joined.where("b > m").selectExpr("b as a", "m as b").unionByName(least.selectExpr("a", "m as b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b) of bigint nodes: (node, root), root being the smallest node of its component; isolated nodes have no row.

    Loops count for nothing. Each round moves a multiple of the edges, never a component to one task.
    """
    edges = written(edges.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "edges")
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        edges = written(_stars(written(_stars(edges, True), "large"), False), "small")
    return edges.selectExpr("a as node", "b as root").unionByName(edges.selectExpr("b as node", "b as root").distinct())
