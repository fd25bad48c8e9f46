"""Connected components by alternating large-star and small-star over an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import grown
from panelwright.session import cut_lineage


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge set."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(h, 24)), F.bit_xor(h)).first())


def _least(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each node, itself included; collapses before the shuffle."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(grown(_least(both)), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    linked = down.join(grown(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (u, v); the component is its smallest node.

    Edges with a null end or with equal ends say nothing and are left out. No neighbour list is
    built: a node's rows meet only in a minimum. Each round is written to the shared folder.
    """
    edges = cut_lineage(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    mark = _mark(edges)
    while True:
        edges = cut_lineage(small_star(large_star(edges)), "edges")
        fresh = _mark(edges)
        if fresh == mark:
            break
        mark = fresh
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
