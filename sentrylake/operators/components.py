"""Connected components by alternating star contraction (Kiveris et al., 2014).

Each round halves long chains, so a chain of n vertices takes O(log n) rounds where passing
the smallest label along would take n. Rounds are written to the checkpoint folder. The neighbours
of a vertex are reduced to their least by an aggregate that runs map-side, and the join with it has
one row per vertex on the other side. Where that side is too large to broadcast, nothing splits a
vertex with very many neighbours: its edges, two ids each, pass through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage_observed


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest vertex around u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter(F.col("v") > F.col("u")).join(smallest, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = smallest.select("u", F.col("m").alias("v"))
    return linked.unionByName(own).filter(F.col("u") != F.col("v")).distinct()


def _staged(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written out, with their number and a hash of all of them."""
    staged, seen = stage_observed(
        edges, "edges", F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    )
    return staged, (seen["n"], seen["x"])


def component_links(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> u, v: each vertex of a component but the smallest, and the smallest."""
    current, before = _staged(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    while before[0]:
        current, after = _staged(_small_star(_large_star(current)))
        if after == before:
            break
        before = after
    return current


def connected_components(vertices: DataFrame, edges: DataFrame, vertex: str) -> DataFrame:
    """vertices (column `vertex`) and edges (u, v) -> vertex, component; the component is
    the smallest vertex of it."""
    links = component_links(edges)
    return vertices.join(links, F.col(vertex) == F.col("u"), "left").select(
        vertex, F.coalesce("v", vertex).alias("component")
    )
