"""Connected components of a graph given as edges, by alternating large and small stars.

Each round replaces the edges of a node by edges to the smallest node near it;
the rounds end when every node points at the smallest node of its component. The number of rounds grows with the logarithm
of the longest path. Rounds are staged, so a lost executor costs one round at
most, and no node's edges are collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.common import discard, small, stage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """``e`` runs from the larger node to the smaller one."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    near = e.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every node points at one node at most, and those pointed at at none."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        e.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); the component is its smallest node."""
    e = (edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e, path = stage(e, "edges")
    while not _stars(e):
        e, path, old = *stage(_small_star(_large_star(e)), "edges"), path
        discard(e.sparkSession, old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def join_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) with its components joined by ``links`` (a, b); only components take part in the rounds."""
    if links.isEmpty():
        return found
    own = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    named = links.join(own("a"), "a", "left").join(own("b"), "b", "left")
    ends, path = stage(named.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")), "component-links")
    new = components(ends)
    to = small(new.select(F.col("node").alias("component"), F.col("component").alias("least")))
    moved = found.join(to, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    # Nodes without links before are components of their own in ``new``.
    fresh = new.join(found.select("node"), "node", "left_anti")
    out, _ = stage(moved.unionByName(fresh), "components")
    discard(out.sparkSession, path)
    return out
