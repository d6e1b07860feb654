"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayweft.session import materialise


def _stars(edges: DataFrame) -> bool:
    """Whether every node is the centre of its edges or the end of a single one."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("end"), F.lit(0).alias("centre"))
    ends = ends.unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("end"), F.lit(1).alias("centre")))
    each = ends.groupBy("v").agg(F.sum("end").alias("end"), F.max("centre").alias("centre"))
    return each.where("end + centre > 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: BIGINT); the component is its smallest node.

    Alternating large and small stars: each step links a node's neighbours to its smallest one, until
    the edges form stars. Sums before the shuffle keep a node with very many links cheap, the edges
    shrink towards one per node, and about log n rounds do.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select("b", "m").union(low)
        edges = materialise(small.toDF("a", "b").where("a <> b").distinct())
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
