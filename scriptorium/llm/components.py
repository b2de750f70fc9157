"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node and an equi-join, so a node of any degree is
pre-aggregated and never gathered; each round's edges are written to the shared
folder. Rounds end when each node points to the smallest of its component and
nothing else does. A null end makes no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import written


def _is_done(edges: DataFrame) -> bool:
    """Whether each node has one edge at most, and none leads on: edges go to smaller nodes, so all are labels then."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    ends = ends.groupBy("x").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return ends.where("out > 1 OR out = 1 AND into > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b); label is its component's smallest node."""
    a, b = F.col("a"), F.col("b")
    held = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    held = written(held, "edges")
    while not _is_done(held):
        both = held.unionByName(held.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        held = written(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
    return held.select(a.alias("node"), b.alias("label")).unionByName(held.select(b.alias("node"), b.alias("label"))).distinct()
