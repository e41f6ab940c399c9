"""Connected components of a graph given as edges, by alternating large and small stars.

Each round replaces every vertex's links by links to its smallest neighbour: first those to larger vertices,
then those to smaller ones (Kiveris et al., Connected Components in MapReduce and Beyond, 2014).  The graph
never leaves the cluster: a round is a minimum per vertex and a join, in which the links of a hub are dealt in
parts; each round is written to the shared folder so that lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from .joins import join_split


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """vertex, component (its smallest vertex) for every vertex of an edge; loops and repeated edges are harmless."""
    e = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        large = join_split(both.where("v > u"), least, "u", "n", state["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # every link of the large star points from a larger vertex to a smaller one
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = join_split(large, small, "u", "n", state["n"]).select("u", "v", "m")
        e = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = staged(e, "edges")
    roots = e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
