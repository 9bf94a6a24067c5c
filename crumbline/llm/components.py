"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with an edge to another node; component is the smallest node that can be reached.

    Alternating large and small stars: each round links the neighbours of a node to the smallest of them, until the edges
    no longer change. A round is a pre-aggregated minimum and a join, whatever the degree of a node; the number of rounds
    grows with the logarithm of the longest path. Self-loops and repeated edges are allowed, nulls are ignored.
    """
    kept = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    kept = stored(kept, "edges")
    before = None
    while True:
        both = kept.union(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where(F.col("u") > F.col("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
        small = small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        kept = stored(small, "edges")
        now = kept.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before is not None and (now.n, now.h) == before:
            break
        before = (now.n, now.h)
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).union(kept.select(F.col("v"), F.col("v")).distinct())
