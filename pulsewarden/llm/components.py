"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewarden.llm import shared


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node of its component.

    Each round hangs neighbours under smaller nodes (large-star, then small-star) until no edge changes;
    rounds grow with the logarithm of the longest chain, and rows never exceed the edges. Every round is
    written in the shared folder, so lost executors cost one round. Self-loops and nulls are ignored.
    """
    held = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    held = shared.cut(held, "edges")
    state = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    while state[0]:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        held = shared.cut(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        now = held.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == state:
            break
        state = now
    parents = held.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return parents.unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
