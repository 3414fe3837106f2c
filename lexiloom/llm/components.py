"""Connected components by alternating large-star and small-star rounds.

The edges stay distributed and every round is written to the shared folder, so
that neither the driver nor a lineage of rounds grows with the graph. The driver
sees two numbers a round, to know when nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.scratch import Scratch
from lexiloom.llm.spread import heavy_threshold


def _least(pairs: DataFrame, total: int) -> DataFrame:
    """``pairs`` (u, v) with m, the least v of u; hubs come by a broadcast of bounded size."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
    limit = heavy_threshold(2 * total)
    heavy = least.filter(F.col("_n") >= limit).drop("_n").withColumnRenamed("m", "_hub")
    light = least.filter(F.col("_n") < limit).drop("_n")
    first = pairs.join(F.broadcast(heavy), "u", "left")
    hubs = first.filter(F.col("_hub").isNotNull()).withColumnRenamed("_hub", "m")
    rest = first.filter(F.col("_hub").isNull()).drop("_hub").join(light, "u")
    return hubs.unionByName(rest)


def components(scratch: Scratch, links: DataFrame, name: str = "cc") -> DataFrame:
    """``(node, component)`` for every node of ``links`` (a, b); component is its smallest node.

    ``name`` tells apart the rounds' tables of several calls on one scratch folder. Links may repeat, in any direction; links of a node with itself and links
    with null are passed over. Without links the result is empty.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.write(edges, f"{name}0")
    mark = edges.select(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    seen = tuple(mark.first())
    k = 0
    while seen[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: each larger neighbour is linked with the least of the neighbourhood.
        large = _least(both, seen[0]).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        large = scratch.write(large, f"{name}{k + 1}a")
        # Small star: so are a node and its smaller neighbours.
        small = _least(large, seen[0])
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = scratch.write(small.filter("u <> v").distinct(), f"{name}{k + 1}")
        now = tuple(edges.select(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first())
        scratch.drop(f"{name}{k}")
        scratch.drop(f"{name}{k + 1}a")
        k += 1
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
