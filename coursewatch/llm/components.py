"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, Scratch, join_hot

MAX_ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node it reaches.

    Edges are integers in either order, repeated or not; self-loops and nulls
    are ignored. Each round costs two grouped minima (combined before their
    shuffle) and two joins, and never holds a node's neighbours in one row.
    The rounds needed grow with the logarithm of the largest component.
    """
    a, b = F.col(a), F.col(b)
    now, path = scratch.write(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        stats = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if stats == before:
            break
        before = stats
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = scratch.write(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m")), "least")
        large = _with_least(both.filter("v > u"), least, scratch).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large, large_path = scratch.write(large, "large")
        least, own_path = scratch.write(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        linked = _with_least(large, least, scratch).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, after_path = scratch.write(linked.union(least.select("u", F.col("m").alias("v"))).distinct(), "star")
        for p in (least_path, large_path, own_path, path):
            scratch.drop(p)
        now, path = after, after_path
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _with_least(edges: DataFrame, least: DataFrame, scratch: Scratch) -> DataFrame:
    most = least.agg(F.max("n")).first()[0] or 0
    return join_hot(edges, least, "u", scratch) if most > HOT_ROWS else edges.join(least.drop("n"), "u")
