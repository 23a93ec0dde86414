"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(id, component)`` for each id on an edge; component is the smallest id.

    Each round joins every node's neighbours to the smallest one (large star,
    then small star), which takes O(log n) rounds for a path of n nodes. Self
    loops, repeated edges and either direction are allowed; an empty table
    gives an empty one. Rows with a null end are ignored.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges, before = written(small, "edges"), state
        state = _state(edges)
        if state == before:
            break
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("id"), "component")).distinct()
