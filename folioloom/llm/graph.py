"""Connected components by alternating large and small stars, all in DataFrame operations.

Each step aggregates the least neighbour of every node (combined before the
shuffle) and joins it back from a written table, so that Spark can split the
join's hot keys.  Edges, labels and components stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf


def _least(shelf: Shelf, pairs: DataFrame) -> DataFrame:
    return shelf.put(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))


def components(shelf: Shelf, edges: DataFrame) -> DataFrame:
    """(node, component) for every node that an edge of edges (a, b) touches; component: the least node reachable.

    Loops, repeated edges and either direction are allowed; an edge with a null
    end is ignored; without edges the result has no rows.
    """
    step = shelf.put(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    n = step.count()
    while n:
        both = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(shelf, both)
        large = shelf.put(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        )
        shelf.drop(least)
        least = _least(shelf, large)
        before, n_before = step, n
        step = shelf.put(
            large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u > v").distinct()
        )
        shelf.drop(least), shelf.drop(large)
        # Both sides are distinct rows: as many, and none of them new, means that nothing changed.
        n = step.count()
        done = n == n_before and step.join(before, ["u", "v"], "left_anti").isEmpty()
        shelf.drop(before)
        if done:
            break
    roots = step.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return shelf.put(step.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))
