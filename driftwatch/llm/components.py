"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.scratch import kept


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node that an edge names; component is the smallest node reachable.

    Large stars point all greater neighbours of a node at its least one, small stars the lesser ones;
    together they halve distances, so the number of rounds grows with the logarithm of the longest
    path. Each round is written to the shared folder and joins by sorting, so nothing of it passes through
    the driver. An edge (v, u) has v > u, so a node's least neighbour is found among its edges as v, and its
    greater ones are its edges as u: no round reads the edges in both directions. Null ends and loops are ignored.
    """
    edges = edges.select(F.greatest(left, right).alias("v"), F.least(left, right).alias("u"))
    edges = kept(edges.where(F.col("v") != F.col("u")).distinct(), "edges")
    state = _state(edges)
    while True:
        least = edges.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "u")
        large = edges.join(least.hint("merge"), "u", "left").select("v", F.coalesce("m", "u").alias("u"))
        first = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(first.hint("merge"), "v")
        small = small.select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u"))
        edges = kept(small.where(F.col("v") != F.col("u")).distinct(), "edges")
        last, state = state, _state(edges)
        if state == last:
            break
    roots = edges.select(F.col("u").alias("node")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
