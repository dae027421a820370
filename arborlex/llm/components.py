"""Connected components of a graph given by its edges, without gathering them anywhere.

Alternates the large-star and small-star steps until the edges no longer
change.  Each half is an aggregation by node and a join with its minimum: the
aggregation combines before the shuffle, and the join is one whose large keys
adaptive execution splits, so a node with very many links burdens no one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, ws: Workspace, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link: root is the smallest node that it reaches.

    ``edges`` has two columns of one orderable type, in any direction; loops and repeats are harmless.
    """
    a, b = edges.columns
    step = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    now = ws.save(step, "edges-0")
    mark = _mark(now)
    for k in range(1, most_rounds + 1):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(first, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = ws.save(small.unionByName(first.select("hi", F.col("m").alias("lo"))).distinct(), f"edges-{k}")
        ws.drop(f"edges-{k - 1}")
        seen, mark = mark, _mark(now)
        if mark == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
