"""Connected components by alternating large-star and small-star steps.

Every step is a group-by minimum (combined map-side) and an equi-join of two written
tables, which Spark splits where a hub makes it uneven; so a hub with millions of
neighbours is never collected.  Edges are written between rounds, and the round before goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tasks_for


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, box: Scratch | None = None) -> DataFrame:
    """(node, component) for every node with an edge; component is its smallest node.

    Null ends and self-loops are ignored, repeated edges count once; no edges: no rows.
    The result reads a table in ``box``.
    """
    box = box or Scratch(edges.sparkSession)
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    e = box.put(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n, seen = e.count(), None
    for _ in range(max_rounds):
        few = tasks_for(2 * n)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = box.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(few))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = box.put(large.coalesce(few).distinct().coalesce(few))
        least = box.put(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = box.put(small.coalesce(few).unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(few))
        box.drop(e, low, large, least)
        e = after
        n, total = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if (n, total) == seen:
            break
        seen = (n, total)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
