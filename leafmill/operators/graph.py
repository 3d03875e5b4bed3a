"""Precedence of cross-reference sections, and walks of page trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import stored


def newest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row by ``order`` (sections count from the newest) for each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Levels that a walk goes down: each is a job for the whole batch, so one file must not make thousands.
DEPTH = 200


def walk(roots: DataFrame, edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored, depth: int | None = None) -> DataFrame:
    """(tree, node, path, carried): every node below the roots, level by level; each level is a join, and is kept.

    roots (tree, node, carried); edges (tree, parent, ordinal, child, own).  path has the ordinals from the root;
    carried is the nearest value of ``own`` on the way down.  A node that is its own ancestor is cut off there, and
    nodes at ``depth`` (``DEPTH``) have nothing below them; ``too_deep`` tells which trees lose some there.
    """
    depth = DEPTH if depth is None else depth
    edges = keep(edges.select("tree", F.col("parent").alias("node"), "ordinal", "child", "own"))
    level = keep(roots.select("tree", "node", F.array().cast("array<int>").alias("path"), F.array("node").alias("above"), "carried"))
    out = level
    for _ in range(depth):
        below = level.join(edges, ["tree", "node"]).where(~F.array_contains("above", F.col("child")))
        below = below.select("tree", F.col("child").alias("node"), F.array_append("path", F.col("ordinal").cast("int")).alias("path"), F.array_append("above", F.col("child")).alias("above"), F.coalesce("own", "carried").alias("carried"))
        level = keep(below)
        if level.isEmpty():
            return out.drop("above")
        out = out.unionByName(level)
    return out.drop("above")


def too_deep(walked: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(tree): the trees whose walk was cut because nodes at ``depth`` have children."""
    last = walked.where(F.size("path") == (DEPTH if depth is None else depth)).select("tree", F.col("node").alias("parent"))
    return edges.join(last.hint("merge"), ["tree", "parent"], "left_semi").select("tree").distinct()


def leaves(walked: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without children, numbered in depth-first order within their tree (``page_index``)."""
    ends = walked.join(edges.select("tree", F.col("parent").alias("node")).distinct().hint("merge"), ["tree", "node"], "left_anti")
    return ends.withColumn("page_index", F.row_number().over(Window.partitionBy("tree").orderBy("path")) - 1)
