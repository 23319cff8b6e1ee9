"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, root): root is the smallest node reachable; only nodes that have an edge to another.

    Each round points every node at its smallest smaller neighbour, follows the pointers to their
    ends, and contracts the edges to the nodes reached, so that the number of edges falls until none
    is left. All steps are equi-joins and minima; a hub costs one row a neighbour, never one row a pair.
    Nulls in an edge, self-loops and repeated edges are ignored.
    """
    spark = edges.sparkSession
    x, y = F.col(a), F.col(b)
    live = written(edges.where(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct(), "edges")
    levels = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        up = _settled(live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")))
        levels.append(up)
        hi, lo = up.select(F.col("node").alias("hi"), F.col("root").alias("hi2")), up.select(F.col("node").alias("lo"), F.col("root").alias("lo2"))
        moved = live.join(hi, "hi").join(lo, "lo", "left").select(F.col("hi2").alias("u"), F.coalesce("lo2", "lo").alias("v"))
        live = written(moved.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), "edges")
        release(spark)
    else:
        raise RuntimeError("components did not settle")
    if not levels:
        return live.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    # a node has a parent at one level only: from there on the edges name its parent instead
    labels = levels[-1]
    for up in levels[-2::-1]:
        labels = written(_jump(up, labels).unionByName(labels), "labels")
    roots = labels.select(F.col("root").alias("node")).distinct()
    return labels.unionByName(roots.select("node", F.col("node").alias("root")))


def _jump(up: DataFrame, above: DataFrame) -> DataFrame:
    above = above.select(F.col("node").alias("root"), F.col("root").alias("root2"))
    return up.join(above, "root", "left").select("node", F.coalesce("root2", "root").alias("root"))


def _settled(up: DataFrame) -> DataFrame:
    """Follows pointers, twice as far each time, until every one ends at a node without a pointer."""
    up = written(up, "parents")
    for _ in range(60):
        heads = up.select(F.col("root").alias("node")).distinct()
        if heads.join(up.select("node"), "node", "left_semi").isEmpty():
            return up
        up = written(_jump(up, up), "parents")
    raise RuntimeError("pointers did not settle")
