"""Connected components by joins: every node hooks onto the least node near it, trees shrink to their roots, edges become edges of roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import Shelf


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b), the least node it is connected with; loops name no nodes, no edges give no rows.

    A round merges each node with its least neighbour's tree, and leaves edges between trees only: a group of any size that hangs on a
    few nodes is one node after the first round.  Trees are flattened by pointer jumping, in rounds that grow with the logarithm of
    their depth.  Hubs are aggregated before the shuffle; nothing is collected.
    """
    tasks = 4 * edges.sparkSession.sparkContext.defaultParallelism  # small tables: no more files than keep all cores busy
    links = shelf.put(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().coalesce(tasks))
    labels = None
    while True:
        near = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).union(links.groupBy(F.col("a").alias("node")).agg(F.min("a").alias("root")))
        trees = flattened(shelf.put(near.groupBy("node").agg(F.min("root").alias("root")).coalesce(tasks)), shelf)
        between = links.join(trees.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(trees.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").filter("ra != rb")
        rest = shelf.put(between.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct().coalesce(tasks))
        shelf.drop(links)
        if labels is None:
            labels = trees
        else:
            moved = shelf.put(relabelled(labels, trees).coalesce(tasks))
            shelf.drop(labels, trees)
            labels = moved
        links = rest
        if links.isEmpty():
            shelf.drop(links)
            return labels


def relabelled(labels: DataFrame, trees: DataFrame) -> DataFrame:
    """``labels`` (node, root), with roots replaced by the roots that ``trees`` gives them."""
    return labels.join(trees.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def flattened(labels: DataFrame, shelf: Shelf) -> DataFrame:
    """A stored forest (node, root) whose every node points to the root of its tree; roots point to themselves."""
    while True:
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        shorter = shelf.put(labels.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")).coalesce(4 * labels.sparkSession.sparkContext.defaultParallelism))
        shelf.drop(labels)
        labels = shorter.select("node", "root")
        labels._shelf_path = shorter._shelf_path
        if shorter.filter("moved").isEmpty():
            return labels


def merged(labels: DataFrame, trees: DataFrame) -> DataFrame:
    """``labels`` after its roots were merged by ``trees``; nodes that only ``trees`` has are added."""
    return relabelled(labels, trees).union(trees.join(labels, "node", "left_anti").select("node", "root"))
