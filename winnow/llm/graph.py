"""Connected components of a graph of long ids, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, durable


def connected(edges: DataFrame) -> DataFrame:
    """node, root: for each end of an edge (columns x, y), the least id of its component.

    Each round every node takes the least label around it and then that label's label, so a path's
    length is about halved. Labels are a written table after every two rounds.
    """
    pairs = edges.select(F.col("x").alias("a"), F.col("y").alias("b"))
    both = durable(pairs.union(edges.select("y", "x")).distinct(), "graph-edges", few_files=True)
    labels = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "graph-labels", few_files=True)
    moved = not labels.isEmpty()
    while moved:
        after = durable(_round(both, _round(both, labels).select("node", "root")), "graph-labels", few_files=True)
        discard(labels)
        labels = after.select("node", "root")
        labels._winnow_path = after._winnow_path
        moved = not after.where("moved").isEmpty()
    discard(both)
    return labels


def _round(both: DataFrame, labels: DataFrame) -> DataFrame:
    """node, root, and whether the node's root has become another one."""
    around = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
    met = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "m").alias("near"))
    jump = met.select(F.col("node").alias("near"), F.col("near").alias("far"))
    return met.join(jump, "near").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved"))
