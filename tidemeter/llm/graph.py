"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of edges (``a``, ``b``), both long.

    Each round maps every node to its smallest neighbour, follows that map three steps down, and contracts the
    edges along it; the edges left shrink at least by half, in practice far more.  The smallest neighbour is an
    aggregate that combines before the shuffle, so a hub does not gather its edges in one task.  Rounds are
    written to the checkpoint folder.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = nodes.withColumn("root", F.col("node"))
    while not edges.isEmpty():
        near = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
        step = cut(near.select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        for _ in range(2):
            step = step.join(hop, "to").select("node", F.col("next").alias("to"))
        step = cut(step)
        to_a, to_b = (step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        edges = cut(edges.join(to_a, "a").join(to_b, "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
                    .filter("a <> b").distinct())
        roots = cut(roots.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    return roots
