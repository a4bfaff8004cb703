"""Connected components of an edge table by repeated contraction.

Every round sends each vertex to its neighbour of least rank (itself included), where rank is a
hash that changes by round, then replaces both ends of every edge and drops loops and repeats.
Random ranks make the vertex set shrink by a constant factor, long chains included. Nothing is
collected: the driver sees one count per round. All tables of a round are written to the shared
folder, so lost executors repeat one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` -> ``(node, label)``: one label for each component, for every vertex of an edge."""
    edges = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, turn = None, 0
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        rank = F.struct(F.xxhash64(F.lit(turn), "to").alias("r"), F.col("to").alias("v"))
        own = F.struct(F.xxhash64(F.lit(turn), "node").alias("r"), F.col("node").alias("v"))
        parent = scratch.keep(both.groupBy("node").agg(F.min(rank).alias("m")).select("node", F.least(F.col("m"), own).getField("v").alias("label")), "parents")
        if labels is None:
            labels = parent
        else:
            moved = parent.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = scratch.keep(labels.join(moved, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        left = parent.select(F.col("node").alias("a"), F.col("label").alias("x"))
        right = parent.select(F.col("node").alias("b"), F.col("label").alias("y"))
        edges = scratch.keep(
            edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
