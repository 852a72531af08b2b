"""Connected components of a graph that is never gathered in one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` (longs): ``root`` is the smallest node reachable.

    Alternating large-star and small-star steps on edges that point to the smaller end. Large-star: an edge moves its
    end on to the least neighbour of that end. Small-star: of the smaller neighbours of a node the least gets the edges
    to the node and to the others. In the end every edge points from a node to its root. The edges of each round are a
    table in the shared folder; so are the least neighbours, that both sides of the join are plain exchanges, which AQE
    may split where a hub has many edges. A node has few distinct smaller neighbours once edges have moved on. Loops
    and repeated edges don't matter; an edge with a null end is ignored; no edges give no rows.
    """
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", True)
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
        low = materialise(now.groupBy(F.col("u").alias("end")).agg(F.min("v").alias("m")), "low", True)
        moved = now.join(low, F.col("v") == F.col("end"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = moved.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        both = least.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = materialise(both.where("u != v").distinct(), "edges", True)
        discard(now, low)
        now = after
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of the pairs ``(i, j)`` in ``label`` in place; a class is named by its smallest position."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
