"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every step is an aggregate or an equi-join on node ids: nothing is gathered per node or on the driver. Each round's
edges are checkpointed, so that lineage stays short and a lost executor costs one round at most. A round takes as many tasks as its
edges ask for, and no more: with few edges over many partitions, files of shuffles and checkpoints would outgrow the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import saved

#: Edges of a task; tables of fewer than that times the session's partitions take fewer tasks.
TASK_EDGES = 1 << 12


def _stars(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """edges: u > v. Large: hang u's larger neighbours on its least one; small: hang u and its smaller ones."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
    hung = both.join(least, "u").coalesce(tasks)
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b of type long, in any direction, repeats and loops allowed. Rounds go on until nothing changes.

    Returns node, root (the smallest node of its component) for every node with an edge to another; no rows for no edges.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen, left = None, now.count()
    while True:
        tasks = max(1, -(-left // TASK_EDGES))
        now = saved(_stars(_stars(now.coalesce(tasks), large=True, tasks=tasks), large=False, tasks=tasks))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen, left = tuple(state), state[0]
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
