"""Connected components of an edge table, by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def _flat(forest: DataFrame) -> DataFrame:
    """forest(node, to), each node once and to smaller than node: paths are halved until every node points to its root."""
    before = None
    while True:
        up = forest.toDF("up", "above")
        step = forest.join(up, F.col("to") == F.col("up"), "left").select("node", F.coalesce("above", "to").alias("to"), F.col("above").isNotNull().alias("moved"))
        step = staged(step, "forest")
        if before is not None:
            dropped(before)
        before, forest = step, step.select("node", "to")
        if not step.filter("moved").limit(1).count():
            return forest


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for each node that has an edge, the smallest node it reaches; roots are not listed.

    In a round every node with a smaller neighbour moves to its smallest one, and paths of moves are made
    flat; edges are relabelled, made distinct, and drop out once both ends agree.  A node that moved never
    comes back, so the moves of all rounds form a forest, which is made flat in the end.  Aggregates combine
    before they shuffle and the joins are plain equi-joins, so a node with many edges is split by adaptive execution.
    """
    live = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u") != F.col("v"))
    live = edges_ = staged(live.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), "edges")
    forest = None
    while live.limit(1).count():
        moves = _flat(live.groupBy("hi").agg(F.min("lo").alias("to")).withColumnRenamed("hi", "node"))
        forest = moves if forest is None else forest.unionByName(moves)
        m1, m2 = moves.toDF("n1", "t1"), moves.toDF("n2", "t2")
        live = live.join(m1, F.col("hi") == F.col("n1"), "left").join(m2, F.col("lo") == F.col("n2"), "left")
        u, v = F.coalesce("t1", "hi"), F.coalesce("t2", "lo")
        after = staged(live.select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).filter("hi != lo").distinct(), "edges")
        dropped(edges_)
        live = edges_ = after
    if forest is None:
        return live.toDF("node", "root")
    return _flat(forest).toDF("node", "root")
