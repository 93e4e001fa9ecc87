"""Connected components of an edge list, by alternating large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, forget

#: Rounds after which the files of those before are removed.
FORGET = 3


def _round(edges: DataFrame) -> DataFrame:
    """A large star and a small star; rows may repeat, the next round takes them once.

    Large star: every neighbour above a node is linked to the least of the node and its neighbours. Small star: a node and its
    neighbours below are linked to the least of these, the node in the row of the least. Each star deals its rows out by one column.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = both.repartition("u").distinct()
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    down = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node it is connected with) for every node but the least ones.

    Each round leaves fewer and shorter paths; a path of n nodes takes about log2(n) rounds. Nodes
    without edges, null ends and loops are left out. Rounds are cut by checkpoints.
    """
    edges = checkpointed(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    seen, rounds = None, 0
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20, 0)"))).collect()[0]
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state
        edges = checkpointed(_round(edges))
        rounds += 1
        if rounds % FORGET == 0:
            forget(edges.sparkSession)
