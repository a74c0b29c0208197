"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(edges: DataFrame) -> DataFrame:
    """Large star, then small star: every node's neighbours move to the least node that it sees."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    # now every edge goes from the larger to the smaller node
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    return (
        large.join(low, "u")
        .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .where("u > v")
        .distinct()
    )


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of edges (u, v) reaches.

    Alternating large and small stars; each round ends in a written table, so no plan grows
    and no node, edge or label reaches the driver (two sums do). Loops and nulls are dropped;
    nodes with loops only are not in the result, nor is anything for an empty table.
    """
    now, path = scratch.table(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sums = [F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))]
    state = now.agg(*sums).first()
    for _ in range(max_rounds if state[0] else 0):
        after, new_path = scratch.table(_star(now))
        new_state = after.agg(*sums).first()
        scratch.drop(path)
        now, path = after, new_path
        if tuple(new_state) == tuple(state):
            break
        state = new_state
    else:
        if state[0]:
            raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    label = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return label.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
