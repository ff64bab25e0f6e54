"""Connected components of a graph within groups, by contraction: no group has to fit a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.operators.stages import Stages


def least_members(run: Stages, links: DataFrame, group: str = "page_id") -> DataFrame:
    """links(group, a, b) to (group, node, root): the smallest node that each linked node is connected with.

    In each round a node moves to the smallest of its neighbours and itself, and on to where that one moves, in doubling steps, until all stand at one
    that stays; those are half of the nodes at most. Links are drawn between them, until none is left. The moves of all rounds are then followed from the last to the first."""
    links = run.write(links.where("a <> b").select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(group, F.col("b").alias("a"), F.col("a").alias("b")))
        moves = both.groupBy(group, F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to"))
        moves = run.write(moves, "moves")
        while True:
            further = run.write(_followed(moves, moves, group), "moves")
            moves = further.select(group, "node", "to")
            if further.where("moved").isEmpty():
                break
        rounds.append(moves)
        ends = links
        for side in ("a", "b"):
            at = moves.select(F.col(group).alias("_g"), F.col("node").alias("_n"), F.col("to").alias("_t"))
            ends = ends.join(at, (F.col(group) == F.col("_g")) & (F.col(side) == F.col("_n"))).drop("_g", "_n", side).withColumnRenamed("_t", side)
        links = run.write(ends.where("a <> b").select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(group, F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        found = run.write(_followed(earlier, found, group).drop("moved"), "followed")
    return found.select(group, "node", F.col("to").alias("root"))


def _followed(moves: DataFrame, onward: DataFrame, group: str) -> DataFrame:
    """moves, each to where its end moves in onward, and whether that is another node."""
    at = onward.select(F.col(group).alias("_g"), F.col("node").alias("_n"), F.col("to").alias("_t"))
    return moves.join(at, (F.col(group) == F.col("_g")) & (F.col("to") == F.col("_n")), "left").select(group, "node", F.coalesce("_t", "to").alias("to"), F.coalesce(F.col("_t") != F.col("to"), F.lit(False)).alias("moved"))
