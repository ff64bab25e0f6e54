"""Distributed connected components by alternating large-star and small-star steps.

Every step is a min-aggregate (combined map-side, so a hub node costs one row per task) joined back
to the edges; both join inputs come from written tables, so adaptive execution can split a hub's
edges over tasks. Only a change counter reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm.common import Scratch, materialize


def _star(run: Scratch, edges: DataFrame) -> DataFrame:
    """For each edge (u, v): v linked to the smallest of u's neighbours and u. edges is written."""
    least = run.write(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    return edges.join(least, "u").select("u", "v", "m")


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) of any orderable type to (node, component), written: the smallest node reachable.

    Nulls, self-loops and repeated edges are ignored; nodes without an edge to another don't appear; no edges give
    an empty table.
    """
    with Scratch(edges.sparkSession, "components") as run:
        down = run.write(_oriented(edges.where("u is not null and v is not null")), "edges")
        for _ in range(max_rounds):
            if down.isEmpty():
                break
            both = run.write(down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
            # large star: larger neighbours move to the smallest of the neighbourhood
            large = run.write(_star(run, both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
            # small star: each node's smaller neighbours, and itself, move to the smallest of them
            s = _star(run, large)
            small = s.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(s.select("u", F.col("m").alias("v")))
            after = run.write(small.where("u > v").distinct(), "small")
            changed = not down.exceptAll(after).isEmpty() or not after.exceptAll(down).isEmpty()
            run.drop(both, large, down)
            down = after
            if not changed:
                break
        else:
            raise RuntimeError("connected components did not settle")
        found = down.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return materialize(found.unionByName(down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "component-labels")
