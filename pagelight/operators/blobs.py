"""Connected components of black pixels (8-neighbourhood), from horizontal runs.

Runs come from gaps and islands, neighbours from an equi-join of adjacent rows of a page with a residual on x. Only
the union of a page's linked runs is Python, over pairs of run numbers; boxes and sizes are aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.functions import scalar
from pagelight.operators import pages
from pagelight.operators.stages import Stages


def numbered_runs(binary: DataFrame) -> DataFrame:
    """(page_id, run, y, x0, x1): black runs numbered in raster order within the page."""
    order = Window.partitionBy("page_id").orderBy("y", "x0")
    return pages.runs(binary).withColumn("run", F.row_number().over(order) - 1).select("page_id", "run", "y", "x0", "x1")


def neighbours(runs: DataFrame) -> DataFrame:
    """(page_id, a, b): runs of adjacent rows that touch, corners included."""
    a = runs.select("page_id", "y", F.col("run").alias("a"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = runs.select("page_id", (F.col("y") - 1).alias("y"), F.col("run").alias("b"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    return a.join(b, ["page_id", "y"]).where("a0 <= b1 + 1 and b0 <= a1 + 1").select("page_id", "a", "b")


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of n things is linked with, over chains of links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _roots(t: pa.Table) -> pa.Table:
    a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
    label = least_labels(int(max(a.max(), b.max())) + 1, a, b)
    runs = np.unique(a[a == b])
    return pa.table({"page_id": pa.array(np.full(len(runs), t.column("page_id")[0].as_py()), pa.int64()), "run": pa.array(runs, pa.int32()), "root": pa.array(label[runs], pa.int32())})


def components(binary: DataFrame) -> DataFrame:
    """(page_id, seq, x, y, w, h, pixel_count), numbered from 0 by the top and left of their boxes, then by their first pixel. The runs are written, as
    four joins read them. Pages that don't fit a task go through `tiles`."""
    runs = Stages(binary.sparkSession, "runs").write(numbered_runs(binary), "runs")
    own = runs.select("page_id", F.col("run").alias("a"), F.col("run").alias("b"))
    roots = own.unionByName(neighbours(runs)).groupBy("page_id").applyInArrow(_roots, "page_id long, run int, root int")
    found = runs.join(roots, ["page_id", "run"]).groupBy("page_id", "root").agg(
        F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).cast("int").alias("w"), (F.max("y") - F.min("y") + 1).cast("int").alias("h"), F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("pixel_count")
    )
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("y", "x", "root")) - 1
    return found.withColumn("seq", number).select("page_id", "seq", "x", "y", "w", "h", "pixel_count")


def boxes(components: DataFrame) -> DataFrame:
    """components with their boxes as structs."""
    return components.select("page_id", "seq", scalar.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("bbox"), "pixel_count")
