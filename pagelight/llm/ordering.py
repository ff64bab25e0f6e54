"""Places of rows in a global order, without one task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.llm.common import Scratch

#: Rows of a range at most, about, and ranges that are summed in one block.
RANGE_ROWS, BLOCK = 1 << 20, 1024


def ranges(rows: DataFrame, count: int, most: int = RANGE_ROWS) -> int:
    """The number of ranges: that of the session's shuffles, or more where ranges would be larger than `most`."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // most))


def numbered(run: Scratch, rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows, written, with `pos` (from 0 within the group, by `order`, nulls first) and `n` (rows of the group).

    Rows are dealt by ranges of (group, order), so a group of any size spreads over tasks; ties beyond `order` fall in any
    order, once and for all as the table is written. Places within a range come from the row numbers there, those of the ranges from their
    counts, of which each range and group has one.
    """
    n = ranges(rows, rows.count())
    keys = [F.asc_nulls_first(c) for c in (group, *order)]
    ranged = rows.repartitionByRange(n, *keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys)
    ranged = run.write(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ranged")
    parts = ranged.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = run.write(parts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("n")), "parts")
    placed = ranged.join(parts, (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_p")))
    return placed.select(*rows.columns, (F.col("_row") + F.col("_shift")).alias("pos"), "n")


def running_start(run: Scratch, parts: DataFrame, number: str, size: str) -> DataFrame:
    """(number, start): the sum of `size` over all smaller numbers; numbers are summed in blocks, then the blocks."""
    block = F.floor(F.col(number) / BLOCK)
    sums = run.write(parts.groupBy(block.alias("_b")).agg(F.sum(size).alias("_s")), "blocks")
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for BLOCK parts
    sums = sums.select(F.col("_b"), F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_b").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.select(F.col(number), block.alias("_b"), F.col(size).alias("_s")).withColumn("_own", F.coalesce(F.sum("_s").over(within), F.lit(0)))
    return own.join(sums, "_b").select(number, (F.col("_own") + F.col("_before")).alias("start"))
