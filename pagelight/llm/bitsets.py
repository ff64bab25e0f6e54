"""Fixed-size sets of row keys, small enough to be named to all executors at any size of the input.

A set is a table (word, mask) of at most ``BITS`` / 64 rows: a key's slot is its hash modulo BITS. Whether a row's slot is
set is one broadcast look-up, so rows that certainly aren't in the set are told apart without moving them. Rows that hit
may be in it or not; whoever uses a set settles those exactly. A set that fills up tells less, never anything wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelight.llm.common import materialize, quoted, unused

BITS = 1 << 26


def slot(*keys: Column, bits: int = BITS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def of_slots(rows: DataFrame, at: Column) -> DataFrame:
    """(word, mask) of the slots of rows; combined map-side."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    return rows.select(F.shiftright(at, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask"))


def with_hit(rows: DataFrame, held: DataFrame, at: Column, name: str) -> DataFrame:
    """rows with a boolean column `name`: whether the slot is set. held: a written table of `of_slots`."""
    word, mask = unused([*rows.columns, name], "_word", "_mask")
    table = F.broadcast(held.select(F.col("word").alias(word), F.col("mask").alias(mask)))
    found = F.call_function("shiftright", F.col(mask), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.join(table, F.shiftright(at, 6) == F.col(word), "left").withColumn(name, F.coalesce(found, F.lit(False))).drop(word, mask)


def settle(rows: DataFrame, keys: list[str], decided: DataFrame, doubt: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows kept by `decided` (the keys, without nulls, once each, and a boolean kept), without joining the rows that the sets tell apart.

    The first set holds the keys that go, so what misses it stays; the second the kept keys that hit the first, so what hits the first and
    misses the second goes. Only rows that hit both are joined. They come second, all that stay come first; rows with a null key stay.
    doubt: kept keys that are to come second anyway.
    """
    at = slot(*[F.col(quoted(k)) for k in keys])
    kept = F.col("kept")
    goes = materialize(of_slots(decided.where(~kept if doubt is None else ~kept | doubt), at), "gone")
    stays = materialize(of_slots(with_hit(decided.where(kept), goes, at, "_hit").where("_hit"), at), "doubted")
    gone, safe, *others = unused([*rows.columns, "word", "mask"], "_gone", "_safe", *[f"_k{i}" for i in range(len(keys))])
    marked = with_hit(with_hit(rows, goes, at, gone), stays, at, safe)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(quoted(k)).isNotNull()
    every = [F.col(quoted(c)) for c in rows.columns]
    sure = marked.where(~whole | ~F.col(gone)).select(*every)
    chosen = decided.where(kept).select(*[F.col(quoted(k)).alias(o) for k, o in zip(keys, others)])
    same = F.lit(True)
    for k, o in zip(keys, others):
        same = same & (F.col(quoted(k)) == F.col(o))
    asked = marked.where(whole & F.col(gone) & F.col(safe)).select(*every)
    return sure, asked.join(chosen, same, "leftsemi")
