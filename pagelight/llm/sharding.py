"""Placement of rows on shards by a permutation-filled lookup table (DataFrame functions only).

Each shard has an order of preference over the slots of a prime-sized table, an offset and a stride
from its name's hash. Shards take turns claiming their next free slot until the table is full, so
shares differ by one slot at most, and adding or removing a shard moves few slots. The table has
``slots`` entries whatever the data, so broadcasting it is bounded; a key's slot is its hash modulo
the table's size. Rows are placed one by one: no key, hot or not, is shuffled.

A null key is placed like the empty string; equal keys share a shard; other columns are kept, whatever
their names; a key of any length is hashed whole; an empty table gives an empty one with the two columns.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.llm.common import quoted, unused

#: A prime, over a hundred slots for each shard.
SLOTS, SHARDS = 4099, 32


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The lookup table: for each slot the position of its shard in shards."""
    if not shards or len(set(shards)) != len(shards) or slots < len(shards):
        raise ValueError("shards must be distinct, and at most one for each slot")
    if any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime")
    at = [_hash(s, "offset") % slots for s in shards]
    stride = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + stride[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """(slot_col, shard_col): one row for each slot."""
    names = F.split(F.lit("\n".join(shards)), "\n")
    placed = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")).alias("at", "number"))
    return placed.select(F.col("at").alias(slot_col), F.element_at(names, F.col("number").cast("int") + 1).alias(shard_col))


def place(df: DataFrame, key: str, shards: list[str] | int = SHARDS, slots: int = SLOTS, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """df with slot_col and shard_col added at its end (in place of columns of those names, case aside)."""
    if isinstance(shards, int):
        shards = [f"shard-{i:05d}" for i in range(shards)]
    kept = [c for c in df.columns if c.lower() not in (slot_col.lower(), shard_col.lower())]
    own_slot, slot, shard = unused([*df.columns, slot_col, shard_col], "_own_slot", "_slot", "_shard")
    keyed = df.withColumn(own_slot, slot_of(F.col(quoted(key)), slots))
    found = keyed.join(F.broadcast(lookup_table(df.sparkSession, shards, slots, slot, shard)), F.col(own_slot) == F.col(slot), "left")
    return found.select(*[F.col(quoted(c)) for c in kept], F.col(own_slot).alias(slot_col), F.col(shard).alias(shard_col))
