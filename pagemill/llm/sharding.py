"""Placement of rows on shards by a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by a permutation of its own
(offset, step).  Shards take turns; at its turn a shard claims the first slot of
its order that is still free.  All shards end with the same number of slots, give
or take one, and removing or adding a shard moves few slots of the others.  A row
is placed by one hash and one lookup in the broadcast table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
#: A prime, and over 100 slots for each of the 64 shards: shares differ by under 1 %.
TABLE_SIZE = 16_381


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard index of every slot.  ``size`` is a prime above the number of shards."""
    if not shards or size < len(shards) or any(size % k == 0 for k in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table needs a prime size, and a slot for every shard at least")
    # size is prime, so every step from 1 to size - 1 visits all slots
    walks = [(_hash(f"offset:{s}") % size, _hash(f"step:{s}") % (size - 1) + 1) for s in shards]
    slots, turns, free = [-1] * size, [0] * len(shards), size
    while free:
        for i, (offset, step) in enumerate(walks):
            while slots[slot := (offset + turns[i] * step) % size] >= 0:
                turns[i] += 1
            slots[slot] = i
            free -= 1
            if not free:
                break
    return slots


def lookup_table(spark: SparkSession, slots: list[int]) -> DataFrame:
    """The table as rows (slot, shard): as many as the prime says, whatever the data."""
    cells = F.split(F.lit(",".join(map(str, slots))), ",")
    return spark.range(1).select(F.posexplode(cells).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    """First 12 hex digits of the key's MD5, modulo the table size; null is the empty string."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with a column ``shard`` (and ``slot``); columns of these names are replaced.

    No shuffle: the lookup table has ``size`` rows and is broadcast.  Repeated
    rows and equal keys go to one shard, null keys to the empty string's.
    """
    table = lookup_table(docs.sparkSession, fill_table([f"shard-{i}" for i in range(shards)], size))
    rows = docs.drop("shard", "slot").withColumn("slot", slot_of(F.col(key), size))
    return rows.join(F.broadcast(table), "slot").select(*rows.columns, "shard")
