"""Shard placement through a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized
table (an offset and a skip drawn from its name) and the shards take turns
claiming their next free slot, so every shard holds the same number of slots
but for one, and a changed shard list moves few keys. A key's slot is its hash
modulo the table size; the table (bounded by ``max_slots``) is broadcast.

Defined results: a null key is hashed as the empty string; equal keys always
share a shard; the shard list must be non-empty and without repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.frames import spare

MAX_SLOTS = 1 << 22


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def draw(text: str) -> int:
    """A number below 2**60 from a name: the first 15 hex digits of its MD5."""
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = 65_537, max_slots: int = MAX_SLOTS) -> np.ndarray:
    """Slot -> index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given, once each")
    if not is_prime(slots) or not len(shards) <= slots <= max_slots:
        raise ValueError(f"the table size must be a prime from {len(shards)} to {max_slots}")
    offset = [draw("offset:" + s) % slots for s in shards]
    skip = [draw("skip:" + s) % (slots - 1) + 1 for s in shards]
    turn = list(offset)  # each shard's next preference
    table = np.full(slots, -1, np.int32)
    left = slots
    while left:
        for i in range(len(shards)):
            while table[turn[i]] >= 0:
                turn[i] = (turn[i] + skip[i]) % slots
            table[turn[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") % slots).cast("int")


def assign_shards(df: DataFrame, key: str, shards: list[str], slots: int = 65_537) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (columns of these names are replaced). No shuffle."""
    spark = df.sparkSession
    table = lookup_table(shards, slots)
    places = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], "_slot int, _shard string")
    at, name = spare(df, "_slot"), spare(df, "_shard")
    places = places.toDF(at, name)
    out = df.withColumn(at, slot_of(F.col(key), slots))
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    return out.join(F.broadcast(places), at, "left").select(*rest, F.col(at).alias("slot"), F.col(name).alias("shard"))
