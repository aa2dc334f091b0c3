"""Consistent placement by a permutation-filled lookup table.

Shards take turns; at its turn a shard claims the first free slot of its own
preference order, which is an arithmetic progression through a prime-sized
table. A key is placed by hashing it to a slot: one lookup, whatever the number
of shards. Adding or losing a shard moves few keys besides its own.

The table has ``size`` rows (a parameter, at most MAX_SLOTS), so its broadcast
is bounded and doesn't grow with the data. Hot sources, copies or keys do no
harm: nothing is shuffled, each row is placed by its own key alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int) -> list[int]:
    """Slot -> index of the shard that claimed it."""
    if not shards:
        raise ValueError("at least one shard is needed")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names must differ")
    if not _is_prime(size) or size < len(shards) or size > MAX_SLOTS:
        raise ValueError("the table size must be a prime from the number of shards up to MAX_SLOTS")
    steps = []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        start = int.from_bytes(digest[:8], "big") % size
        skip = int.from_bytes(digest[8:], "big") % (size - 1) + 1
        steps.append([start, skip])
    table, free = [-1] * size, size
    while free:
        for shard, step in enumerate(steps):
            while table[step[0]] >= 0:
                step[0] = (step[0] + step[1]) % size
            table[step[0]] = shard
            free -= 1
            if not free:
                break
    return table


def table_frame(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    """(slot, shard) rows, cut from one binary literal inside the JVM."""
    packed = F.lit(bytearray(b"".join(x.to_bytes(4, "big") for x in table)))
    at = F.substring(packed, F.col("id").cast("int") * 4 + 1, F.lit(4))
    return spark.range(0, len(table), 1, 1).select(
        F.col("id").cast("int").alias("slot"), F.conv(F.hex(at), 16, 10).cast("int").alias("shard")
    )


def slot_of(key: Column, size: int) -> Column:
    """A null key is placed like the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign(df: DataFrame, key: str, shards: Sequence[str], size: int = 4099) -> DataFrame:
    """df with columns slot and shard (columns of those names are replaced).

    Repeated keys share a shard; null keys are placed like ''; an empty table stays empty."""
    table = fill_table(shards, size)
    kept = df.select(*[c for c in df.columns if c not in ("slot", "shard")], slot_of(F.col(f"`{key}`"), size).alias("slot"))
    return kept.join(F.broadcast(table_frame(df.sparkSession, table)), "slot").select(
        *[F.col(f"`{c}`") for c in kept.columns], "shard"
    )


def movement(before: Sequence[int], after: Sequence[int]) -> float:
    """Share of slots whose shard changed."""
    return sum(a != b for a, b in zip(before, after, strict=True)) / len(before)
