"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order of the slots of a prime-sized table, given by an offset and a
skip. Shards take turns; at its turn a shard claims the first slot of its order that is still free. A row
goes to the shard that holds the slot of its key's hash. Shards hold equal shares of slots (they differ by
one at most), and adding or removing a shard moves few slots of the others.

The table has a fixed size (a parameter), so broadcasting it is bounded: 65,537 slots are about a megabyte.
Placement is one hash and one lookup a row; there is no shuffle and no Python on the executors.

Defined cases: a null key hashes as the empty string, like an empty key; equal keys go to one shard, whatever
their number, unless `spread` is over 1: then the rows of one key are dealt over so many slots by a second
column, which keeps a key that holds a third of all rows from filling one shard. Extra columns are kept; a
column named slot or shard in the input is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard (by position in `shards`) that holds each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named once each, and there must be one")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime of at least the number of shards")
    offset = [_number(f"offset {s}") % slots for s in shards]
    skip = [_number(f"skip {s}") % (slots - 1) + 1 for s in shards]
    tried, held, claimed = [0] * len(shards), [-1] * slots, 0
    while True:
        for i in range(len(shards)):
            while held[slot := (offset[i] + tried[i] * skip[i]) % slots] >= 0:
                tried[i] += 1
            held[slot], tried[i], claimed = i, tried[i] + 1, claimed + 1
            if claimed == slots:
                return held


def key_hash(key: Column) -> Column:
    """60 bits of the key's MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The lookup table as rows (slot, shard)."""
    held = lookup_table(shards, slots)
    # posexplode of one literal: no Python rows are shipped
    packed = spark.range(1).select(F.posexplode(F.split(F.lit(" ".join(map(str, held))), " ")).alias("slot", "shard"))
    return packed.select("slot", F.col("shard").cast("int").alias("shard"))


def shard(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, spread: int = 1, spread_by: str | None = None) -> DataFrame:
    """df with slot and shard. spread: over how many places the rows of one key are dealt, by column spread_by."""
    if spread < 1 or spread > 1 and spread_by is None:
        raise ValueError("spread over 1 needs spread_by")
    placed = F.col(key).cast("string")
    if spread > 1:
        part = F.pmod(key_hash(F.col(spread_by)), F.lit(spread)).cast("string")
        placed = F.concat(F.coalesce(placed, F.lit("")), F.lit("\x1f"), part)
    table = F.broadcast(table_frame(df.sparkSession, shards, slots))
    at = F.pmod(key_hash(placed), F.lit(slots)).cast("int").alias("slot")
    rest = df.select(at, *[F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")])  # the key may be one of these
    return rest.join(table, "slot", "left")


def write_shards(df: DataFrame, key: str, shards: Sequence[str], path: str, writers: int = 1, slots: int = SLOTS) -> None:
    """Write one folder a shard. Rows of a shard are dealt over `writers` tasks at random, so no task holds a whole shard."""
    placed = shard(df, key, shards, slots)
    placed = placed.repartition(len(shards) * writers, "shard", F.floor(F.rand(7) * writers))
    placed.write.partitionBy("shard").parquet(path)


def drift(before: Sequence[str], after: Sequence[str], slots: int = SLOTS) -> float:
    """Share of the slots that change hands when the shards change."""
    a, b = lookup_table(before, slots), lookup_table(after, slots)
    return sum(before[x] != after[y] for x, y in zip(a, b, strict=True)) / slots
