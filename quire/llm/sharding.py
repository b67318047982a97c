"""Sharding through a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size
(start and stride from a hash of its name; a prime size makes every stride
visit all slots). Shards take turns, each claiming the first free slot in its
order, until the table is full. Shares differ by at most one slot, and when a
shard comes or goes few other slots change hands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537  # prime; the bound of the broadcast table


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Number of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, at least one")
    if size < 2 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table size must be prime")
    if len(shards) > size:
        raise ValueError("more shards than slots")
    place, stride = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        place.append(int.from_bytes(digest[:8], "big") % size)
        stride.append(int.from_bytes(digest[8:], "big") % (size - 1) + 1)
    table, free = [-1] * size, size
    while free:
        for s in range(len(shards)):
            at = place[s]
            while table[at] >= 0:
                at = (at + stride[s]) % size
            table[at] = s
            place[s] = (at + stride[s]) % size
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of the MD5 of its string form, null as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size))


def assign(df: DataFrame, key: str | list[str], shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(the key columns, slot, shard_id, shard) of every row.

    The table has ``size`` rows whatever the data, so it is broadcast, and a
    row finds its shard in constant time, without a shuffle. Shard by a key
    that is unique or nearly so: a hot key has one slot, so add a second
    column to ``key`` to spread it.

    Edge cases: a null key is the key ''; several key columns are joined by a
    unit separator; repeated rows get the same shard; an empty table gives an
    empty result; other columns are not read."""
    keys = [key] if isinstance(key, str) else list(key)
    spark = df.sparkSession
    joined = F.concat_ws("\x1f", *[F.coalesce(df[c].cast("string"), F.lit("")) for c in keys])
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    table = spark.range(1).select(F.posexplode(owners).alias("slot", "owner")) \
        .select(F.col("slot").cast("bigint").alias("slot"), F.col("owner").cast("int").alias("shard_id")) \
        .withColumn("shard", F.element_at(names, F.col("shard_id") + 1))
    placed = df.select(F.struct(*[df[c].alias(f"k{i}") for i, c in enumerate(keys)]).alias("keys"),
                       slot_of(joined, size).alias("slot"))
    return placed.join(F.broadcast(table), "slot") \
        .select(*[F.col("keys")[f"k{i}"].alias(c) for i, c in enumerate(keys)], "slot", "shard_id", "shard")


def write_shards(df: DataFrame, key: str | list[str], shards: list[str], path: str, size: int = TABLE_SIZE,
                 files_per_shard: int = 1) -> None:
    """Write ``df`` as Parquet with a folder per shard (``shard_id=<n>``) and
    about ``files_per_shard`` files in each, so that a large shard is written
    by several tasks. All columns of ``df`` are kept."""
    keys = [key] if isinstance(key, str) else list(key)
    joined = F.concat_ws("\x1f", *[F.coalesce(df[c].cast("string"), F.lit("")) for c in keys])
    table = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",")
    shard = F.element_at(table, slot_of(joined, size).cast("int") + 1).cast("int")
    out = df.withColumn("shard_id", shard).withColumn("shard_file", F.pmod(F.xxhash64(joined), F.lit(files_per_shard)))
    out.repartition(max(1, len(shards) * files_per_shard), "shard_id", "shard_file").drop("shard_file") \
        .write.partitionBy("shard_id").parquet(path)
