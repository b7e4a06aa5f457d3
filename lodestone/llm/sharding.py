"""Shards by a permutation-filled lookup table.

Every shard ranks the slots of a prime-sized table by its own permutation (offset + k * skip). Shards take turns, each
claiming the first free slot of its ranking, until the table is full: shards hold equal shares to within one slot, and
adding or removing a shard moves few slots beyond its own. A row's slot is a hash of its key; the table gives its shard.

Scale: placement is one lookup a row in a broadcast table whose size is the prime (65537 rows by default), whatever the
data; no shuffle, and no key can make a hot task. The table is filled on the driver from the shard names alone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537
SHARDS = 64


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that holds each slot. Names are distinct; there are fewer shards than slots."""
    if not _prime(slots):
        raise ValueError("slots must be prime, so that every skip visits all slots")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("one to `slots` distinct shard names are needed")
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "little") % slots for d in digests]
    skip = [int.from_bytes(d[8:16], "little") % (slots - 1) + 1 for d in digests]
    table, filled = [-1] * slots, 0
    while True:
        for shard in range(len(shards)):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + skip[shard]) % slots
            table[slot] = shard
            at[shard] = (slot + skip[shard]) % slots
            filled += 1
            if filled == slots:
                return table


def lookup_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) of the table, made from one literal array."""
    table = lookup_table(shards, slots)
    numbers = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1).select(F.posexplode(numbers).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def _slot(id_col: str, slots: int):
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def sharded(df: DataFrame, id_col: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """One row for each row of df: id_col, slot, shard.

    The slot is the first 32 bits of the md5 of the id as text, modulo the slots. A null id goes where the empty text goes.
    Repeated rows share a place. Other columns of df, whatever their names, are not looked at. An empty df gives no rows.
    """
    table = lookup_frame(df.sparkSession, [f"shard-{k}" for k in range(shards)], slots)
    return df.select(F.col(id_col).alias("id"), _slot(id_col, slots).alias("slot")).join(F.broadcast(table), "slot", "left").select(F.col("id").alias(id_col), "slot", "shard")


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS, files: int = 1) -> str:
    """Write df under path/shard=<n>/, `files` files a shard; the table's slots split a shard's rows evenly among them.

    One shuffle, which gathers each file's rows. All rows and columns of df are written, null ids and repeated rows too. A
    column of df that is called shard keeps its name; the folders then have underscores before theirs. Returns the folders'
    column. An empty df writes a table without rows.
    """
    name = "shard"
    while name in df.columns:
        name = f"_{name}"
    table = lookup_frame(df.sparkSession, [f"shard-{k}" for k in range(shards)], slots).select(F.struct("slot", "shard").alias("__place"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), _slot(id_col, slots).alias("__slot"))
    rows = rows.join(F.broadcast(table), F.col("__slot") == F.col("__place.slot"))
    rows = rows.repartition(shards * files, F.col("__place.shard"), F.pmod(F.col("__slot"), F.lit(files)))
    rows.select(*(F.col(f"__row.`{c}`").alias(c) for c in df.columns), F.col("__place.shard").alias(name)).write.partitionBy(name).parquet(path)
    return name
