"""Operator 4, sharding: a permutation-filled lookup table places every key.

Each shard has a permutation of the slots of a prime-sized table: offset, offset +
skip, offset + 2 * skip ... Shards take turns; at its turn a shard claims the first
slot of its permutation that nobody has claimed. So the shares of two shards differ by
one slot at most, and a change of the set of shards moves few keys. The table has SLOTS
rows, whatever the input: that bound is why it is broadcast. Placing a row costs one
hash and one lookup, with no shuffle.

Null key: it is hashed as the empty text and placed like any key. Equal keys share a
shard, so a hot key would fill one: pass several columns as the key, as the query does
with doc_id, which is unique. Empty table: empty result. Other columns pass through,
whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

SLOTS = 65537
SHARDS = 64


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """slot -> position in shards; slots must be a prime not below the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime not below the number of shards")
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def place(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(d, slot, shard): d holds the row as it came."""
    rows = [(slot, shards[k]) for slot, k in enumerate(lookup_table(shards, slots))]
    table = df.sparkSession.createDataFrame(rows, "slot long, shard string").coalesce(1)
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys))
    slot = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(slots).cast("long")
    return df.select(F.struct("*").alias("d"), slot.alias("slot")).join(F.broadcast(table), "slot").select("d", "slot", "shard")


def write_shards(df: DataFrame, keys: list[str], shards: list[str], path: str, slots: int = SLOTS) -> None:
    """Write the rows with their shard as a folder each; every task writes its own files, so no shard meets in one task."""
    place(df, keys, shards, slots).select("d.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    placed = place(docs.select("doc_id", "source", "n_chars"), ["doc_id"], [f"shard-{k:03d}" for k in range(SHARDS)])
    return placed.select("d.doc_id", "d.source", "d.n_chars", "slot", "shard")


def _oracle() -> str:
    """The generated table as a list, and the hash in SQL."""
    table = ", ".join(map(str, lookup_table([f"shard-{k:03d}" for k in range(SHARDS)])))
    return f"""
WITH t AS (SELECT [{table}] AS shards),
s AS (SELECT doc_id, source, n_chars, (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS})::BIGINT AS slot FROM documents)
SELECT doc_id, source, n_chars, slot, printf('shard-%03d', shards[slot + 1]) AS shard FROM s, t
"""


ORACLE_SQL = _oracle()
