"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table: a start and a step, both
hashed from its name, so that the order visits every slot once. Shards take turns; in a turn a shard claims its
most preferred free slot (weight turns per round). A key's shard is the entry at its hash modulo the table's
size. The table has a fixed size, so it is broadcast and a placement is one lookup in a hash join, without a
shuffle. When a shard leaves, nearly all keys of the others stay where they are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Slots; a prime well above a hundred times the shards.
SLOTS = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[str]:
    """The shard of each slot. Depends on names and weights alone, not on their order."""
    names = sorted(set(shards))
    if not names:
        raise ValueError("no shards")
    if not is_prime(slots) or slots < len(names):
        raise ValueError("the number of slots must be a prime, and at least the number of shards")
    at, step = {}, {}
    for name in names:
        digest = hashlib.sha256(name.encode()).digest()
        at[name] = int.from_bytes(digest[:8], "big") % slots
        step[name] = int.from_bytes(digest[8:16], "big") % (slots - 1) + 1
    table: list[str | None] = [None] * slots
    free = slots
    while free:
        for name in names:
            for _ in range((weights or {}).get(name, 1)):
                if not free:
                    break
                while table[at[name]] is not None:
                    at[name] = (at[name] + step[name]) % slots
                table[at[name]] = name
                free -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot, from the first 60 bits of the MD5 of its text form, which other engines can compute too; null counts as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, table: list[str], column: str = "shard") -> DataFrame:
    return spark.createDataFrame(list(enumerate(table)), f"slot int, {column} string")


def place(rows: DataFrame, key: str, shards: list[str], *, slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """rows with slot and shard (columns of these names are replaced). Each row is placed on its own: repeated and hot keys need no grouping; no rows give no rows."""
    table = F.broadcast(table_frame(rows.sparkSession, fill_table(shards, slots, weights)))
    mine = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return mine.join(table, "slot", "left").select(*(c for c in mine.columns if c != "slot"), "slot", "shard")


def op5_sharding(docs: DataFrame, n: int = 64) -> DataFrame:
    """Each document's slot and shard of n, and its shard when the first one is lost.

    A null id is placed as the empty string is; repeated ids share a shard; texts and other columns are not
    read, so their names don't matter; an empty table gives no rows. There are no ties: each slot has one shard.
    """
    names = [f"shard-{i:03d}" for i in range(n)]
    placed = place(docs.select("doc_id"), "doc_id", names)
    without = F.broadcast(table_frame(docs.sparkSession, fill_table(names[1:]), "shard_after_loss"))
    out = placed.join(without, "slot", "left")
    return out.select("doc_id", "slot", "shard", "shard_after_loss", (F.col("shard") != F.col("shard_after_loss")).alias("moved"))


def op5_sql(n: int = 64) -> str:
    """The same by both tables as lists."""
    names = [f"shard-{i:03d}" for i in range(n)]
    listed = lambda table: "string_split('" + ",".join(name[-3:] for name in table) + "', ',')"
    return f"""
WITH t AS (SELECT {listed(fill_table(names))} AS a, {listed(fill_table(names[1:]))} AS b),
d AS (SELECT doc_id, CAST(CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:15] AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || a[slot + 1] AS shard, 'shard-' || b[slot + 1] AS shard_after_loss, a[slot + 1] <> b[slot + 1] AS moved FROM d, t"""
