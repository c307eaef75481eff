"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size, given by an offset and a
step from its name's digest. Shards take turns; each claims its first preferred slot that is still
free, until the table is full. Shards then own slot counts that differ by at most one, and adding or
removing a shard moves few slots besides its own. The table has a fixed size that does not grow with
the data, so it is broadcast; a row's key is hashed to a slot and looked up there.

Defined results: a null key is hashed as the empty text; repeated keys go to one shard, unless a
salt column deals a hot key's rows out; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The size of the table (a prime) and its largest size that is broadcast.
SLOTS, MOST_SLOTS = 65_537, 1_000_003


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's index for each slot."""
    if not shards or len(set(shards)) != len(shards) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    if slots > 2 and any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at, step = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % slots)
        step.append(int.from_bytes(digest[8:16], "big") % (slots - 1) + 1)
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + step[i]) % slots
            owner[slot] = i
            at[i] = (slot + step[i]) % slots
            free -= 1
            if not free:
                break
    return owner


def slot_of(keys: list[Column], slots: int) -> Column:
    """The first 60 bits of the md5 of the keys' texts, modulo the number of slots."""
    text = F.concat_ws("\x1f", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots


def place(df: DataFrame, keys: list[Column], shards: list[str], slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with its slot and its shard's index. Columns of these names must not be there yet."""
    if slot in df.columns or shard in df.columns:
        raise ValueError(f"{slot} or {shard} is a column already")
    filled = json.dumps(lookup_table(shards, slots))
    lookup = df.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(filled), "array<int>")).alias(slot, shard)).withColumn(slot, F.col(slot).cast("long"))
    placed = df.withColumn(slot, slot_of(keys, slots))
    return placed.join(F.broadcast(lookup), slot)  # at most MOST_SLOTS rows of 12 bytes


def shard_documents(docs: DataFrame, shards: list[str] | None = None) -> DataFrame:
    """doc_id, slot, shard for every row, by id."""
    shards = shards or [f"shard-{i:03d}" for i in range(64)]
    return place(docs.select("doc_id"), [F.col("doc_id")], shards).select("doc_id", "slot", F.col("shard").cast("long").alias("shard"))
