"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own preference order of the slots of a table of prime size: start and stride
come from hashes of the shard's name, and a stride below a prime visits every slot. Shards take
turns; in its turn a shard claims the next slot of its order that is free, until the table is full.
Shares differ by at most one slot, and adding or removing a shard moves few slots besides its own.

A row's slot is the hash of its key modulo the table size. The table has a fixed number of
entries, so it is broadcast, and placement is one lookup without a shuffle; a hot key or equal
rows need no gathering.

Defined cases: rows with equal keys are on one shard; a null key is placed as the empty text; an
empty table gives an empty result; no shard, a repeated name or a size that is not a prime of at
least as many slots raises ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.types import quoted

#: Slots of the table: a prime, some hundred times the number of shards.
SLOTS = 65_537


def _hash(text: str) -> int:
    return int(sha256(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, and at least one")
    if slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not a prime number of at least {len(shards)} slots")
    at = [_hash(f"start:{name}") % slots for name in shards]
    stride = [_hash(f"stride:{name}") % (slots - 1) + 1 for name in shards]
    owner = np.full(slots, -1, dtype=np.int64)
    turn = 0
    for _ in range(slots):
        shard = turn % len(shards)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + stride[shard]) % slots
        owner[at[shard]] = shard
        turn += 1
    return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of its SHA-256 modulo the table size."""
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The key of every row with its ``slot`` and ``shard``.

    A made column gets an underscore behind its name if the key has that name.
    """
    owner = lookup_table(shards, slots)
    made = {name: name + "_" * (name == key.lower()) for name in ("slot", "shard")}
    table = df.sparkSession.createDataFrame(
        list(zip(range(slots), owner.tolist(), strict=True)), "__slot int, __shard int"
    )
    own = df.select(F.col(quoted(key)).alias("__key"), slot(F.col(quoted(key)), slots).alias("__slot"))
    return own.join(F.broadcast(table), "__slot").select(
        F.col("__key").alias(key), *(F.col(f"__{name}").alias(to) for name, to in made.items())
    )
