"""Consistent placement by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, from two hashes of its name. Shards take
turns claiming their next free slot until the table is full, so shares differ by one slot at most (for equal weights)
and a shard that comes or goes moves little else. A row's slot is a hash of its key; the table is joined as a
broadcast of `size` small rows, a bound that doesn't depend on the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SIZE = 65_537
SHARDS = tuple(f"shard-{k:04d}" for k in range(64))
#: The largest table that is broadcast: 16 bytes a slot.
MOST_SLOTS = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's permutation of the slots."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def lookup_table(shards: Sequence[str] = SHARDS, size: int = SIZE, weights: Sequence[int] | None = None) -> list[int]:
    """The shard (its place in shards) of every slot. weights: slots claimed in a turn."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not is_prime(size) or size < len(shards) or size > MOST_SLOTS:
        raise ValueError(f"the table size must be a prime from the number of shards to {MOST_SLOTS}")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("each shard needs a weight of 1 at least")
    place, step = (list(x) for x in zip(*(preference(s, size) for s in shards), strict=True))
    table, free = [-1] * size, size
    while free:
        for k, turns in enumerate(weights):
            for _ in range(min(turns, free)):
                at = place[k]
                while table[at] >= 0:
                    at = (at + step[k]) % size
                table[at] = k
                place[k] = (at + step[k]) % size
                free -= 1
    return table


def slot(key: Column, size: int, fallback: Column | None = None) -> Column:
    """Null keys are placed by the fallback, so that they don't meet in one shard."""
    hashed = F.xxhash64(key) if fallback is None else F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(fallback))
    return F.pmod(hashed, F.lit(size))


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = SIZE, weights: Sequence[int] | None = None, into: str = "shard", fallback: str | None = None) -> DataFrame:
    """df with the column `into`, replaced if df has it: the name of each row's shard.

    Repeated rows and equal keys share a shard. Null keys go by the fallback column, if there is one, else to one shard.
    """
    (name,) = common.fresh(df, "slot")
    rows = pa.table({name: pa.array(range(size), pa.int32()), into: pa.array([shards[k] for k in lookup_table(shards, size, weights)])})
    table = F.broadcast(df.sparkSession.createDataFrame(rows))
    at = slot(F.col(f"`{key}`"), size, F.col(f"`{fallback}`") if fallback else None).cast("int")
    names = [c for c in df.columns if c.lower() != into.lower()]
    return df.withColumn(name, at).drop(into).join(table, name).select(*[F.col(f"`{c}`") for c in names], F.col(f"`{into}`"))
