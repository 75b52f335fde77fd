"""Placement of rows on shards by a permutation-filled lookup table (DataFrame and SQL functions only).

Every shard prefers the slots of a prime-sized table in an order of its own, ``(offset + j * step) mod size`` from two
hashes of its name. The shards take turns; in its turn a shard claims the first slot of its order that is still free. A row
goes to the shard that holds slot ``hash(key) mod size``. When a shard leaves or joins, nearly all slots keep their shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots a shard has at least, on average; its share of slots is then within about 1 % of its due.
SLOTS_PER_SHARD = 128


def _prime_from(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], size: int | None = None, weights: Sequence[int] | None = None) -> list[int]:
    """The number of the shard that holds each slot. It depends on the names alone, so its size is that of a setting.

    ``size`` is raised to the next prime; ``weights`` gives a shard several claims in a round.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    size = _prime_from(max(size or SLOTS_PER_SHARD * len(shards), len(shards)))
    turns = [k for k, w in enumerate(weights or [1] * len(shards)) for _ in range(w)]
    if not turns:
        raise ValueError("one shard at least needs a weight above 0")
    at = [_hash(f"offset:{name}") % size for name in shards]
    step = [_hash(f"step:{name}") % max(1, size - 1) + 1 for name in shards]
    table, left = [-1] * size, size
    while left:
        for k in turns[:left]:
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
        left -= len(turns[:left])
    return table


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key; a null key has the slot of the empty string."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(size)).cast("int")


def place(
    docs: DataFrame,
    shards: Sequence[str],
    key: str = "doc_id",
    size: int | None = None,
    weights: Sequence[int] | None = None,
) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``; columns of these names, in whatever case, are replaced, all others stay.

    The table is broadcast: it has a row per slot, bounded by the number of shards whatever the size of ``docs``, so a row
    is placed without a shuffle. Equal keys share a shard; a null key goes where the empty string goes; repeated rows stay
    repeated; an empty table gives no rows.
    """
    table = lookup_table(shards, size, weights)
    names = F.split(F.lit("\n".join(shards[k] for k in table)), "\n")
    slots = docs.sparkSession.range(1).select(F.posexplode(names).alias("slot", "shard"))
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    placed = docs.select(*[F.col(f"`{c}`") for c in kept], slot_of(F.col(key), len(table)).alias("slot"))
    return placed.join(F.broadcast(slots), "slot").select(*[F.col(f"`{c}`") for c in kept], "slot", "shard")
