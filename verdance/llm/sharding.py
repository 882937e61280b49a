"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: offset, offset + skip, offset + 2 skip, ...,
which visits each slot once because the size is prime. Shards take turns in claiming the next slot of their order
that is still free, until the table is full. A row's shard is the table's entry at its key's hash: one join with a
broadcast table whose size is the prime and nothing else. Shards get slots that differ by one at most, and removing a
shard moves little besides the rows of that shard.

Edge cases: a null key is hashed as the empty text; repeated keys go to the same shard; texts are not read; columns of
other names pass through, also those called like ``slot`` or ``shard``: then the new ones get underscores before their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import free, table

#: Slots of the table, a prime: over a hundred for each shard keeps the spread even when shards go.
SIZE = 2503
#: Shards of the query.
SHARDS = tuple(f"shard-{k:02d}" for k in range(24))


def digest_number(text: str) -> int:
    """60 bits of a text's md5, as other engines can compute them."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: tuple[str, ...], size: int = SIZE) -> list[int]:
    """The number of the shard at each slot."""
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the size must be a prime")
    if not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("there must be at least one shard, at most one a slot, and names must differ")
    at = [digest_number(f"offset:{s}") % size for s in shards]
    skip = [digest_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    slots, free = [-1] * size, size
    while True:
        for k in range(len(shards)):
            while slots[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            slots[at[k]] = k
            free -= 1
            if not free:
                return slots


def slot_of(key: Column, size: int = SIZE) -> Column:
    text = F.concat(F.lit("key:"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("int")


def shard(rows: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``, or with ``_slot`` and so on where columns of that name, in any case, are there."""
    spark, (slot, home) = rows.sparkSession, free(rows, "slot", "shard")
    filled = [(at, shards[k]) for at, k in enumerate(fill(shards, size))]
    lookup = spark.createDataFrame(filled, f"{slot} int, {home} string")
    # the table has ``size`` rows, however many rows are placed
    return rows.withColumn(slot, slot_of(F.col(f"`{key}`"), size)).join(F.broadcast(lookup), slot).select(*[F.col(f"`{c}`") for c in rows.columns], slot, home)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """(doc_id, slot, shard) of every document."""
    return shard(table(spark, sf_dir, "documents").select("doc_id"))


#: The table is filled by recursion, a slot a step; ``free`` has a bit for each slot that isn't claimed yet.
ORACLE = rf"""
WITH RECURSIVE p AS (
  SELECT k, CAST('0x' || substr(md5('offset:shard-' || lpad(CAST(k AS VARCHAR), 2, '0')), 1, 15) AS BIGINT) % {SIZE} AS start,
         CAST('0x' || substr(md5('skip:shard-' || lpad(CAST(k AS VARCHAR), 2, '0')), 1, 15) AS BIGINT) % {SIZE - 1} + 1 AS skip FROM range({len(SHARDS)}) r(k)),
l AS (SELECT k, list(CAST((start + n * skip) % {SIZE} AS INTEGER) ORDER BY n) AS prefer FROM p, range({SIZE}) r(n) GROUP BY k),
f(step, free, slot) AS (
  SELECT 0, CAST(repeat('1', {SIZE}) AS BIT), -1
  UNION ALL
  SELECT step + 1, set_bit(free, c, 0), c FROM (
    SELECT step, free, list_filter(prefer, lambda x: get_bit(free, x) = 1)[1] AS c FROM f JOIN l ON l.k = step % {len(SHARDS)} WHERE step < {SIZE}))
SELECT doc_id, slot, 'shard-' || lpad(CAST((step - 1) % {len(SHARDS)} AS VARCHAR), 2, '0') AS shard
FROM documents JOIN f ON slot = CAST('0x' || substr(md5('key:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SIZE}
"""
