"""Sharding (op 3) [native]: a permutation-filled lookup table (Eisenbud et al., 2016).

Every shard has an order of preference over the slots of a prime-sized table, an
arithmetic progression whose offset and step are hashes of its name. Shards take turns,
each claiming the first slot in its order that is still free, until the table is full;
shares differ by one slot at most, and few slots move when a shard comes or goes. A
row's slot is a hash of its key, and its shard is read from the broadcast table: placing
a row takes constant time and no shuffle of rows.

The table has ``slots`` entries whatever the data's size, so the broadcast is bounded.
It is configuration: the turns are a loop over its entries on the driver. Rows are
placed by DataFrame functions alone.

Defined results: a null key hashes as the text ``null`` in angle brackets, and shares a
shard with that text; repeated keys share a shard; long keys are hashed whole; columns
called ``slot`` and ``shard``, in any case of letters, are replaced, even if one is the
key; other columns are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, quoted

SHARDS, SLOTS = 32, 4099


def shard_names(number: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(number)]


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    """The first eight hexadecimal digits of the MD5 of ``text``."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the number of the shard that claimed it."""
    if not _is_prime(slots) or not 0 < len(names) <= slots or len(set(names)) < len(names):
        raise ValueError("slots must be a prime, with as many different shards at most")
    step = [_number(f"step:{x}") % (slots - 1) + 1 if slots > 1 else 0 for x in names]
    at = [_number(f"offset:{x}") % slots for x in names]
    owner = [-1] * slots
    for turn in range(slots):
        shard = turn % len(names)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + step[shard]) % slots
        owner[at[shard]] = shard
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: the MD5 of its text, its first eight hexadecimal digits, modulo the table."""
    text = F.coalesce(key.cast("string"), F.lit("<null>"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def table_frame(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """``slot, shard`` as a DataFrame of ``slots`` rows."""
    owners = F.split(F.lit(",".join(map(str, lookup_table(names, slots)))), ",")
    rows = spark.range(1).select(F.posexplode(owners).alias("slot", "number"))
    return rows.select("slot", F.element_at(F.array(*map(F.lit, names)), F.col("number").cast("int") + 1).alias("shard"))


def place(df: DataFrame, key: str, names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with its rows' ``slot`` and ``shard``; columns of these names are replaced."""
    names = names or shard_names()
    kept = [quoted(c) for c in df.columns if c.lower() not in ("slot", "shard")]
    place = fresh_name(df, "place")
    table = F.broadcast(table_frame(df.sparkSession, names, slots).select(F.col("slot").alias(place), "shard"))
    return df.select(*kept, slot_of(quoted(key), slots).alias("slot")).join(table, F.col("slot") == F.col(place)).drop(place)


#: DuckDB: the same turns as a recursion over the list of owners, then the same placement.
ORACLE = f"""
WITH RECURSIVE names AS (SELECT i, printf('shard-%05d', i) AS name FROM range({SHARDS}) t(i)),
progressions AS (
  SELECT i, ('0x' || left(md5('offset:' || name), 8))::BIGINT % {SLOTS} AS first,
         ('0x' || left(md5('step:' || name), 8))::BIGINT % {SLOTS - 1} + 1 AS step FROM names),
turns AS (
  SELECT 0 AS turn, list_transform(range({SLOTS}), lambda x: -1) AS owner
  UNION ALL
  SELECT turn + 1, list_transform(owner, lambda x, s: CASE WHEN s - 1 = claimed THEN i ELSE x END)
  FROM (
    SELECT turn, owner, p.i,
           (p.first + p.step * list_min(list_filter(range({SLOTS}), lambda j: owner[(p.first + p.step * j) % {SLOTS} + 1] < 0))) % {SLOTS} AS claimed
    FROM turns JOIN progressions p ON p.i = turn % {SHARDS} WHERE turn < {SLOTS})),
slots AS (SELECT unnest(range({SLOTS})) AS slot, unnest(owner) AS i FROM turns WHERE turn = {SLOTS})
SELECT d.doc_id, d.slot::INTEGER AS slot, n.name AS shard
FROM (SELECT doc_id, ('0x' || left(md5(coalesce(doc_id::VARCHAR, '<null>')), 8))::BIGINT % {SLOTS} AS slot FROM documents) d
JOIN slots s ON s.slot = d.slot JOIN names n ON n.i = s.i
"""
