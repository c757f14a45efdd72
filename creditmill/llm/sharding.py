"""Placement on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size: (offset + j * step) mod size. The shards take turns and each claims its
next free slot until no slot is left, so all shards own the same number of slots (within
one) and few slots change owner when a shard comes or goes. A key is hashed to a
slot; the table, of a size that the caller fixes, is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime well above a hundred slots for each shard.
TABLE_SIZE = 4099
SHARDS = tuple(f"shard-{n:02d}" for n in range(32))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str, at: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[at : at + 8], 16)


def fill_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """Slot to index of its shard. Its work is bounded by the table's size, not by data."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table's size is a prime, no less than the number of shards")
    places = [(_number(s, 0) % size, _number(s, 8) % (size - 1) + 1 if size > 2 else 1) for s in shards]
    owner, turn, at = [-1] * size, 0, [0] * len(shards)
    for _ in range(size):
        offset, step = places[turn]
        while owner[slot := (offset + at[turn] * step) % size] >= 0:
            at[turn] += 1
        owner[slot] = turn
        turn = (turn + 1) % len(shards)
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 32 bits of the MD5 of its text; a null key is hashed as an empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % size).cast("int")


def table_frame(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """(shard_slot, shard_number, shard_name), one row per slot."""
    owners = ",".join(map(str, fill_table(shards, size)))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("shard_slot", "owner"))
    names = F.split(F.lit("\n".join(shards)), "\n")
    number = F.col("owner").cast("int")
    return rows.select("shard_slot", number.alias("shard_number"), F.element_at(names, number + 1).alias("shard_name"))


def place(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Append shard_slot, shard_number and shard_name to every row; no row moves.

    The broadcast holds ``size`` rows. Equal keys share a slot, repeated rows stay, null
    keys go where the empty text goes, an empty table stays empty; columns of ``df`` with one of the
    three names are replaced.
    """
    kept = df.drop("shard_slot", "shard_number", "shard_name")
    slotted = kept.withColumn("shard_slot", slot_of(kept[key], size))
    return slotted.join(F.broadcast(table_frame(df.sparkSession, shards, size)), "shard_slot").select(
        *[slotted[c] for c in kept.columns], "shard_slot", "shard_number", "shard_name"
    )


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """Write one folder per shard. Rows are dealt by their content besides the shard, so a key
    that most rows share still fills ``files_per_shard`` tasks."""
    salt = F.pmod(F.xxhash64(*placed.columns), F.lit(files_per_shard))
    placed.repartition("shard_name", salt).write.partitionBy("shard_name").parquet(path)


def oracle_sql(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> str:
    """The placement of documents in DuckDB: the table is filled by a recursive query."""
    names = ", ".join(f"({n}, '{s}')" for n, s in enumerate(shards))
    number = "CAST(concat('0x', substr(md5(name), {at}, 8)) AS BIGINT)"
    return f"""
WITH RECURSIVE shards(number, name) AS (VALUES {names}),
orders AS (
  SELECT list({number.format(at=1)} % {size} ORDER BY number) AS offsets,
    list({number.format(at=9)} % {size - 1} + 1 ORDER BY number) AS steps FROM shards
),
filling(taken, slot, owners) AS (
  SELECT 0, -1, list_transform(range({size}), lambda x: -1) FROM orders
  UNION ALL
  SELECT taken + 1, 0, list_concat(list_concat(owners[1:free], [taken % {len(shards)}]), owners[free + 2:])
  FROM (
    SELECT taken, owners, (offsets[turn] + steps[turn] * list_position(
        list_transform(range({size}), lambda j: owners[(offsets[turn] + steps[turn] * j) % {size} + 1]), -1)
        - steps[turn]) % {size} AS free
    FROM (SELECT *, taken % {len(shards)} + 1 AS turn FROM filling, orders WHERE taken < {size}) AS now
  ) AS claimed
),
owned AS (SELECT owners FROM filling WHERE taken = {size})
SELECT doc_id, CAST(slot AS INTEGER) AS shard_slot, CAST(owners[slot + 1] AS INTEGER) AS shard_number,
  name AS shard_name
FROM (SELECT doc_id, CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {size} AS slot
      FROM documents) AS slotted
CROSS JOIN owned JOIN shards ON number = owners[slot + 1]
"""
