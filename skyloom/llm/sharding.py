"""Sharding by a permutation-filled lookup table (no Python on the data path).

Each shard has a preference order over the slots of a prime-sized table; the shards take turns, each
claiming the first slot of its order that is free. A document's slot is its key's hash modulo the table
size. The table has a fixed number of rows, so it is broadcast; adding or removing a shard moves few
documents besides those that it gains or loses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import free_name, own, table

#: A prime well over a hundred times the number of shards keeps shares within one percent.
TABLE_SIZE = 65_537
MOST_TABLE_SIZE = 1_000_003
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot, the place in ``shards`` of the one that holds it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not len(shards) <= size <= MOST_TABLE_SIZE or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime, at least the number of shards and at most 1000003")
    offset = [_number(s, "offset") % size for s in shards]
    step = [_number(s, "step") % (size - 1) + 1 for s in shards]
    slots, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            if not free:
                break
            while slots[offset[k]] >= 0:
                offset[k] = (offset[k] + step[k]) % size
            slots[offset[k]], free = k, free - 1
    return slots


def key_hash(key: Column) -> Column:
    """60 bits of the key's MD5: the same number in any SQL engine. Null counts as an empty key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def place(docs: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Every row of ``docs`` with a last column ``placement``, a struct of slot and shard.

    A column of that name stays as it is: the struct's then has an underscore more. Equal keys, nulls among them, go to
    one shard, so a key that few rows share should be chosen (``doc_id``, not a source). Row count and other columns stay
    as they are; an empty table gives no rows. No shuffle.
    """
    owners = ",".join(map(str, lookup_table(shards, size)))
    spark = docs.sparkSession
    owned = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    names = F.split(F.lit("\n".join(shards)), "\n")
    name, slot, shard = (free_name(docs, x) for x in ("placement", "__slot", "__shard"))
    owned = owned.select(F.col("slot").cast("long").alias(slot), F.element_at(names, F.col("owner").cast("int") + 1).alias(shard))
    out = docs.select(*own(docs), F.pmod(key_hash(F.col(key)), F.lit(size).cast("long")).alias(name))
    out = out.join(F.broadcast(owned), out[name] == owned[slot], "left")
    return out.select(*own(docs), F.struct(F.col(name).alias("slot"), F.col(shard).alias("shard")).alias(name))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE, files_per_shard: int = 1) -> None:
    """Write ``docs`` below ``path`` in one folder a shard; a shard's rows are dealt over ``files_per_shard`` tasks.

    The folders are named ``shard=``; where ``docs`` has a column ``shard``, that stays in the files and the folders'
    name has an underscore more. Null keys are one key; rows that share a key are dealt over their shard's
    files, so a hot key is no larger task than its shard's others. An empty table gives an empty folder.
    """
    placed = place(docs, key, shards, size)
    name = free_name(docs, "shard")
    placed = placed.select(*own(docs), F.col(f"{placed.columns[-1]}.shard").alias(name))
    part = F.pmod(F.monotonically_increasing_id(), F.lit(files_per_shard).cast("long"))
    placed.repartition(len(shards) * files_per_shard, name, part).write.partitionBy(name).parquet(path)


def op4_maglev_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document: doc_id, slot, shard."""
    return place(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "placement.slot", "placement.shard")


OP4_SQL = f"""
with owned as (select unnest(range(0, {TABLE_SIZE})) as slot, unnest(string_split('{",".join(map(str, lookup_table(SHARDS)))}', ','))::int as owner),
keyed as (select doc_id, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint % {TABLE_SIZE} as slot from documents)
select doc_id, slot, 'shard-' || lpad(cast(owner as varchar), 2, '0') as shard from keyed join owned using (slot)
"""
