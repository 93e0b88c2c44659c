"""Place rows on shards through a permutation-filled lookup table.

Each shard has its own preference order of the slots of a prime-sized table: offset, offset + skip,
offset + 2 * skip, ... Shards take turns to claim their next free slot until the table is full, so
every shard holds the same number of slots give or take one, and adding or removing a shard moves
little else. A row's slot is a hash of its key; its shard is one lookup in the broadcast table.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537  # prime; bounds what is broadcast, whatever the data
HEX_DIGITS = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX_DIGITS], 16)


def lookup_table(shards: list[str], table_size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be a list of different names, and not empty")
    if table_size < len(shards) or any(table_size % d == 0 for d in range(2, int(table_size**0.5) + 1)):
        raise ValueError("table_size must be a prime not below the number of shards")
    place = [_number(f"offset:{s}") % table_size for s in shards]
    skip = [_number(f"skip:{s}") % (table_size - 1) + 1 for s in shards]
    owner, free = [-1] * table_size, table_size
    while True:
        for i in range(len(shards)):
            slot = place[i]
            while owner[slot] >= 0:
                slot = (slot + skip[i]) % table_size
            owner[slot] = i
            place[i] = (slot + skip[i]) % table_size
            free -= 1
            if not free:
                return owner


def lookup_frame(spark: SparkSession, shards: list[str], table_size: int = TABLE_SIZE) -> DataFrame:
    owner = lookup_table(shards, table_size)
    frame = pd.DataFrame({"slot": range(table_size), "shard": owner, "shard_name": [shards[i] for i in owner]})
    return spark.createDataFrame(frame, "slot long, shard int, shard_name string")


def assign_shards(
    docs: DataFrame, shards: list[str], *, key_col: str = "doc_id", table_size: int = TABLE_SIZE
) -> DataFrame:
    """``docs`` with slot, shard and shard_name; earlier columns of these names are replaced.

    Equal keys go to one shard. A NULL key counts as the empty text. The table has ``table_size``
    rows and no more, so broadcasting it is safe at any size of the data; no row of ``docs`` is shuffled.
    """
    made = ("slot", "shard", "shard_name")
    digest = F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit("")))
    number = F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long")
    own = docs.select(*[c for c in docs.columns if c not in made])
    table = lookup_frame(docs.sparkSession, shards, table_size)
    placed = own.withColumn("slot", F.pmod(number, F.lit(table_size)))
    return placed.join(F.broadcast(table), "slot").select(*own.columns, *made)


def write_shards(docs: DataFrame, path: str, shards: list[str], files_per_shard: int = 8, **options) -> None:
    """Write one folder per shard, each dealt over ``files_per_shard`` tasks."""
    placed = assign_shards(docs, shards, **options)
    piece = F.pmod(F.xxhash64("slot"), F.lit(files_per_shard))
    spread = placed.repartition(len(shards) * files_per_shard, "shard", piece)
    spread.write.partitionBy("shard").parquet(path)
