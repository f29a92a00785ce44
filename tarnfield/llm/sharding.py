"""Shard placement by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table of prime size, given by
an offset and a step hashed from its name.  Shards take turns, each claiming
the first free slot of its permutation, until the table is full.  A row's key
is hashed to a slot; the table (fixed size) is broadcast, so placement is one
lookup without a shuffle.  Removing a shard moves few rows of the others.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.common import free_name, own_columns, read

#: Prime; at least a hundred times the shards for even shares.
TABLE_SIZE = 65_537
N_SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Mapping[str, float], size: int = TABLE_SIZE) -> list[str]:
    """Shard name by slot. shards: positive weight by name; a shard of half the weight gets every other turn."""
    names = sorted(shards)
    if not names or not _is_prime(size) or len(names) > size or min(shards.values()) <= 0:
        raise ValueError("need shards of positive weight and a prime size no smaller than their number")
    at = [xxhash.xxh64_intdigest(n, 1) % size for n in names]
    step = [xxhash.xxh64_intdigest(n, 2) % (size - 1) + 1 for n in names]
    most = max(shards.values())
    credit = [0.0] * len(names)
    table, free = [-1] * size, size
    while free:
        for k, name in enumerate(names):
            credit[k] += shards[name] / most
            if credit[k] < 1:
                continue
            credit[k] -= 1
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return [names[k] for k in table]


def slot_of(key: Column, instead: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key; where it is null, of `instead` (null there counts as empty)."""
    text = F.coalesce(key.cast("string"), instead.cast("string"), F.lit(""))
    return F.pmod(F.xxhash64(text), F.lit(size)).cast("int")


def place(
    df: DataFrame, shards: Mapping[str, float], key_col: str = "doc_id", instead_col: str = "text", size: int = TABLE_SIZE
) -> DataFrame:
    """df with columns slot and shard (replaced where df has them).

    Equal keys go to one shard; rows without a key are spread by instead_col;
    empty tables stay empty. The broadcast table has `size` rows whatever df holds.
    """
    rows = [(i, name) for i, name in enumerate(lookup_table(shards, size))]
    at, number, shard = (free_name(n, df) for n in ("slot_of_key", "slot_number", "shard_name"))
    table = df.sparkSession.createDataFrame(rows, f"{number} int, {shard} string")
    own = [c for c, n in zip(own_columns(df), df.columns) if n.lower() not in ("slot", "shard")]
    placed = df.withColumn(at, slot_of(F.col(key_col), F.col(instead_col), size))
    placed = placed.join(F.broadcast(table), F.col(at) == F.col(number))
    return placed.select(*own, F.col(at).alias("slot"), F.col(shard).alias("shard"))


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write placed rows as Parquet, one folder for each shard; slots spread a large shard over several files."""
    part = F.pmod(F.col("slot"), F.lit(files_per_shard))
    placed.repartition("shard", part).write.partitionBy("shard").parquet(path)


def shares(table: list[str]) -> dict[str, int]:
    names, counts = np.unique(np.array(table), return_counts=True)
    return dict(zip(names.tolist(), counts.tolist()))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = {f"shard-{i:03d}": 1.0 for i in range(N_SHARDS)}
    return place(read(spark, sf_dir, "documents"), shards).select("doc_id", "slot", "shard")
