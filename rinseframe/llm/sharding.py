"""Jump consistent hashing: stable keys to shards without a ring table.

The shard is a function of the key and the number of shards alone. When shards are
appended, a key either stays or moves into one of the new shards, and only the
necessary fraction moves (Lamping and Veach, "A fast, minimal memory, consistent
hash algorithm").

Defined results: a null key is a key like any other (all null keys share a shard);
equal keys share a shard; an empty table gives an empty table; input columns named
like an added column are replaced. Fewer than one shard is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinseframe.llm.frames import fresh, numbered, without


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key: candidates jump ahead until one passes the last shard."""
    key = keys.astype(np.uint64)
    shard = np.full(len(key), -1, dtype=np.int64)
    nxt = np.zeros(len(key), dtype=np.int64)
    active = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(active):
            shard[active] = nxt[active]
            key[active] = key[active] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((key[active] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            nxt[active] = ((shard[active] + 1) * step).astype(np.int64)
            active = active[nxt[active] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard as a column; keys of any type are mixed by a 64-bit hash first."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def shard(mixed: pd.Series) -> pd.Series:
        return pd.Series(jump(mixed.to_numpy(np.int64).view(np.uint64), shards))

    return shard(F.xxhash64(key))


def assign_shards(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """Add the shard of each row; no shuffle."""
    target = fresh(df, "shard_number")
    result = df.withColumn(target, shard_of(F.col(f"`{key}`"), shards))
    kept = [c for c in df.columns if c.lower() != name.lower()]
    return result.select(*[F.col(f"`{c}`") for c in kept], F.col(target).alias(name))


def slots(df: DataFrame, shard: str = "shard", name: str = "slot") -> DataFrame:
    """Add a gapless place within the shard, counted from 0, over all partitions."""
    return numbered(df, shard, name)


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard; the rows are not shuffled, each task writes into the shards it has rows of."""
    df.write.partitionBy(shard).parquet(path)


def sharded(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Rows with ``shard``, ``slot`` and the shard each gets when one more is appended (``grown_shard``)."""
    rows = assign_shards(without(df, "slot"), key, shards)
    return slots(assign_shards(rows, key, shards + 1, "grown_shard"))
