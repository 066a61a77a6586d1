"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm.order import free_name, numbered
from spanledger.llm.textscan import mix
from spanledger.operators.support import Shelf

SHARDS, ROUNDS, SEED = 24, 4, 20240601


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed))


def permuted(row: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The place of each row number below n in the shuffle, also below n and different for each.

    A balanced Feistel network permutes the least square of a power of two that holds n; places beyond
    n walk on along their cycle until they fall below it.
    """
    bits = np.uint64(_half_bits(n))
    low = (np.uint64(1) << bits) - np.uint64(1)

    def once(x):
        left, right = x >> bits, x & low
        for key in _keys(seed):
            left, right = right, left ^ (mix(right ^ key) & low)
        return (left << bits) | right
    out = once(row.astype(np.uint64))
    while (away := out >= np.uint64(n)).any():
        out[away] = once(out[away])
    return out.astype(np.int64)


def row_at(place: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The inverse of ``permuted``: which row number stands at a place, so at (shard, slot)."""
    bits = np.uint64(_half_bits(n))
    low = (np.uint64(1) << bits) - np.uint64(1)

    def once(x):
        left, right = x >> bits, x & low
        for key in _keys(seed)[::-1]:
            left, right = right ^ (mix(left ^ key) & low), left
        return (left << bits) | right
    out = once(place.astype(np.uint64))
    while (away := out >= np.uint64(n)).any():
        out[away] = once(out[away])
    return out.astype(np.int64)


def _place(n: int, seed: int):
    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permuted(row.to_numpy(np.int64), n, seed))
    return place


def sharded(docs: DataFrame, by: list[Column], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows with ``row_number``, ``shard`` and ``slot``.

    Row numbers follow ``by``. Place p of the shuffle is slot p div shards of shard p mod shards, so counts
    differ by at most one and slots are gapless. Rows equal in ``by`` are interchangeable. Columns of those
    names are replaced; an empty table gives no rows.
    """
    shelf = Shelf(docs.sparkSession)
    rows = numbered(docs.drop("row_number", "shard", "slot"), by, shelf)
    n = docs.sparkSession.read.parquet(f"{shelf.root}/ranged").count()
    p = free_name(rows, "place")
    return rows.withColumn(p, _place(n, seed)("row_number")).withColumn("shard", (F.col(p) % shards).cast("int")).withColumn(
        "slot", F.floor(F.col(p) / shards).cast("long")).drop(p)


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder for each shard, rows in the order of their slots."""
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
