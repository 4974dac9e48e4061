"""Sharding by jump consistent hashing.

A stable key and the number of shards decide a row's shard; no table of a ring is kept. With
one more shard, a row either stays or moves to the new shard, and only the share that the new
shard is due moves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridscope.llm.common import staged, text_or_empty

#: Fixed values of the published jump hash: its generator's multiplier and its range.
MULTIPLIER, RANGE = 2862933555777941757, 1 << 31


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key among ``shards`` shards.

    All keys step together; those whose next jump leaves the shards are done. The number of
    steps is about the logarithm of ``shards``.
    """
    state = keys.astype(np.int64).view(np.uint64).copy()
    found, going, ahead = np.zeros(len(state), np.int64), np.arange(len(state)), np.zeros(len(state), np.int64)
    while len(going):
        found[going] = ahead
        state[going] = state[going] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = (state[going] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead = ((found[going] + 1) * (RANGE / draw)).astype(np.int64)
        stay = ahead < shards
        going, ahead = going[stay], ahead[stay]
    return found


def shard_of(key: Column, shards: int) -> Column:
    """Shard column of an integer key column. A null key counts as 0."""

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(jump(values.to_numpy(np.int64), shards), dtype="int32")

    return place(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, block_rows: int = 4096,
) -> DataFrame:
    """Place every row in a shard and number the rows of each shard from 0 without gaps.

    Returns ``key, size, text_crc32, shard, slot, grown_shard``: ``size`` is the text's UTF-8
    bytes plus one, ``grown_shard`` the shard with one shard more. The slots of a shard are
    dealt in blocks of about ``block_rows`` rows: rows are counted by block, blocks get their
    first slot by a running sum, and rows are numbered inside their block, so no task holds a
    whole shard, also if one key holds most rows. Blocks take rows by their place in the scan,
    which is written once, so a lost executor does not renumber anything.

    Null texts count as empty, null keys as 0; rows with equal keys share a shard and have
    slots of their own. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    facts = docs.select(
        F.col(key),
        (F.octet_length(text_or_empty(text)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("__row"),
    )
    placed = staged(
        facts.withColumn("shard", shard_of(F.col(key), shards)).withColumn("grown_shard", shard_of(F.col(key), shards + 1)),
        "shards",
    )
    blocks = max(1, -(-placed.count() // (block_rows * shards)))
    placed = placed.withColumn("__block", F.pmod(F.xxhash64("__row"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        placed.groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("__n"))
        .select("shard", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    )
    inside = Window.partitionBy("shard", "__block").orderBy("__row")
    return (
        placed.withColumn("__at", F.row_number().over(inside))
        .join(firsts, ["shard", "__block"])
        .select(
            key, "size", "text_crc32", "shard",
            (F.col("__first") + F.col("__at") - F.lit(1)).cast("long").alias("slot"), "grown_shard",
        )
    )
