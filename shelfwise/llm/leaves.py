"""Partitions with overlapping borders, for exact joins within a radius.

A level halves its rows; rows close to the border on the outer side are copied to the inner side.
Two rows within the radius are then together on at least one side of every level, so in at least
one leaf.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def levels_for(rows: int, leaf: int) -> int:
    return max(0, math.ceil(math.log2(max(rows, 1) / leaf)))


def route(outer: list[np.ndarray], near: list[np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their leaves: bit ``l`` is set on the outer side of level ``l``.

    ``outer[l]`` says which rows are outside, ``near[l]`` which of these are also copied inside.
    """
    row, leaf = np.arange(rows), np.zeros(rows, np.int64)
    for level, (out, close) in enumerate(zip(outer, near, strict=True)):
        copied = close[row]
        inner = np.where(out[row], leaf | (1 << level), leaf)
        row, leaf = np.concatenate([row, row[copied]]), np.concatenate([inner, leaf[copied]])
    return row, leaf


def in_blocks(routed: DataFrame, keys: list[str], member: str, limit: int) -> DataFrame:
    """Add ``block``, ``block_i`` and ``block_j`` so that no group of ``keys`` plus the last two is large.

    A leaf of more than ``limit`` rows, which no border could split, is cut into blocks by a hash of
    ``member``; each pair of blocks is a group. Every two rows of the leaf still meet.
    """
    large = routed.groupBy(*keys).agg(F.count("*").alias("leaf_rows")).where(f"leaf_rows > {limit}")
    parts = F.coalesce(F.ceil(F.col("leaf_rows") / (limit / 2)).cast("long"), F.lit(1).cast("long"))
    return (
        routed.join(large, keys, "left")
        .withColumn("parts", parts)
        .withColumn("block", F.pmod(F.xxhash64(member), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("block_i", F.least("block", "other"))
        .withColumn("block_j", F.greatest("block", "other"))
        .drop("leaf_rows", "parts", "other")
    )
