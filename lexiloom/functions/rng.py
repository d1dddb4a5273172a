"""Randomness that depends on keys alone, never on partitioning or row order.

A draw is the SHA-256 of ``seed:key``; ranks compare the hex digits, uniform
numbers and buckets use the first eight of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: str | Column, *keys: Column | str) -> Column:
    """64 hex digits for sorting at random."""
    first = F.lit(seed) if isinstance(seed, str) else seed
    return F.sha2(F.concat_ws(":", first.cast("string"), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]), 256)


def number(hexed: Column) -> Column:
    """The first 32 bits of a draw as a bigint."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint")


def uniform(seed: str | Column, *keys: Column | str) -> Column:
    """A double in [0, 1)."""
    return number(draw(seed, *keys)) / F.lit(4294967296.0)


def bucket(n: int | Column, seed: str | Column, *keys: Column | str) -> Column:
    """An integer in [0, n)."""
    return number(draw(seed, *keys)) % (F.lit(n) if isinstance(n, int) else n)
