"""Seeded, engine-independent randomness.

Every "random" choice is a pure function of (seed, row id), so a lost task
recomputes the same answer and the partitioning never shows in the result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(seed: str, *parts: Column | str) -> Column:
    """32 hex digits of md5("seed:part:part…"); uniform over distinct ids."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in columns]))


def hash_int(hex_hash: Column, digits: int = 13) -> Column:
    """The leading hex digits as a non-negative bigint."""
    return F.conv(F.substring(hex_hash, 1, digits), 16, 10).cast("bigint")


def hash_unit(hex_hash: Column) -> Column:
    """A double in [0, 1) from the first 52 bits."""
    return hash_int(hex_hash, 13) / F.lit(float(2**52))


def uniform_int(hex_hash: Column, low: int, high: int) -> Column:
    """A uniform integer in [low, high]."""
    return (F.lit(low) + hash_int(hex_hash, 13) % F.lit(high - low + 1)).cast("int")
