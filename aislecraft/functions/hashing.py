"""Seeded randomness that does not depend on partitioning: md5 of the seed and the keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(2**32)


def hash_int(seed: object, *keys: Column) -> Column:
    """An integer from 0 to 2^32 - 1."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_long(seed: object, *keys: Column) -> Column:
    """An integer from 0 to 2^60 - 1."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_uniform(seed: object, *keys: Column) -> Column:
    """A number from 0 (inclusive) to 1 (exclusive)."""
    return hash_int(seed, *keys) / F.lit(SCALE)
