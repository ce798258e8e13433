"""Seeded pseudo-random order of rows that depends on the row key alone, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS_PER_PARTITION = 16


def hash_key(seed: int | Column, *ids: Column) -> Column:
    seed_col = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed_col, *[c.cast("string") for c in ids]))


def slot_digits(partitions: int) -> int:
    """Leading hex digits that cut a hash order into enough slots to fill so many partitions evenly."""
    digits = 1
    while 16**digits < SLOTS_PER_PARTITION * partitions:
        digits += 1
    return digits


def hash_slot(key: Column, digits: int | Column) -> Column:
    """Leading digits of a hash key: ordering by key is ordering by (slot, key)."""
    return F.substring(key, F.lit(1), digits if isinstance(digits, Column) else F.lit(digits))
