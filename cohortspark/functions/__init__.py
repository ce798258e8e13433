"""Column expressions shared by the operators."""

from cohortspark.functions.columns import (
    class_index,
    class_name,
    clip_lower,
    finite_or_zero,
    nan_to_null,
    ratio,
    strip_whitespace,
)
from cohortspark.functions.keys import hash_key, hash_slot

__all__ = [
    "class_index",
    "class_name",
    "clip_lower",
    "finite_or_zero",
    "hash_key",
    "hash_slot",
    "nan_to_null",
    "ratio",
    "strip_whitespace",
]
