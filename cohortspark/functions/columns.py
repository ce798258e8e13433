"""Built-in column expressions; everything here stays inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_whitespace(c: Column) -> Column:
    """Remove all leading and trailing white space (``trim`` removes spaces only)."""
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clip_lower(c: Column, floor: float = 0.0) -> Column:
    """Values below ``floor`` become ``floor``; a missing value stays missing."""
    return F.when(c < floor, F.lit(float(floor))).otherwise(c)


def ratio(numerator: Column, denominator: Column, eps: float) -> Column:
    """``numerator / (denominator + eps)``, missing where the divisor is zero."""
    return F.try_divide(numerator, denominator + F.lit(eps))


def finite_or_zero(c: Column) -> Column:
    infinite = F.abs(c) == F.lit(float("inf"))
    return F.when(c.isNull() | F.isnan(c) | infinite, F.lit(0.0)).otherwise(c)


def class_index(c: Column, classes: Sequence[str]) -> Column:
    """Position of a class in the declared order; missing for an unknown class."""
    if not classes:
        raise ValueError("declare at least one class")
    out = F.when(c == classes[0], F.lit(0))
    for i, name in enumerate(classes[1:], start=1):
        out = out.when(c == name, F.lit(i))
    return out


def class_name(c: Column, classes: Sequence[str]) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in classes]), c.cast("int") + 1)
