"""Draws without replacement from counts: no row per item, however large a count is.

The cells of a group are the leaves of a binary tree over the bits of their hash keys. At every node the draws of
the node are split between its two halves by a hypergeometric variate, found by inversion with a uniform number that is
an md5 of the group's name and the node's path. A split depends on its node alone, so the result is the same wherever the tree
is cut into tasks, and it follows exactly the law of drawing single items.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.session import join_salted, sized

# A task splits the draws of about this many cells at once; groups with more are first cut at leading key digits, as few as do.
CELLS_PER_TASK = 1 << 16
# Key digits of one such cut: at most 16 ** HOP_DIGITS parts, whose sums are split in one task.
HOP_DIGITS = 3
KEY_BITS = 128
# Terms below this share of the largest one cannot move a double-precision sum.
NEGLIGIBLE = 1e-30


def hypergeometric(total: int, part: int, draws: int, u: float) -> int:
    """How many of ``draws`` items fall into ``part`` of ``total``: the smallest k whose distribution function exceeds ``u``."""
    low, high = max(0, draws - (total - part)), min(part, draws)
    if low == high:
        return low
    rest = total - part - draws
    mode = min(max((draws + 1) * (part + 1) // (total + 2), low), high)
    below, p, k = [], 1.0, mode
    while k > low and p > NEGLIGIBLE:
        p *= k * (rest + k) / ((part - k + 1) * (draws - k + 1))
        k -= 1
        below.append(p)
    first = k
    terms = [*reversed(below), 1.0]
    p, k = 1.0, mode
    while k < high and p > NEGLIGIBLE:
        p *= (part - k) * (draws - k) / ((k + 1) * (rest + k + 1))
        k += 1
        terms.append(p)
    goal = u * sum(terms)
    reached = 0.0
    for k, term in enumerate(terms, first):
        reached += term
        if reached > goal:
            return k
    return first + len(terms) - 1


def uniform(name: str, path: str) -> float:
    return int(hashlib.md5(f"{name}|{path}".encode()).hexdigest()[:12], 16) / 16**12


def split(name: str, keys: list[str], counts: list[int], draws: int, known: int) -> list[int]:
    """Draws of every cell. ``keys`` are ascending hex digits, equal in their first ``known`` bits."""
    width = 4 * len(keys[0])
    bits = [int(k, 16) for k in keys]
    sums = [0]
    for c in counts:
        sums.append(sums[-1] + c)
    out = [0] * len(keys)
    todo = [(0, len(keys), known, draws)]
    while todo:
        a, b, level, n = todo.pop()
        if n == 0:
            continue
        if n == sums[b] - sums[a]:
            out[a:b] = counts[a:b]
        elif b - a == 1:
            out[a] = n
        else:
            # Levels at which one half is empty split nothing.
            level = max(level, width - (bits[a] ^ bits[b - 1]).bit_length())
            mid = a + 1
            if level < width:
                mid = bisect_left(bits, (bits[b - 1] >> (width - level - 1)) << (width - level - 1), a, b)
            path = format(bits[a] >> (width - level), f"0{level}b") if level else ""
            left = hypergeometric(sums[b] - sums[a], sums[mid] - sums[a], n, uniform(name, path))
            todo += [(a, mid, level + 1, left), (mid, b, level + 1, n - left)]
    return out


def _split_groups(nodes: DataFrame, by: list[str], keep: list[str], draws: int | None = None) -> DataFrame:
    """Split ``_n`` of each group among its rows (``_key``, ``_count``); rows that get none are left out.

    With ``draws`` the groups are whole ones: each splits that number, those with fewer items are left out.
    """
    types = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", _drawn bigint"

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by("_key")
        counts = group["_count"].to_pylist()
        known, n = (0, draws) if draws is not None else (4 * len(group["_prefix"][0].as_py()), group["_n"][0].as_py())
        drawn = [0] * len(counts)
        if draws is None or sum(counts) >= draws:
            drawn = split(group["_name"][0].as_py(), group["_key"].to_pylist(), counts, n, known)
        out = group.select(keep).append_column("_drawn", pa.array(drawn, pa.int64()))
        return out.filter(pa.array([d > 0 for d in drawn], pa.bool_()))

    return nodes.groupBy(*by).applyInArrow(one, schema)


def _joined(cells: DataFrame, drawn: DataFrame, group: str) -> DataFrame:
    """Inner join of cells with the draws of their prefix."""
    other = drawn.select(F.col(group).alias("_group2"), F.col("_key").alias("_prefix2"), F.col("_drawn").alias("_n"))
    same = F.col(group).eqNullSafe(F.col("_group2")) & (F.col("_prefix") == F.col("_prefix2"))
    return cells.join(other, same).drop("_group2", "_prefix2")


def draw_from_counts(counts: DataFrame, draws: int, seed: int, group: str, cell: str, count: str) -> DataFrame:
    """``group``, ``cell``, ``count``: ``draws`` items of every group without replacement.

    Groups with fewer items are left out, and so are cells of which nothing is drawn. Rows that repeat a cell are
    added up; counts that are missing or not positive hold no items. A missing group or cell is a group or cell of its own.
    """
    cells = counts.where(F.col(count) > 0).groupBy(group, cell).agg(F.sum(F.col(count).cast("bigint")).alias("_count"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    name = F.concat_ws("|", F.lit(seed), text(group))
    key = F.md5(F.concat_ws("|", "_name", text(cell)))
    spare = F.log(16.0, F.count(F.lit(1)) / F.lit(float(CELLS_PER_TASK)))
    totals = cells.groupBy(group).agg(
        F.sum("_count").alias("_total"), F.greatest(F.lit(0), F.ceil(spare).cast("int")).alias("_digits")
    )
    cut = totals.where("_digits > 0")
    # One number; cuts are planned only where a group needs them, and only for such groups.
    most = cut.agg(F.max("_digits")).first()[0] or 0
    rest = cells
    if most:
        large = sized(cut.select(F.col(group).alias("_group2")))
        same = F.col(group).eqNullSafe(F.col("_group2"))
        rest = cells.join(large, same, "left_anti")
    # Cells that are already dealt by group stay where they are.
    rest = rest.withColumn("_name", name).withColumn("_key", key)
    drawn = _split_groups(rest, [group], [group, cell], draws)
    if most:
        deep = cut.where(F.col("_total") >= draws).select(group, "_digits")
        placed = join_salted(cells.join(large, same, "left_semi"), deep, [group], cell)
        placed = placed.withColumn("_name", name).withColumn("_key", key)
        drawn = drawn.unionByName(_split_deep(placed, most, draws, group, cell))
    return drawn.withColumnRenamed("_drawn", count)


def _split_deep(placed: DataFrame, most: int, draws: int, group: str, cell: str) -> DataFrame:
    """Draws of groups that are cut at their first ``_digits`` key digits, ``HOP_DIGITS`` at a time."""
    digits: Column = F.col("_digits")
    placed = placed.withColumn("_prefix", F.substring("_key", F.lit(1), digits))
    found = parts = None
    for done in range(0, most, HOP_DIGITS):
        here = placed.where(digits > done)
        cut = F.substring("_key", F.lit(1), F.least(F.lit(done + HOP_DIGITS), digits))
        sums = here.groupBy(group, "_name", "_digits", cut.alias("_key")).agg(F.sum("_count").alias("_count"))
        nodes = sums.withColumn("_prefix", F.substring("_key", 1, done))
        nodes = _joined(nodes, found, group) if done else nodes.withColumn("_n", F.lit(draws).cast("bigint"))
        found = _split_groups(nodes, [group, "_prefix"], [group, "_key", "_digits"])
        last = digits <= done + HOP_DIGITS
        ends = _joined(here.where(last), found.where(last).drop("_digits"), group)
        parts = ends if parts is None else parts.unionByName(ends)
    return _split_groups(parts, [group, "_prefix"], [group, cell])
