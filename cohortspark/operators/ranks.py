"""Running totals, ranks and positions without a one-task window.

``Window.partitionBy(feature).orderBy(value)`` sends a whole feature to one task. Here every group is
cut into ordered buckets first: running totals are computed inside a bucket and shifted by the totals
of the buckets before it. The bucket of a row depends on its value only, so a recomputed task always
reaches the same answer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.keys import hash_key, hash_slot, slot_digits
from cohortspark.session import join_counted, shuffle_partitions, sized

def bucket_bits(df: DataFrame, bits: int | None = None) -> int:
    """log2 of the bucket count: as many buckets per group as the session has shuffle partitions."""
    if bits is not None:
        return bits
    return max(1, shuffle_partitions(df.sparkSession) - 1).bit_length()


def _add_bucket(df: DataFrame, value: str, cuts: Column, bits: int) -> DataFrame:
    """Add ``_bucket``, the number of cuts below the value, by binary search over 2^bits - 1 sorted cuts.

    One projection per step keeps the search in generated code.
    """
    v = F.col(value).cast("double")
    out = df.withColumn("_bucket", F.lit(0))
    for step in (1 << i for i in reversed(range(bits))):
        above = F.element_at(cuts, F.col("_bucket") + step) < v
        out = out.withColumn("_bucket", F.col("_bucket") + F.when(above, step).otherwise(0))
    return out


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    *,
    source: DataFrame | None = None,
    descending: bool = False,
    bits: int | None = None,
    n_groups: int | None = None,
    totals: bool = False,
    peers: bool = False,
) -> DataFrame:
    """Add ``before_<s>``: the total of ``s`` over the rows of the group that come earlier.

    ``df`` has one row per (keys, order), or with ``peers`` a few of them, and no missing ``order``;
    ``peers`` adds ``tie_<s>``, the total over the rows with the same ``order``. Bucket boundaries are estimated;
    they only balance the work, the totals are exact for any boundaries. ``source`` is the table that
    ``df`` was combined from, with the columns keys, order and sums at row level: boundaries and bucket
    totals are then two scans of it that shuffle next to nothing, and ``df`` itself is computed once.
    ``n_groups`` is the number of distinct ``keys`` when the caller knows it. With ``totals`` the
    column ``total_<s>`` holds the sum of the whole group.
    """
    keys = list(keys)
    bits = bucket_bits(df, bits)
    n = 1 << bits
    probs = [i / n for i in range(1, n)]
    estimate = F.percentile_approx(F.col(order).cast("double"), probs, 10 * n).alias("_cuts")
    source = df if source is None else source
    if keys:
        cuts = source.groupBy(*keys).agg(estimate)
        if n_groups is None:
            cuts = cuts.persist()
            n_groups = cuts.count()
        cuts = sized(cuts, n_groups * n)
        cuts_col = F.col("_cuts")
    else:
        n_groups = 1
        found = source.agg(estimate).first()["_cuts"] or [0.0] * (n - 1)
        cuts_col = F.array(*[F.lit(float(x)) for x in found])

    def place(table: DataFrame) -> DataFrame:
        known = table.join(cuts, keys) if keys else table
        return _add_bucket(known, order, cuts_col, bits).drop("_cuts")

    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    per_bucket = place(source).groupBy(*keys, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum(f"_t_{s}").over(group).alias(f"total_{s}") for s in sums] if totals else []
    offsets = per_bucket.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *whole,
    )
    ordered = Window.partitionBy(*keys, "_bucket").orderBy(direction(order))
    out = place(df).join(sized(offsets, n_groups * n), [*keys, "_bucket"])
    if peers:
        upto = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        same = Window.partitionBy(*keys, "_bucket", order)
        out = out.withColumns(
            {f"tie_{s}": F.sum(s).over(same) for s in sums} | {f"before_{s}": F.sum(s).over(upto) for s in sums}
        ).withColumns({f"before_{s}": F.col(f"before_{s}") - F.col(f"tie_{s}") + F.col(f"_o_{s}") for s in sums})
    else:
        inside = ordered.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns(
            {f"before_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"_o_{s}") for s in sums}
        )
    return out.drop("_bucket", *[f"_o_{s}" for s in sums])


def tie_groups(
    long: DataFrame, keys: Sequence[str], value: str, counters: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per distinct value of a group with its row count ``n`` and conditional counts.

    A value shared by a large part of the rows is combined before the shuffle.
    """
    return (
        long.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(cond).alias(name) for name, cond in (counters or {}).items()],
        )
    )


def rank_groups(
    ties: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    long: DataFrame | None = None,
    n_groups: int | None = None,
    bits: int | None = None,
    peers: bool = False,
) -> DataFrame:
    """Add ``avg_rank``, the mean rank that the ``n`` rows of a tie group share.

    ``long`` is the table of single rows that ``ties`` was combined from. With ``peers`` a tie group
    may be spread over several rows of ``ties``.
    """
    source = None if long is None else _single_rows(long, keys, value)
    out = running_totals(
        ties, keys, value, ["n"], source=source, n_groups=n_groups, bits=bits, peers=peers
    )
    tie = F.col("tie_n") if peers else F.col("n")
    return out.withColumn("avg_rank", F.col("before_n") + (tie + 1) / F.lit(2.0)).drop("before_n", "tie_n")


def _single_rows(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return long.where(F.col(value).isNotNull()).select(*keys, value, F.lit(1).cast("bigint").alias("n"))


def average_rank(
    long: DataFrame, keys: Sequence[str], value: str, *, n_groups: int | None = None
) -> DataFrame:
    """Rank of every row within its group, ties sharing the mean rank; missing values get no rank."""
    keys = list(keys)
    ranks = rank_groups(
        tie_groups(long, keys, value), keys, value, long=long, n_groups=n_groups
    ).select(*keys, value, "n", "avg_rank")
    present, missing = long.where(F.col(value).isNotNull()), long.where(F.col(value).isNull())
    ranked = join_counted(present, ranks, [*keys, value], "n").drop("n")
    return ranked.unionByName(missing.withColumn("avg_rank", F.lit(None).cast("double")))


def hash_position(
    df: DataFrame,
    keys: Sequence[str],
    ids: Sequence[str],
    seed: int | Column,
    *,
    size: str | None = None,
    digits: int | Column | None = None,
) -> DataFrame:
    """Add ``position`` (1..n) of each row within its group in seeded hash order.

    The order is cut at the leading hash digits, so a group of any size is spread evenly over tasks.
    ``digits`` may be a column that is constant within a group: few digits for small groups. By default there are at least
    16 slots for each shuffle partition.
    ``size`` names an extra column that receives the size of the group.
    """
    keys = list(keys)
    if digits is None:
        digits = slot_digits(shuffle_partitions(df.sparkSession))
    keyed = df.withColumn("_key", hash_key(seed, *[F.col(c) for c in ids])).withColumn(
        "_slot", hash_slot(F.col("_key"), digits)
    )
    counts = keyed.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_n").over(group).alias(size)] if size else []
    offsets = counts.select(*keys, "_slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"), *extra)
    inside = Window.partitionBy(*keys, "_slot").orderBy("_key", *ids)
    # A missing key is a group of its own, so the join is null-safe.
    parts = [*keys, "_slot"]
    offsets = offsets.withColumnsRenamed({k: f"_of_{k}" for k in parts})
    same = F.lit(True)
    for k in parts:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return (
        keyed.withColumn("_r", F.row_number().over(inside))
        .join(offsets, same)
        .withColumn("position", F.col("_r") + F.col("_o"))
        .drop("_key", "_slot", "_r", "_o", *[f"_of_{k}" for k in parts])
    )


def percentiles(
    long: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    n_groups: int | None = None,
) -> DataFrame:
    """Exact percentiles of every group with linear interpolation, one column per named probability.

    Built on running totals: ``percentile`` and ``median`` would hold every distinct value of a group
    in one buffer.
    """
    keys = list(keys)
    ties = tie_groups(long, keys, value)
    source = _single_rows(long, keys, value)
    placed = running_totals(ties, keys, value, ["n"], source=source, n_groups=n_groups, totals=True)
    v = F.col(value)

    def at(place: Column) -> Column:
        inside = (F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n"))
        return F.max(F.when(inside, v))

    aggs = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("total_n") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        rest = F.max(place - F.floor(place))
        aggs.append((low + (high - low) * rest).alias(name))
    return placed.groupBy(*keys).agg(*aggs)
