"""Exact nearest neighbours among rows that may miss values, without comparing all pairs.

Donor rows are placed in cells (nearest of a few pivots, split by which coordinates are present) and a
cell is cut into blocks of bounded size. A table with the bounding box of every cell tells how close a
donor of that cell can possibly be. A query first meets one block near to it, which bounds the distance
of its k-th neighbour; it then meets only the blocks whose box reaches within that bound. Each task
compares one slice of queries with one block and keeps k rows per query.

Distance is the squared Euclidean distance over the coordinates both rows have, scaled up by
``all coordinates / common coordinates``. Equal distances go to the smaller donor id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.keys import hash_key
from cohortspark.session import cut_lineage, sized

# Bounds of boxes and distances round differently; a block is ruled out only beyond this relative margin.
MARGIN = 1e-9
MAX_PIVOTS = 1024
ROWS_PER_PIVOT = 2048
MAX_PATTERNS = 64
BLOCK_ROWS = 8192
QUERY_ROWS = 8192
CHUNK_CELLS = 1 << 19
TILE_CELLS = 1 << 16  # distances compared at a time, few enough for a processor's cache
# With this few blocks a first round to bound the distances costs more than it saves.
FEW_BLOCKS = 4
# Pairs of a query and a cell that a task looks at when queries find their blocks.
ROUTE_PAIRS = 1 << 20


def _matrix(col: pd.Series, width: int) -> np.ndarray:
    if len(col) == 0:
        return np.empty((0, width))
    return np.vstack([np.asarray(v, dtype=float) for v in col])


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scaled squared distances (rows of q) x (rows of x); infinite without a common coordinate."""
    mq, mx = ~np.isnan(q), ~np.isnan(x)
    total, diff = np.zeros((2, len(q), len(x)))
    for j in range(q.shape[1]):
        # Most tables hold few patterns: a column that one side lacks altogether, or both have throughout, needs no mask.
        if not mq[:, j].any() or not mx[:, j].any():
            continue
        whole = mq[:, j].all() and mx[:, j].all()
        left, right = (q[:, j], x[:, j]) if whole else (np.where(mq[:, j], q[:, j], 0.0), np.where(mx[:, j], x[:, j], 0.0))
        np.subtract(left[:, None], right[None, :], out=diff)
        np.multiply(diff, diff, out=diff)
        if not whole:
            diff *= mq[:, j, None] & mx[None, :, j]
        total += diff
    if len(q) and len(x) and (mq == mq[0]).all() and (mx == mx[0]).all():
        common = float((mq[0] & mx[0]).sum())
        if common == 0:
            total.fill(np.inf)
        else:
            total *= q.shape[1] / common
        return total
    common = mq.astype(float) @ mx.astype(float).T
    with np.errstate(divide="ignore", invalid="ignore"):
        out = total * (q.shape[1] / common)
    out[common == 0] = np.inf
    return out


def nearest(d: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k smallest finite distances of every row, of none beyond the row's bound (infinite for none).

    Rows come in order, their columns by distance; the smaller column is first among equal distances.
    """
    limit, loose = bound * (1 + MARGIN), ~np.isfinite(bound)
    if loose.any() and d.shape[1] > k:
        limit[loose] = np.partition(d[loose], k - 1, axis=1)[:, k - 1]
    row, column = np.nonzero(d <= limit[:, None])
    dist = d[row, column]
    ok = np.isfinite(dist)
    row, column, dist = row[ok], column[ok], dist[ok]
    order = np.lexsort((column, dist, row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row, side="left")
    kept = np.arange(len(row)) - first < k
    return row[kept], column[kept]


@dataclass
class Cells:
    """Per cell: bounding box, mean row, whether all its rows hold the same coordinates, blocks and rows."""

    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    uniform: np.ndarray
    blocks: np.ndarray
    rows: np.ndarray

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest possible distance of each query to a donor of each cell."""
        width = q.shape[1]
        mq = ~np.isnan(q)
        near, far = np.zeros((len(q), len(self.low))), np.zeros((len(q), len(self.low)))
        least = np.full(near.shape, np.inf)
        most = np.zeros(near.shape)
        common = np.zeros(near.shape)
        for j in range(width):
            lo, hi = self.low[None, :, j], self.high[None, :, j]
            both = mq[:, j, None] & ~np.isnan(lo)
            v = np.where(mq[:, j], q[:, j], 0.0)[:, None]
            gap = np.where(both, np.maximum(0.0, np.maximum(lo - v, v - hi)), 0.0) ** 2
            span = np.where(both, np.maximum(np.abs(lo - v), np.abs(hi - v)), 0.0) ** 2
            near += gap
            far += span
            least = np.where(both, np.minimum(least, gap), least)
            most = np.where(both, np.maximum(most, span), most)
            common += both
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = width / common
            # Rows of a mixed cell may share any subset of coordinates with the query: the mean over a
            # subset lies between the smallest and the largest single term.
            low = np.where(self.uniform, near * scale, least * width)
            high = np.where(self.uniform, far * scale, most * width)
        low[common == 0] = np.inf
        high[(common == 0)] = np.inf
        return low, high

    def holds(self) -> np.ndarray:
        """Whether some row of a cell has the coordinate."""
        return ~np.isnan(self.low)


class NeighbourIndex:
    """Donor rows (``donor_id``, ``vec`` array with NaN for missing, further columns) ready to be joined."""

    def __init__(
        self,
        donors: DataFrame,
        width: int,
        pivots: int | None = None,
        block_rows: int = BLOCK_ROWS,
        query_rows: int = QUERY_ROWS,
    ):
        self.width = width
        self.block_rows = block_rows
        self.query_rows = query_rows
        if pivots is None:
            pivots = -(-donors.count() // ROWS_PER_PIVOT)
        self._build(donors, max(1, min(pivots, MAX_PIVOTS)))

    def _build(self, donors: DataFrame, pivots: int) -> None:
        width = self.width
        flags = F.transform("vec", lambda v: F.when(F.isnan(v) | v.isNull(), "0").otherwise("1"))
        placed = donors.withColumn("pattern", F.concat_ws("", flags)).withColumn("pivot", self._pivot(donors, pivots))
        common = placed.groupBy("pattern").count().orderBy(F.desc("count"), "pattern").limit(MAX_PATTERNS)
        kept = [r["pattern"] for r in common.collect()]
        # Rows with a rare pattern share the cell "mixed" of their pivot.
        shape = F.when(F.col("pattern").isin(*kept), F.col("pattern")).otherwise("mixed")
        placed = placed.withColumn("cell", F.concat_ws(":", "pivot", shape))
        known = [F.nanvl(F.col("vec")[j], F.lit(None).cast("double")) for j in range(width)]
        # At most pivots x (patterns + 1) cells, each with one bound per coordinate.
        boxes = (
            placed.groupBy("cell")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.array(*[F.min(v) for v in known]).alias("low"),
                F.array(*[F.max(v) for v in known]).alias("high"),
                F.array(*[F.avg(v) for v in known]).alias("centre"),
            )
            .orderBy("cell")
            .collect()
        )
        if not boxes:
            raise ValueError("no donor rows")
        n_rows = np.array([r["n"] for r in boxes])
        n_blocks = np.maximum(1, -(-n_rows // self.block_rows))
        self.cells = Cells(
            low=np.array([r["low"] for r in boxes], dtype=float),
            high=np.array([r["high"] for r in boxes], dtype=float),
            centre=np.array([r["centre"] for r in boxes], dtype=float),
            uniform=np.array([not r["cell"].endswith("mixed") for r in boxes]),
            blocks=n_blocks,
            rows=n_rows,
        )
        self._first_block = np.concatenate([[0], np.cumsum(n_blocks)[:-1]]).astype(int)
        places = donors.sparkSession.createDataFrame(
            [(r["cell"], int(f), int(n)) for r, f, n in zip(boxes, self._first_block, n_blocks)],
            "cell string, first_block int, n_blocks int",
        )
        block = F.col("first_block") + F.pmod(F.xxhash64("donor_id"), F.col("n_blocks")).cast("int")
        self.donors = (
            placed.join(sized(places, len(boxes)), "cell")
            .withColumn("block", block)
            .drop("pivot", "pattern", "cell", "first_block", "n_blocks")
        )

    def _pivot(self, donors: DataFrame, pivots: int):
        """Number of the nearest of a few donor rows picked by hash order; they only shape the cells."""
        if pivots == 1:
            return F.lit(0)
        picked = donors.select("vec", hash_key(0, F.col("donor_id")).alias("_k")).orderBy("_k").limit(pivots)
        centre = np.array([r["vec"] for r in picked.collect()], dtype=float)
        width = self.width
        step = max(1, CHUNK_CELLS // max(1, len(centre)))

        @F.pandas_udf("int")
        def locate(vecs: pd.Series) -> pd.Series:
            x = _matrix(vecs, width)
            parts = [distances(x[i : i + step], centre).argmin(axis=1) for i in range(0, len(x), step)]
            return pd.Series(np.concatenate(parts) if parts else np.zeros(0), dtype="int32")

        return locate("vec")

    # -- routing ---------------------------------------------------------------------------------

    def _dealt(self, queries: DataFrame) -> DataFrame:
        """Kept queries in as many partitions as their pairs with cells ask for; by their bytes they would share a task."""
        tasks = -(-queries.count() * len(self.cells.low) // ROUTE_PAIRS)
        return queries.repartition(max(1, tasks), "query_id")

    def _route(self, queries: DataFrame, k: int, first_only: bool, fill: bool = False) -> DataFrame:
        """(block, query columns): one near block per query, or every block within its bound.

        ``fill``: a query asks for the coordinates it lacks, so cells that have none of them are left out, and its near
        block is one that has all of them, where there is one, of the cell with the nearest mean row.
        """
        cells, first, width = self.cells, self._first_block, self.width
        holds = cells.holds()
        total = int(cells.blocks.sum())
        if total <= FEW_BLOCKS:
            return queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
        # Missing coordinates come back from Arrow as NULL elements, so the arrays must admit them.
        fields = [T.StructField(f.name, T.ArrayType(T.DoubleType(), True) if f.name == "vec" else f.dataType) for f in queries.schema]
        schema = T.StructType([T.StructField("block", T.IntegerType()), *fields])
        step = max(1, CHUNK_CELLS // (len(cells.low) * 4))

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in range(0, len(pdf), step):
                    part = pdf.iloc[i : i + step]
                    q = _matrix(part["vec"], width)
                    low, high = cells.reach(q)
                    if fill:
                        lacks = np.isnan(q) & holds.any(axis=0)
                        found = lacks.astype(float) @ holds.T.astype(float)
                        low[found == 0] = np.inf
                        high[found == 0] = np.inf
                    if first_only:
                        enough = np.where(cells.rows >= k, high, np.inf)
                        if fill:
                            able = np.isfinite(enough)
                            best = able & (found == lacks.sum(axis=1, keepdims=True))
                            able = np.where(best.any(axis=1, keepdims=True), best, able)
                            enough = np.where(able, np.nan_to_num(distances(q, cells.centre), nan=np.inf), np.inf)
                        home = np.where(np.isinf(enough).all(axis=1), low.argmin(axis=1), enough.argmin(axis=1))
                        out = part.copy()
                        out.insert(0, "block", first[home].astype("int32"))
                        yield out
                        continue
                    bound = part["bound"].to_numpy(dtype=float)
                    bound = np.where(np.isnan(bound), np.inf, bound)
                    qi, ci = np.nonzero((low <= bound[:, None] * (1 + MARGIN)) & np.isfinite(low))
                    n = cells.blocks[ci]
                    rows = np.repeat(qi, n)
                    base = np.repeat(first[ci], n)
                    within = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                    out = part.iloc[rows].copy()
                    out.insert(0, "block", (base + within).astype("int32"))
                    yield out

        return queries.mapInPandas(route, schema)

    def _compare(self, routed: DataFrame, k: int, compare, schema: str, carry: Sequence[str]) -> DataFrame:
        """Cogroup slices of queries with their block; a block with many queries is replicated."""
        if self.cells.blocks.sum() > FEW_BLOCKS:
            # Read for the load and for the join; routed once.
            routed = cut_lineage(routed)
        load = routed.groupBy("block").agg(F.count(F.lit(1)).alias("_n"))
        slices = load.select("block", F.ceil(F.col("_n") / F.lit(self.query_rows)).cast("int").alias("_slices"))
        # One row per block that is asked for.
        slices = sized(slices, int(self.cells.blocks.sum()))
        q = routed.join(slices, "block").withColumn(
            "_slice", F.pmod(F.xxhash64("query_id"), F.col("_slices")).cast("int")
        )
        x = (
            self.donors.select("block", "donor_id", F.col("vec").alias("donor_vec"), *carry)
            .join(slices, "block")
            .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
        )
        return (
            q.drop("_slices")
            .groupBy("block", "_slice")
            .cogroup(x.drop("_slices").groupBy("block", "_slice"))
            .applyInPandas(compare, schema)
        )

    # -- joins -----------------------------------------------------------------------------------

    def join(
        self,
        queries: DataFrame,
        k: int,
        target_missing: bool,
        carry: Sequence[str] = (),
        approximate: bool = False,
        folds: tuple[int, int] | None = None,
    ) -> DataFrame:
        """The k nearest donors of every query.

        ``queries`` holds ``query_id`` and ``vec``. With ``target_missing`` the donors of a query are
        looked up once per missing coordinate ``target`` among the rows that have it, and ``value``
        is what the donor has there; otherwise ``target`` is 0 and ``carry`` columns come along.
        ``approximate`` compares each query with one block near to it and no other.

        ``folds`` (folds, repeats): donors carry ``_folds``, their fold of every repeat, and each query is answered once
        per fold of each repeat by the donors outside of it, and last by all; ``target`` is then the place of the fold
        among these times the number of coordinates, plus the coordinate.
        """
        width = self.width
        read = [*carry, *(["_folds"] if folds else [])]
        n_sets = folds[0] * folds[1] + 1 if folds else 1
        queries = queries.select("query_id", "vec")
        id_type = queries.schema["query_id"].dataType.simpleString()
        donor_type = self.donors.schema["donor_id"].dataType.simpleString()
        extra = [(c, self.donors.schema[c].dataType.simpleString()) for c in carry]
        schema = f"query_id {id_type}, target int, donor_id {donor_type}, dist double, value double" + "".join(
            f", `{c}` {t}" for c, t in extra
        )
        names = ["query_id", "target", "donor_id", "dist", "value", *carry]

        def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if len(left) == 0 or len(right) == 0:
                return pd.DataFrame(columns=names, dtype=object)
            right = right.sort_values("donor_id", ignore_index=True)
            x = _matrix(right["donor_vec"], width)
            q = _matrix(left["vec"], width)
            ids = left["query_id"].to_numpy()
            donor_ids = right["donor_id"].to_numpy()
            carried = {c: right[c].to_numpy() for c in carry}
            sets = [slice(None)]
            if folds:
                own = np.vstack(right["_folds"].to_list())
                sets = [own[:, r] != f for r in range(folds[1]) for f in range(folds[0])] + sets
            # The first round knows no bounds; later a donor beyond the bound cannot be among the k nearest.
            bounds = left["bound"].to_numpy(dtype=float, na_value=np.nan) if "bound" in left else np.full(len(q), np.nan)
            bounds = np.where(np.isnan(bounds), np.inf, bounds)
            parts: dict[str, list] = {c: [] for c in names}
            step = max(1, TILE_CELLS // len(x))
            for i in range(0, len(q), step):
                part = q[i : i + step]
                d = distances(part, x)
                targets = range(width) if target_missing else (0,)
                for t in targets:
                    if target_missing:
                        asking = np.nonzero(np.isnan(part[:, t]))[0]
                        usable = np.nonzero(~np.isnan(x[:, t]))[0]
                    else:
                        asking, usable = np.arange(len(part)), np.arange(len(x))
                    if len(asking) == 0 or len(usable) == 0:
                        continue
                    every = d if len(asking) == len(part) and len(usable) == len(x) else d[np.ix_(asking, usable)]
                    for s, inside in enumerate(sets):
                        mine = usable if not folds or s == n_sets - 1 else np.flatnonzero(inside[usable])
                        sub = every if mine is usable else every[:, mine]
                        if sub.shape[1] == 0:
                            continue
                        found, order = nearest(sub, k, bounds[i + asking])
                        if len(found) == 0:
                            continue
                        rows, cols = asking[found], usable[order] if mine is usable else usable[mine[order]]
                        parts["query_id"].append(ids[i + rows])
                        parts["target"].append(np.full(len(rows), s * width + t, dtype="int32"))
                        parts["donor_id"].append(donor_ids[cols])
                        parts["dist"].append(sub[found, order])
                        parts["value"].append(x[cols, t] if target_missing else np.full(len(rows), np.nan))
                        for c in carry:
                            parts[c].append(carried[c][cols])
            if not parts["dist"]:
                return pd.DataFrame(columns=names, dtype=object)
            return pd.DataFrame({c: np.concatenate(v) for c, v in parts.items()})

        many = self.cells.blocks.sum() > FEW_BLOCKS
        if many:
            queries = cut_lineage(queries)
            dealt = self._dealt(queries)
        else:
            dealt = queries
        if approximate:
            found = self._compare(self._route(dealt, k, True), k, compare, schema, read)
            best = Window.partitionBy("query_id", "target").orderBy("dist", "donor_id")
            return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        bounded = queries
        if many:
            seen = self._compare(self._route(dealt, k, True, target_missing), k, compare, schema, read)
            per_target = seen.groupBy("query_id", "target").agg(
                F.count(F.lit(1)).alias("n"), F.max("dist").alias("d")
            )
            # A coordinate that no donor has is found nowhere.
            lacks = [F.isnan(F.col("vec")[j]) | F.col("vec")[j].isNull() for j in np.flatnonzero(self.cells.holds().any(axis=0)).tolist()]
            missing = sum((c.cast("int") for c in lacks), F.lit(0))
            bound = per_target.groupBy("query_id").agg(
                F.count_if(F.col("n") >= k).alias("full"), F.max("d").alias("d")
            )
            wanted = (missing if target_missing else F.lit(1)) * n_sets
            # Without k donors for every target in the first block nothing is ruled out.
            bounded = queries.join(bound, "query_id", "left").select(
                "query_id", "vec", F.when(F.col("full") == wanted, F.col("d")).alias("bound")
            )
            bounded = self._dealt(cut_lineage(bounded))
        else:
            bounded = queries.withColumn("bound", F.lit(None).cast("double"))
        found = self._compare(self._route(bounded, k, False, target_missing), k, compare, schema, read)
        best = Window.partitionBy("query_id", "target").orderBy("dist", "donor_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def limit_copies(donors: DataFrame, k: int, by: Sequence[str] = ("vec",)) -> DataFrame:
    """Keep the k smallest donor ids of rows with equal coordinates (and equal folds, where donors are used by fold).

    Equal rows are equally far from any query and ties go to the smaller id, so no others can be among
    the k nearest. A point with very many copies is reduced before the shuffle.
    """
    copies = Window.partitionBy(*by).orderBy("donor_id")
    return donors.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy")


def vector_key(vec: Column) -> Column:
    """Key of an array of numbers; equal arrays have equal keys."""
    return F.md5(vec.cast("string").cast("binary"))


def with_nan(columns: Sequence[str]):
    """Array of the columns as doubles, NaN standing for a missing value."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])


def knn_vote(
    index: NeighbourIndex, queries: DataFrame, k: int, n_classes: int, label: str = "label"
) -> DataFrame:
    """Share of the k nearest donors per class (``votes``) and the class with most votes.

    A tie goes to the smaller class number.
    """
    near = index.join(queries, k, target_missing=False, carry=[label])
    classes = range(n_classes)
    counts = near.groupBy("query_id").agg(
        F.array(*[F.count_if(F.col(label) == c).cast("double") for c in classes]).alias("_c"),
        F.count(F.lit(1)).alias("_n"),
    )
    votes = F.transform("_c", lambda c: c / F.col("_n"))
    return counts.select("query_id", votes.alias("votes")).withColumn(
        "prediction", (F.array_position("votes", F.array_max("votes")) - 1).cast("double")
    )
