"""Attributions as bulk scoring jobs.

Rows are expanded to perturbed rows in their own task, scored by one ``transform`` of the whole model,
and reduced again by sums per row, most of which happen before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.keys import hash_key
from cohortspark.operators.ranks import percentiles
from cohortspark.operators.prep import to_long

# Background sizes and sample counts of the published runs.
CENTROIDS = 10
SMALL_TRAINING_SET = 15
BACKGROUND_ROWS = 50
EXPAND_ROWS = 20_000
WORD = 62  # features per whole number of bits
# Ridge penalties of the published method, for the choice of features and for the fit.
CHOICE_PENALTY, FIT_PENALTY = 0.01, 1.0


def centroid_background(
    train: DataFrame, features: Sequence[str], k: int = CENTROIDS, seed: int = 42, few_rows: int = SMALL_TRAINING_SET
) -> tuple[np.ndarray, np.ndarray]:
    """At most ``k`` weighted centroids of the training rows; the rows themselves when there are at most ``few_rows``.

    A missing value stands at the mean of its column (0 in an empty one); every coordinate of a centroid is moved to the
    nearest value the column really has.
    """
    numbers = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in features]
    raw = train.select(*numbers)
    means = raw.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in features]).first()
    known = raw.select(*[F.coalesce(F.col(c), F.lit(means[c])).alias(c) for c in features])
    few = known.limit(few_rows + 1).collect()
    if len(few) <= few_rows:
        return np.array([list(r) for r in few], dtype=float), np.full(len(few), 1.0 / max(1, len(few)))
    vec = VectorAssembler(inputCols=list(features), outputCol="v").transform(known).select("v")
    model = KMeans(featuresCol="v", k=k, seed=seed).fit(vec)
    sizes = {r["prediction"]: r["count"] for r in model.transform(vec).groupBy("prediction").count().collect()}
    weights = np.array([sizes.get(i, 0) for i in range(len(model.clusterCenters()))], dtype=float)
    centres = np.array(model.clusterCenters())[weights > 0]
    nearest = [
        F.array(*[F.min(F.struct(F.abs(F.col(c) - F.lit(float(x))), F.col(c).alias("x"))) for x in centres[:, j]]).alias(c)
        for j, c in enumerate(features)
    ]
    moved = known.agg(*nearest).first()
    snapped = np.array([[cell["x"] for cell in moved[c]] for c in features], dtype=float).T
    return snapped, weights[weights > 0] / weights.sum()


def sampled_background(
    train: DataFrame, features: Sequence[str], n: int = BACKGROUND_ROWS, id_col: str = "sample_id", seed: int = 42
) -> tuple[np.ndarray, np.ndarray]:
    """A fixed number of training rows in seeded hash order, equal weights."""
    picked = (
        train.select(hash_key(seed, F.col(id_col)).alias("_k"), *[F.col(c).cast("double") for c in features])
        .orderBy("_k")
        .limit(n)
        .drop("_k")
        .collect()
    )
    rows = np.array([[np.nan if v is None else v for v in r] for r in picked], dtype=float)
    return rows, np.full(len(rows), 1.0 / max(1, len(rows)))


def coalitions(p: int, budget: int | None = None, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Feature subsets (rows of 0/1) and their kernel weights.

    All proper subsets when they fit into the budget, in which case the attributions are exact Shapley
    values. Otherwise whole subset sizes from the outside in, and the rest drawn by kernel weight.
    """
    if p == 1:
        return np.zeros((0, 1)), np.zeros(0)
    budget = 2 * p + 2048 if budget is None else budget
    size_weight = {s: (p - 1) / (s * (p - s)) for s in range(1, p)}
    total = sum(size_weight.values())
    rows: list[np.ndarray] = []
    weights: list[float] = []
    left_sizes = list(range(1, p))
    while left_sizes:
        s = left_sizes[0] if len(left_sizes) % 2 == (p - 1) % 2 else left_sizes[-1]
        count = math.comb(p, s)
        if count > budget - len(rows):
            break
        for subset in combinations(range(p), s):
            z = np.zeros(p)
            z[list(subset)] = 1
            rows.append(z)
            weights.append(size_weight[s] / total / count)
        left_sizes.remove(s)
    spare = budget - len(rows)
    if left_sizes and spare > 0:
        rng = np.random.default_rng(seed)
        probs = np.array([size_weight[s] for s in left_sizes])
        mass = probs.sum() / total
        drawn: dict[tuple, int] = {}
        for s in rng.choice(left_sizes, size=spare, p=probs / probs.sum()):
            z = np.zeros(p)
            z[rng.choice(p, size=s, replace=False)] = 1
            drawn[tuple(z)] = drawn.get(tuple(z), 0) + 1
        for z, times in drawn.items():
            rows.append(np.array(z))
            weights.append(mass * times / spare)
    return np.array(rows), np.array(weights)


def shapley_operator(masks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Matrix that turns coalition values into attributions, for the masks and then none and all.

    Solves the kernel-weighted least squares with the attributions bound to sum to f(all) - f(none). It
    is the same for every row, so a row needs a weighted sum of its scores and no solver of its own.
    """
    p = masks.shape[1]
    if p == 1:
        return np.array([[-1.0, 1.0]])
    last = masks[:, -1]
    z = masks[:, :-1] - last[:, None]
    g = np.linalg.solve(z.T @ (weights[:, None] * z), z.T * weights)
    head = np.column_stack([g, -(g.sum(axis=1)) + g @ last, -(g @ last)])
    tail = -head.sum(axis=0)
    tail[-2] -= 1.0
    tail[-1] += 1.0
    return np.vstack([head, tail])


def kernel_shap(
    model: Transformer,
    rows: DataFrame,
    features: Sequence[str],
    background: tuple[np.ndarray, np.ndarray],
    *,
    classes: Sequence[int] = (1,),
    id_col: str = "sample_id",
    budget: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Attribution ``phi`` of every (row, class, feature) and the base value of the class.

    ``model`` scores a table with the feature columns and adds ``probability``; it may be a whole
    pipeline or the classifier alone.
    """
    p = len(features)
    back, back_w = background
    masks, weights = coalitions(p, budget, seed)
    op = shapley_operator(masks, weights)
    full = np.vstack([masks, np.zeros(p), np.ones(p)])
    none_at = len(masks)
    n_masks, n_back = len(full), len(back)
    per_row = n_masks * n_back
    step = max(1, EXPAND_ROWS // per_row)
    id_type = rows.schema[id_col].dataType.simpleString()
    names = list(features)
    schema = (
        f"_row {id_type}, `{id_col}` string, {', '.join(f'`{c}` double' for c in names)}, "
        "_coef array<double>, _base double, _w double"
    )
    coef = [list(op[:, m]) for m in range(n_masks)]

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i : i + step]
                x = part[names].to_numpy(dtype=float)
                n = len(x)
                z = full[None, :, None, :]
                mixed = np.where(z == 1, x[:, None, None, :], back[None, None, :, :]).reshape(-1, p)
                row = np.repeat(np.arange(n), per_row)
                mask = np.tile(np.repeat(np.arange(n_masks), n_back), n)
                ids = part[id_col].to_numpy()
                out = pd.DataFrame(mixed, columns=names)
                out.insert(0, "_row", ids[row])
                out.insert(1, id_col, [f"{a}|{b}" for a, b in zip(ids[row], np.tile(np.arange(per_row), n))])
                out["_coef"] = [coef[m] for m in mask]
                out["_base"] = (mask == none_at).astype(float)
                out["_w"] = np.tile(np.tile(back_w, n_masks), n)
                yield out

    many = rows.select(id_col, *[F.col(c).cast("double") for c in names]).mapInPandas(expand, schema)
    # Missing values travel through Arrow as NaN and go back to NULL for the pipeline.
    many = many.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})
    scored = model.transform(many).withColumn("_p", vector_to_array("probability"))
    aggs = []
    for c in classes:
        value = F.col("_p")[c] * F.col("_w")
        aggs.append(F.sum(value * F.col("_base")).alias(f"base_{c}"))
        aggs += [F.sum(F.col("_coef")[j] * value).alias(f"phi_{c}_{j}") for j in range(p)]
    sums = scored.groupBy("_row").agg(*aggs)
    out = F.array(
        *[
            F.struct(
                F.lit(int(c)).alias("class"),
                F.lit(names[j]).alias("feature"),
                F.col(f"phi_{c}_{j}").alias("phi"),
                F.col(f"base_{c}").alias("base_value"),
            )
            for c in classes
            for j in range(p)
        ]
    )
    return sums.select(F.col("_row").alias(id_col), F.explode(out).alias("s")).select(id_col, "s.*")


def shap_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, over rows and classes, largest first."""
    return (
        attributions.groupBy("feature")
        .agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
        .orderBy(F.col("mean_abs_shap").desc(), "feature")
    )


def row_contributions(attributions: DataFrame, row_id, id_col: str = "sample_id") -> DataFrame:
    """Base value and push of every feature for one row, strongest first."""
    return attributions.where(F.col(id_col) == row_id).orderBy(F.abs("phi").desc(), "feature")


# --- local linear explanations ------------------------------------------------------------------


def quartile_cuts(train: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """Exact quartiles of every feature, one row per feature."""
    long = to_long(train, [], features)
    rows = percentiles(
        long, ["feature"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, n_groups=len(features)
    ).collect()
    return {r["feature"]: sorted({r["q1"], r["q2"], r["q3"]}) for r in rows}


def bin_statistics(train: DataFrame, features: Sequence[str], cuts: dict[str, list[float]]) -> DataFrame:
    """Rows, mean, deviation and range of every (feature, bin)."""
    long = to_long(train, [], features).where(F.col("value").isNotNull())
    bins = F.lit(0)
    for f in features:
        above = sum((F.when(F.col("value") > c, 1).otherwise(0) for c in cuts.get(f, [])), F.lit(0))
        bins = F.when(F.col("feature") == f, above).otherwise(bins)
    return long.withColumn("bin", bins).groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )


def lime(
    model: Transformer,
    train: DataFrame,
    rows: DataFrame,
    features: Sequence[str],
    *,
    target: int = 1,
    id_col: str = "sample_id",
    samples: int = 5000,
    num_features: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Weight of "the feature is in the same quartile bin as here" for every row, strongest first.

    Each row is perturbed ``samples`` times: bins are drawn by their training share and values inside a
    bin around its mean; perturbed rows count by how many features stay in the bin of the row. A ridge
    fit with a slight penalty picks the strongest features, another one is fitted on them. A feature without any training
    value gets weight 0.
    """
    names = list(features)
    p = len(names)
    cuts = quartile_cuts(train, names)
    stats: dict[str, dict[int, tuple]] = {f: {} for f in names}
    for r in bin_statistics(train, names, cuts).collect():
        stats[r["feature"]][r["bin"]] = (r["n"], r["mean"], r["std"], r["low"], r["high"])
    known = {f: sorted(stats[f]) for f in names}
    moments = {f: np.array([stats[f][b] for b in known[f]], dtype=float).reshape(-1, 5).T for f in names}
    id_type = rows.schema[id_col].dataType.simpleString()
    # Which features stay in their bin, as bits of whole numbers.
    words = [f"_same{w}" for w in range(-(-p // WORD))]
    schema = (
        f"_row {id_type}, _at int, {', '.join(f'`{c}` double' for c in names)}, {', '.join(f'{w} long' for w in words)}"
    )
    step = max(1, EXPAND_ROWS // samples)

    def draw(key, row: np.ndarray, values: np.ndarray, same: np.ndarray) -> None:
        rng = np.random.default_rng([seed, int.from_bytes(str(key).encode(), "little") % (2**63)])
        for j, f in enumerate(names):
            if not known[f]:
                # No training row has a value: nothing to draw, nothing the fit could learn from.
                values[:, j] = np.nan
                continue
            here = sum(1 for c in cuts.get(f, []) if row[j] > c)
            shares, mean, std, low, high = moments[f]
            edges = (shares / shares.sum()).cumsum()
            at = (edges / edges[-1]).searchsorted(rng.random(samples), side="right")
            values[:, j] = np.clip(mean[at] + std[at] * rng.standard_normal(samples), low[at], high[at])
            bit = (np.array(known[f]) == here)[at]
            bit[0] = True
            same[:, j // WORD] += bit * (1 << j % WORD)
        values[0] = row

    def perturb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, x = pdf[id_col], pdf[names].to_numpy(dtype=float)
            number = pd.api.types.is_numeric_dtype(ids) and not pd.api.types.is_bool_dtype(ids)
            keys = (ids.astype(float) if number else ids).to_list()
            for i in range(0, len(pdf), step):
                n = min(step, len(pdf) - i)
                values = np.empty((n, samples, p))
                same = np.zeros((n, samples, len(words)), dtype=np.int64)
                for k in range(n):
                    draw(keys[i + k], x[i + k], values[k], same[k])
                out = {"_row": ids.iloc[i : i + n].repeat(samples).reset_index(drop=True)}
                out["_at"] = np.tile(np.arange(samples, dtype=np.int32), n)
                out |= dict(zip(names, values.reshape(-1, p).T, strict=True))
                out |= dict(zip(words, same.reshape(-1, len(words)).T, strict=True))
                yield pd.DataFrame(out)

    many = rows.select(id_col, *[F.col(c).cast("double") for c in names]).mapInPandas(perturb, schema)
    many = many.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})
    many = many.withColumn(id_col, F.concat_ws("|", "_row", "_at"))
    scored = model.transform(many).select("_row", *words, vector_to_array("probability")[target].alias("_y"))
    # The fit needs the sums of equal patterns only; most of them are added up before the shuffle.
    sums = scored.groupBy("_row", *words).agg(F.count("*").alias("_n"), F.sum("_y").alias("_sum"))
    width = 0.75 * math.sqrt(p)
    top = min(num_features, p)
    # A feature nobody has counts as staying in its bin.
    blank = np.array([not known[f] for f in names])

    def solve(table: pa.Table) -> pa.Table:
        # A group holds at most as many rows as perturbed ones.
        table = table.sort_by([(w, "ascending") for w in words])
        bits = np.stack([table[w].to_numpy() for w in words], axis=1)
        z = np.stack([bits[:, j // WORD] >> j % WORD & 1 for j in range(p)], axis=1).astype(float)
        z[:, blank] = 1.0
        n = table["_n"].to_numpy()
        y = table["_sum"].to_numpy() / n
        w = n * np.sqrt(np.exp(-((1 - z).sum(axis=1)) / width**2))
        chosen = np.argsort(-np.abs(_ridge(z, y, w, CHOICE_PENALTY)[0]), kind="stable")[:top]
        slope, intercept = _ridge(z[:, chosen], y, w)
        order = np.argsort(-np.abs(slope), kind="stable")
        return pa.table(
            {
                id_col: table["_row"].take(pa.array([0] * len(order))),
                "feature": [names[chosen[i]] for i in order],
                "weight": slope[order],
                "intercept": [intercept] * len(order),
            }
        )

    return sums.groupBy("_row").applyInArrow(
        solve, f"`{id_col}` {id_type}, feature string, weight double, intercept double"
    )


def _ridge(z: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = FIT_PENALTY) -> tuple[np.ndarray, float]:
    zm, ym = np.average(z, axis=0, weights=w), np.average(y, weights=w)
    zc, yc = z - zm, y - ym
    slope = np.linalg.solve(zc.T @ (w[:, None] * zc) + penalty * np.eye(z.shape[1]), zc.T @ (w * yc))
    return slope, float(ym - zm @ slope)


def example_per_class(scored: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """The first row (by key) predicted as each class."""
    return scored.groupBy("prediction").agg(F.min(id_col).alias(id_col))
