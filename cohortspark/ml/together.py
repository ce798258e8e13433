"""Search points of one model fitted in the shared passes of ``gang`` and ``descent``, and rows for these passes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.ml import descent, gang, grove
from cohortspark.operators.neighbours import distances, nearest

Predict = Callable[[int, np.ndarray], Iterator[tuple[object, np.ndarray]]]


def pass_rows(df: DataFrame, x: Column, label: str, row_key: Column, weight: Column | None = None, fold: Column | None = None) -> DataFrame:
    """Rows as the passes read them; ``x`` is an array of doubles, ``row_key`` tells rows apart where rows are drawn."""
    return df.select(
        (F.lit(0) if fold is None else fold).cast("int").alias("fold"),
        F.xxhash64(row_key).alias("rid"),
        F.col(label).cast("int").alias("label"),
        (F.lit(1.0) if weight is None else weight).cast("double").alias("weight"),
        x.alias("x"),
    )


@dataclass(frozen=True)
class Trees:
    """How a point grows trees; see ``gang.Member``. ``sqrt``: a node looks at the square root of the columns."""

    kind: str
    trees: int = 1
    depth: int = 30
    leaf: int = 1
    sqrt: bool = False
    bootstrap: bool = False
    weighted: bool = False
    rate: float = 1.0
    subsample: float = 1.0

    def member(self, fold: int, columns: Sequence[int], seed: int) -> gang.Member:
        few = max(1, int(np.sqrt(len(columns)))) if self.sqrt else 0
        own = (self.leaf, few, self.bootstrap, self.weighted, self.rate, self.subsample, seed)
        return gang.Member(fold, tuple(columns), self.kind, self.trees, self.depth, *own)


@dataclass(frozen=True)
class Smooth:
    """How a point fits weights; see ``descent.Net``. ``gamma`` (0 for scale) and ``size`` belong to kernel machines."""

    hidden: tuple[int, ...] = ()
    penalty: float = 1.0
    weighted: bool = False
    kernel: bool = False
    gamma: float = 0.0
    size: int = 256
    max_iter: int = 200

    def net(self, fold: int, columns: Sequence[int], classes: int, seed: int, spread: float, target: int = -1) -> descent.Net:
        lift = None
        if self.kernel:
            lift = descent.Fourier(self.gamma or 1.0 / (len(columns) * (spread or 1.0)), self.size, seed)
        loss = "hinge" if self.kernel else "logistic"
        return descent.Net(
            fold, tuple(columns), classes, self.hidden, self.penalty, loss, self.weighted, lift, -1, target, seed, self.max_iter
        )


@dataclass(frozen=True)
class Neighbours:
    """How many neighbours vote."""

    k: int


def _largest(points: dict, columns: Callable[[int, object], tuple[int, ...]], folds: Sequence[int], seed: int) -> tuple[dict, dict]:
    """Distinct models by key, as large as the largest point needs them, and the (point, trees, depth) of each."""
    largest: dict[tuple, gang.Member] = {}
    where: dict[tuple, tuple] = {}
    for name, spec in points.items():
        for f in folds:
            m = spec.member(f, columns(f, name), seed)
            cut = m.kind in ("forest", "extra")
            key = replace(m, trees=0, depth=0 if cut else m.depth)
            before = largest.get(key)
            if before is not None:
                m = replace(m, trees=max(m.trees, before.trees), depth=max(m.depth, before.depth))
            largest[key] = m
            where.setdefault((f, key), []).append((name, spec.trees, spec.depth))
    return largest, where


def predictor_of_trees(
    rows: DataFrame, points: dict, columns: Callable[[int, object], tuple[int, ...]], folds: Sequence[int], classes: int, seed: int
) -> Predict:
    """Grow each distinct model once; smaller forests, shallower trees and shorter runs are parts of the largest one."""
    largest, where = _largest(points, columns, folds, seed)
    keys = list(largest)
    grown = gang.grow(rows, [largest[k] for k in keys], classes)
    of_fold: dict[int, list] = {}
    for k, key in enumerate(keys):
        of_fold.setdefault(key.fold, []).extend((k, *p) for p in where[key.fold, key])

    def predict(fold: int, x: np.ndarray) -> Iterator[tuple[object, np.ndarray]]:
        for k, name, trees, depth in of_fold.get(fold, ()):
            yield name, gang.probabilities(grown, k, x, trees, depth).argmax(axis=1)

    return predict


def _nets(
    points: dict, columns: Callable[[int, object], tuple[int, ...]], folds: Sequence[int], classes: int, seed: int, spread: Callable
) -> dict[descent.Net, list]:
    """Distinct models and the points that use them."""
    nets: dict[descent.Net, list] = {}
    for name, spec in points.items():
        targets = ([1] if classes == 2 else list(range(classes))) if spec.kernel else [-1]
        for f in folds:
            c = columns(f, name)
            for t in targets:
                nets.setdefault(spec.net(f, c, classes, seed, spread(f, c), t), []).append(name)
    return nets


def predictor_of_nets(
    rows: DataFrame,
    points: dict,
    columns: Callable[[int, object], tuple[int, ...]],
    folds: Sequence[int],
    classes: int,
    seed: int,
    spread: Callable[[int, Sequence[int]], float],
) -> Predict:
    nets = _nets(points, columns, folds, classes, seed, spread)
    kernel = any(spec.kernel for spec in points.values())
    fitted = descent.machines(rows, list(nets)) if kernel else descent.minimise(rows, list(nets))
    of_fold: dict[int, dict] = {}
    for net, result in zip(nets, fitted, strict=True):
        for name in nets[net]:
            of_fold.setdefault(net.fold, {}).setdefault(name, []).append((net, result))

    def predict(fold: int, x: np.ndarray) -> Iterator[tuple[object, np.ndarray]]:
        for name, parts in of_fold.get(fold, {}).items():
            if not kernel:
                net, theta = parts[0]
                yield name, net.probabilities(theta, x).argmax(axis=1)
            elif classes == 2:
                yield name, (parts[0][1].chance(x) > 0.5).astype(int)
            else:
                yield name, np.stack([m.chance(x) for _, m in parts], axis=1).argmax(axis=1)

    return predict


def confusions(rows: DataFrame, predict: Predict, names: Sequence, classes: int) -> dict[tuple, np.ndarray]:
    """Counts (actual, predicted) per (point, fold) over the rows; classes x classes numbers per task leave it."""
    number = {name: k for k, name in enumerate(names)}

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for fold, _, label, _, x in gang.batches(data):
            for name, guess in predict(fold, x):
                counts = np.bincount(label * classes + guess, minlength=classes * classes)
                key = number[name], fold
                total[key] = total.get(key, 0) + counts
        cells = [(p, f, c, int(n)) for (p, f), counts in total.items() for c, n in enumerate(counts) if n]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        values = zip(*cells, strict=True) if cells else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(values, kinds, strict=True)], names=["point", "fold", "cell", "n"])

    found = rows.mapInArrow(run, "point int, fold int, cell int, n long").groupBy("point", "fold", "cell").agg(F.sum("n").alias("n"))
    out: dict[tuple, np.ndarray] = {}
    for r in found.collect():
        out.setdefault((names[r["point"]], r["fold"]), np.zeros((classes, classes)))[divmod(r["cell"], classes)] = r["n"]
    return out


# Numbers of a fold's training rows that a task may hold, those of the inputs of smooth models, numbers of the sums of a
# forest's root that it grows at a time, (tree, row) pairs it scores, and pairs of rows it compares, all and at a time.
# Larger folds are fitted in passes over the table of folds.
HELD_CELLS, HELD_INPUTS, HELD_NUMBERS, HELD_PAIRS = 1 << 22, 1 << 26, 1 << 25, 1 << 20
HELD_COMPARED, NEAR_PAIRS = 1 << 29, 1 << 20


def fits_a_task(specs: dict, n_rows: int, width: int) -> bool:
    def fits(spec: Trees | Smooth | Neighbours) -> bool:
        if isinstance(spec, Neighbours):
            return n_rows * width <= HELD_CELLS and n_rows**2 <= HELD_COMPARED
        if isinstance(spec, Trees):
            return n_rows * width <= HELD_CELLS
        return n_rows * max(width, *spec.hidden, spec.size if spec.kernel else 0) <= HELD_INPUTS

    return all(map(fits, specs.values()))


@dataclass
class TreeJob:
    """A model of trees to be grown over the rows of its fold, and the points (name, trees, depth) that are parts of it."""

    member: gang.Member
    points: list
    edges: list | None

    @property
    def fold(self) -> int:
        return self.member.fold

    def guesses(self, held: gang.Held, x: np.ndarray, classes: int) -> Iterator[tuple[object, np.ndarray]]:
        m, n_rows = self.member, sum(len(p[1]) for p in held.parts)
        sizes = {(trees, depth) for _, trees, depth in self.points}
        forest = m.kind in ("forest", "extra")
        numbers = n_rows * (m.per_node or len(m.columns)) * (classes + 1)
        some = max(1, min(m.trees, HELD_NUMBERS // max(1, numbers))) if forest else m.trees
        chance = {s: np.zeros((len(x), classes)) for s in sizes}
        for a in range(0, m.trees, some):
            part = replace(m, trees=min(some, m.trees - a), first=a) if forest else m
            grown = grove.grow(held, part, classes, self.edges)
            step = max(1, HELD_PAIRS // (part.trees * (classes if m.kind == "boost" else 1)))
            for trees, depth in sizes:
                n = min(trees - a, part.trees)
                for i in range(0, len(x) if n > 0 else 0, step):
                    chance[trees, depth][i : i + step] += n * gang.probabilities(grown, 0, x[i : i + step], n, depth)
        for name, *size in self.points:
            yield name, chance[tuple(size)].argmax(axis=1)


@dataclass
class NetJob:
    """Smooth models to be fitted over the rows of their fold: one, or machines that read the same inputs; and the points they serve.

    ``own``: places of a point's machines, one or one a class."""

    nets: list[descent.Net]
    points: list
    kernel: bool
    own: list[list[int]] = field(default_factory=list)

    @property
    def fold(self) -> int:
        return self.nets[0].fold

    def guesses(self, held: gang.Held, x: np.ndarray, classes: int) -> Iterator[tuple[object, np.ndarray]]:
        if self.kernel:
            # Machines with the same inputs are fitted side by side, and rows are lifted for all of them once.
            chance = descent.chances(descent.machines(held, self.nets), x)
            for own, name in zip(self.own, self.points, strict=True):
                some = chance[:, own]
                yield name, some.argmax(axis=1) if len(own) > 1 else (some[:, 0] > 0.5).astype(int)
            return
        [theta] = descent.minimise(held, self.nets)
        guess = self.nets[0].probabilities(theta, x).argmax(axis=1)
        for name in self.points:
            yield name, guess


@dataclass
class VoteJob:
    """A fold's rows to be voted on by their nearest training rows, as ``neighbours.knn_vote`` does; ``columns`` are all it reads."""

    fold: int
    columns: tuple[int, ...]
    k: int
    points: list

    def guesses(self, held: gang.Held, x: np.ndarray, classes: int) -> Iterator[tuple[object, np.ndarray]]:
        """Training rows come by id: of equally near ones the smaller id votes."""
        [(_, _, label, _, donors)] = held.parts
        donors, asked = donors[:, list(self.columns)], x[:, list(self.columns)]
        votes = np.zeros((len(x), classes))
        step = max(1, NEAR_PAIRS // max(1, len(donors)))
        for a in range(0, len(x), step):
            row, column = _nearest(asked[a : a + step], donors, self.k)
            np.add.at(votes, (a + row, label[column]), 1)
        for name in self.points:
            yield name, votes.argmax(axis=1)


def _nearest(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``neighbours.nearest`` of exact distances, which are taken only where a matrix product says they may be small enough."""
    if len(x) <= k or np.isnan(q).any() or np.isnan(x).any():
        return nearest(distances(q, x), k, np.full(len(q), np.inf))
    own, size = (q**2).sum(axis=1), (x**2).sum(axis=1)
    rough = size - 2 * (q @ x.T)
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 1e-9 * (own + size.max())
    row, column = np.nonzero(rough <= limit[:, None])
    dist = np.zeros(len(row))
    for j in range(x.shape[1]):
        dist += (q[row, j] - x[column, j]) ** 2
    order = np.lexsort((column, dist, row))
    row, column = row[order], column[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[kept], column[kept]


def vote_jobs(points: dict, columns: Callable, folds: Sequence[int]) -> list[VoteJob]:
    jobs: dict[tuple, VoteJob] = {}
    for name, spec in points.items():
        for f in folds:
            c = columns(f, name)
            jobs.setdefault((f, c, spec.k), VoteJob(f, c, spec.k, [])).points.append(name)
    return list(jobs.values())


def tree_jobs(rows: DataFrame, points: dict, columns: Callable, folds: Sequence[int], seed: int, width: int) -> list[TreeJob]:
    """One job per fold and distinct model. Cuts to be searched come from quantiles over all training rows of a fold."""
    largest, where = _largest(points, columns, folds, seed)
    kind = next(iter(points.values())).kind
    edges = {} if kind == "extra" else gang.bin_edges(rows, width, gang.bins_of(kind))
    return [TreeJob(m, where[m.fold, key], edges.get(m.fold)) for key, m in largest.items()]


def net_jobs(points: dict, columns: Callable, folds: Sequence[int], classes: int, seed: int, spread: Callable) -> list[NetJob]:
    nets = _nets(points, columns, folds, classes, seed, spread)
    if not any(spec.kernel for spec in points.values()):
        return [NetJob([net], names, False) for net, names in nets.items()]
    of_point: dict[tuple, list] = {}
    for net, names in nets.items():
        for name in names:
            of_point.setdefault((net.fold, name), []).append(net)
    jobs: dict[tuple, NetJob] = {}
    for (fold, name), some in of_point.items():
        job = jobs.setdefault((fold, some[0].columns, some[0].lift), NetJob([], [], True))
        job.nets += [net for net in some if net not in job.nets]
        job.points.append(name)
        job.own.append([job.nets.index(net) for net in some])
    return list(jobs.values())


def confusions_in_tasks(rows: DataFrame, jobs: Sequence[TreeJob | NetJob | VoteJob], names: Sequence, classes: int) -> dict[tuple, np.ndarray]:
    """``confusions`` of models that are fitted in tasks, each over the rows of its fold.

    A fold's held-out rows are scored, or its training rows where it has none. Only counts leave a task. Where rows have an
    ``id``, models see them in its order, else in that of ``rid``.
    """
    jobs, number = list(jobs), {name: k for k, name in enumerate(names)}
    places = rows.sparkSession.createDataFrame([(k, job.fold) for k, job in enumerate(jobs)], "job int, fold int")

    def run(table: pa.Table) -> pa.Table:
        job = jobs[table["job"][0].as_py()]
        rid, label, weight, held = (table[c].to_numpy() for c in ("rid", "label", "weight", "held"))
        x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(rid), -1)
        # Sums do not depend on how rows arrive.
        by_id = "id" in table.column_names
        order = pc.sort_indices(table["id"], null_placement="at_start").to_numpy() if by_id else np.argsort(rid, kind="stable")
        inside, outside = order[~held[order]], order[held[order]]
        outside = outside if len(outside) else inside
        rows_held = gang.Held([(job.fold, rid[inside], label[inside], weight[inside], x[inside])])
        cells = []
        for name, guess in job.guesses(rows_held, x[outside], classes):
            counts = np.bincount(label[outside] * classes + guess, minlength=classes * classes)
            cells += [(number[name], job.fold, c, int(n)) for c, n in enumerate(counts) if n]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        values = zip(*cells, strict=True) if cells else [()] * 4
        return pa.table([pa.array(v, type=t) for v, t in zip(values, kinds, strict=True)], names=["point", "fold", "cell", "n"])

    # A model is one group in a task of its own; folds are as many as the models ask for.
    dealt = rows.join(F.broadcast(places), "fold").repartitionById(max(1, len(jobs)), "job")
    out: dict[tuple, np.ndarray] = {}
    for r in dealt.groupBy("job").applyInArrow(run, "point int, fold int, cell int, n long").collect():
        out.setdefault((names[r["point"]], r["fold"]), np.zeros((classes, classes)))[divmod(r["cell"], classes)] += r["n"]
    return out


def f1(counts: np.ndarray, binary: bool) -> float:
    """F1 of the last class, or the mean over the classes that occur; a zero divisor gives 0."""
    hits, support, guessed = np.diag(counts), counts.sum(axis=1), counts.sum(axis=0)
    values = np.where(support + guessed > 0, 2 * hits / np.maximum(support + guessed, 1), 0.0)
    return float(values[-1]) if binary else float(values[support + guessed > 0].mean())
