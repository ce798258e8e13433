"""Many smooth models fitted in the same passes: each pass sums losses and gradients of all of them over the rows.

Logistic regressions, perceptrons and support vector machines on random features of many folds and parameter points take
their L-BFGS steps together. A pass sends every unfinished model's trial weights out and gets its loss and gradient back, so
the number of passes does not depend on the number of models or rows. What is minimised is the weighted sum of the rows'
losses plus half the penalty times the squared weights (biases are free). The driver holds weights, never rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortspark.ml.gang import DIRECT_CELLS, DIRECT_TASKS, ROW_SCHEMA, Held, batches, uniform

MEMORY = 10
SMOOTH = 0.1  # width of the rounded corner of the hinge
PARTS = 5
NEAR_ROWS = 2048  # lifted rows of a task that are read twice in turn


@dataclass(frozen=True)
class Fourier:
    """Random features whose inner products approximate exp(-gamma |x - y|^2)."""

    gamma: float
    size: int = 256
    seed: int = 42

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0.0, np.sqrt(2 * self.gamma), (x.shape[1], self.size))
        shift, out = rng.uniform(0, 2 * np.pi, self.size), np.empty((len(x), self.size))
        for a in range(0, len(x), NEAR_ROWS):
            part = out[a : a + NEAR_ROWS]
            np.cos(x[a : a + NEAR_ROWS] @ w + shift, out=part)
            part *= np.sqrt(2 / self.size)
        return out


@dataclass(frozen=True)
class Net:
    """One model of one fold. ``loss`` is logistic (softmax for more than two classes) or hinge (class ``target`` against the others)."""

    fold: int
    columns: tuple[int, ...]
    classes: int
    hidden: tuple[int, ...] = ()
    penalty: float = 1.0
    loss: str = "logistic"
    weighted: bool = False
    lift: Fourier | None = None
    without: int = -1  # part of the rows that is left out
    target: int = -1
    seed: int = 42
    max_iter: int = 200

    @property
    def outputs(self) -> int:
        return 1 if self.classes == 2 or self.loss == "hinge" else self.classes

    def shapes(self) -> list[tuple[int, int]]:
        sizes = [self.lift.size if self.lift else len(self.columns), *self.hidden, self.outputs]
        return list(zip(sizes[:-1], sizes[1:], strict=True))

    def start(self) -> np.ndarray:
        """Zeros for a model without hidden units, else small weights that depend on the seed alone."""
        rng, parts = np.random.default_rng(self.seed), []
        for a, b in self.shapes():
            bound = np.sqrt((6.0 if self.hidden else 0.0) / (a + b))
            parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
        return np.concatenate(parts)

    def layers(self, theta: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        for a, b in self.shapes():
            yield theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]
            at += a * b + b

    def inputs(self, x: np.ndarray) -> np.ndarray:
        x = x[:, list(self.columns)]
        return self.lift(x) if self.lift else x

    def outcome(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Values (row, output) before the logistic function."""
        out = self.inputs(x)
        layers = list(self.layers(theta))
        for k, (w, b) in enumerate(layers):
            out = out @ w + b
            if k < len(layers) - 1:
                out = np.maximum(out, 0)
        return out

    def probabilities(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = self.outcome(theta, x)
        if self.outputs == 1:
            p = 1 / (1 + np.exp(-np.clip(z[:, 0], -700, 700)))
            return np.stack([1 - p, p], axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def loss_and_gradient(self, theta: np.ndarray, inputs: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        layers, seen = list(self.layers(theta)), [inputs]
        for k, (w, b) in enumerate(layers):
            z = seen[-1] @ w + b
            seen.append(np.maximum(z, 0) if k < len(layers) - 1 else z)
        value, back = self.losses(seen[-1], label)
        back = back * weight[:, None]
        parts = []
        for k in range(len(layers) - 1, -1, -1):
            parts = [(seen[k].T @ back).ravel(), back.sum(axis=0), *parts]
            if k:
                back = (back @ layers[k][0].T) * (seen[k] > 0)
        return float((value * weight).sum()), np.concatenate(parts)

    def losses(self, z: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss of every row with outcomes ``z`` and its derivatives by them."""
        if self.loss == "hinge":
            side = np.where(label == self.target, 1.0, -1.0)
            short = 1 - side * z[:, 0]
            bent = np.clip(short, 0, SMOOTH)
            value = np.where(short > SMOOTH, short - SMOOTH / 2, bent**2 / (2 * SMOOTH))
            back = (-side * bent / SMOOTH)[:, None]
        elif self.outputs == 1:
            y = (label == (1 if self.target < 0 else self.target)) * 1.0
            value = np.logaddexp(0, z[:, 0]) - y * z[:, 0]
            back = (1 / (1 + np.exp(-np.clip(z[:, 0], -700, 700))) - y)[:, None]
        else:
            top = z.max(axis=1, keepdims=True)
            total = np.exp(z - top).sum(axis=1, keepdims=True)
            rows = np.arange(len(z))
            value = np.log(total[:, 0]) + top[:, 0] - z[rows, label]
            back = np.exp(z - top) / total
            back[rows, label] -= 1
        return value, back

    def penalised(self, theta: np.ndarray, loss: float, gradient: np.ndarray) -> tuple[float, np.ndarray]:
        gradient, at = gradient.copy(), 0
        for a, b in self.shapes():
            w = theta[at : at + a * b]
            loss += 0.5 * self.penalty * float(w @ w)
            gradient[at : at + a * b] += self.penalty * w
            at += a * b + b
        return loss, gradient


@dataclass(frozen=True)
class Margin:
    """Input of a calibration: the margin of the machine that has not seen the row's part."""

    nets: tuple[Net, ...]
    thetas: tuple


def part_of(rid: np.ndarray, seed: int) -> np.ndarray:
    return (uniform(seed + 11, rid) * PARTS).astype(int)


def _add_up(data: Iterable[pa.RecordBatch] | Held, nets: Sequence[Net], thetas: dict, of_fold: dict) -> dict[int, tuple[float, np.ndarray]]:
    """Loss and gradient over the rows of a task; of rows that it holds the inputs are kept, and read once for all machines."""
    total: dict[int, tuple[float, np.ndarray]] = {}

    def add(k: int, loss: float, gradient: np.ndarray) -> None:
        before = total.get(k)
        total[k] = (loss, gradient) if before is None else (before[0] + loss, before[1] + gradient)

    for part, (fold, rid, label, weight, x) in enumerate(batches(data)):
        lifted: dict = data.kept.setdefault(part, {}) if isinstance(data, Held) else {}
        side_by_side: dict[tuple, list] = {}
        for k in of_fold.get(fold, ()):
            net = nets[k]
            key = (net.columns, net.lift)
            if key not in lifted:
                lifted[key] = net.inputs(x)
            kept = ("weight", net.weighted, net.without, net.seed)
            if kept not in lifted:
                w = weight if net.weighted else np.ones(len(x))
                lifted[kept] = w * (part_of(rid, net.seed) != net.without) if net.without >= 0 else w
            w = lifted[kept]
            if isinstance(data, Held) and net.lift:
                side_by_side.setdefault(key, []).append((k, w))
            else:
                add(k, *net.loss_and_gradient(thetas[k], lifted[key], label, w))
        for key, some in side_by_side.items():
            # A machine is a row here: products of few rows with many are the faster ones this way round.
            trial = np.stack([thetas[k] for k, _ in some])
            gradients, losses = np.zeros_like(trial), np.zeros(len(some))
            # Some rows at a time, so that the second product reads them while they are near.
            for a in range(0, len(x), NEAR_ROWS):
                rows = slice(a, a + NEAR_ROWS)
                inputs = lifted[key][rows]
                back = trial[:, :-1] @ inputs.T + trial[:, -1:]
                for j, (k, w) in enumerate(some):
                    value, by = nets[k].losses(back[j][:, None], label[rows])
                    back[j] = by[:, 0] * w[rows]
                    losses[j] += float(value @ w[rows])
                gradients[:, :-1] += back @ inputs
                gradients[:, -1] += back.sum(axis=1)
            for j, (k, _) in enumerate(some):
                add(k, float(losses[j]), gradients[j].copy())
    return total


def _sums(rows: DataFrame | Held, nets: Sequence[Net], thetas: dict[int, np.ndarray], tasks: int) -> dict[int, tuple[float, np.ndarray]]:
    """Loss and gradient of the models in ``thetas`` over their folds' rows."""
    by_fold: dict[int, list[int]] = {}
    for k in thetas:
        by_fold.setdefault(nets[k].fold, []).append(k)
    if isinstance(rows, Held):
        return _add_up(rows, nets, thetas, by_fold)
    shared = rows.sparkSession.sparkContext.broadcast((list(nets), thetas, by_fold))

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _add_up(data, *shared.value)
        if total:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(total), type=pa.int64()),
                    pa.array([np.append(loss, g).tobytes() for loss, g in total.values()], type=pa.binary()),
                ],
                names=["k", "sums"],
            )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in table["sums"].to_pylist())
        return pa.table({"k": table["k"][:1], "sums": pa.array([total.tobytes()], type=pa.binary())})

    found = rows.mapInArrow(run, "k long, sums binary")
    if tasks > DIRECT_TASKS and tasks * sum(map(len, thetas.values())) > DIRECT_CELLS:
        found = found.groupBy("k").applyInArrow(add, "k long, sums binary")
    out: dict[int, np.ndarray] = {}
    table = found.toArrow()
    for k, b in zip(table["k"].to_pylist(), table["sums"].to_pylist(), strict=True):
        out[k] = out.get(k, 0) + np.frombuffer(b)
    shared.destroy()
    return {k: (float(s[0]), s[1:]) for k, s in out.items()}


def _held_margin(source: Margin, rid: np.ndarray, x: np.ndarray) -> np.ndarray:
    part, out = part_of(rid, source.nets[0].seed), np.zeros((len(x), 1))
    for net, theta in zip(source.nets, source.thetas, strict=True):
        mine = part == net.without
        if mine.any():
            out[mine] = net.outcome(theta, x[mine])
    return out


def _with_margins(rows: DataFrame | Held, of_fold: dict[int, list[Margin]]) -> DataFrame | Held:
    """The rows with the margins of their fold's machines in place of their columns; folds with fewer are filled with zeros."""
    width = max(map(len, of_fold.values()))

    def found(data: Iterable[pa.RecordBatch] | Held) -> Iterator[tuple]:
        for fold, rid, label, weight, x in batches(data):
            sources = of_fold.get(fold, ())
            if sources:
                margins = np.zeros((len(x), width))
                for j, source in enumerate(sources):
                    margins[:, j : j + 1] = _held_margin(source, rid, x)
                yield fold, rid, label, weight, margins

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, rid, label, weight, x in found(data):
            columns = [np.full(len(x), fold, dtype=np.int32), rid, label, weight]
            margins = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), margins], names=["fold", "rid", "label", "weight", "x"])

    if isinstance(rows, Held):
        return Held(list(found(rows)))
    return rows.mapInArrow(run, ROW_SCHEMA)


class _Steps:
    """L-BFGS state of one model."""

    def __init__(self, theta: np.ndarray, loss: float, gradient: np.ndarray) -> None:
        self.theta, self.loss, self.gradient = theta, loss, gradient
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.begin()

    def begin(self) -> None:
        q, used = self.gradient.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y), a in zip(self.pairs, reversed(used), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        self.direction, self.slope, self.step = -q, -float(self.gradient @ q), 1.0
        if self.slope >= 0:
            self.pairs = []
            self.direction, self.slope = -self.gradient, -float(self.gradient @ self.gradient)
            self.step = 1.0 / max(1.0, np.linalg.norm(self.gradient))

    def trial(self) -> np.ndarray:
        return self.theta + self.step * self.direction

    def take(self, loss: float, gradient: np.ndarray, tolerance: float) -> bool:
        """Judge the trial; True when the model is finished."""
        if not loss <= self.loss + 1e-4 * self.step * self.slope:
            self.step *= 0.3
            if self.step >= 1e-10:
                return False
            if not self.pairs:
                return True
            self.pairs = []  # the memory may span a kink: go on along the gradient
            self.begin()
            return False
        theta = self.trial()
        s, y = theta - self.theta, gradient - self.gradient
        if s @ y > 1e-12 * (y @ y):
            self.pairs = [*self.pairs[-MEMORY + 1 :], (s, y)]
        gained = self.loss - loss
        self.theta, self.loss, self.gradient = theta, loss, gradient
        if np.abs(gradient).max() <= tolerance or gained <= 1e-9 * max(1.0, abs(loss)):
            return True
        self.begin()
        return False


def minimise(rows: DataFrame | Held, nets: Sequence[Net], tolerance: float = 1e-4) -> list[np.ndarray]:
    """Weights of every model. Models that are finished take no further part in the passes."""
    tasks = 1 if isinstance(rows, Held) else rows.rdd.getNumPartitions()
    at = {k: net.start() for k, net in enumerate(nets)}
    first = _sums(rows, nets, at, tasks)
    states = {k: _Steps(at[k], *nets[k].penalised(at[k], *first[k])) for k in at if k in first}
    going = {k for k, s in states.items() if np.abs(s.gradient).max() > tolerance}
    turn = 0
    while going:
        trials = {k: states[k].trial() for k in going}
        for k, (loss, gradient) in _sums(rows, nets, trials, tasks).items():
            if states[k].take(*nets[k].penalised(trials[k], loss, gradient), tolerance):
                going.discard(k)
        turn += 1
        going = {k for k in going if turn < nets[k].max_iter}
    return [states[k].theta if k in states else at[k] for k in at]


@dataclass
class Machine:
    """A two-class support vector machine with a logistic curve over its margin."""

    net: Net
    theta: np.ndarray
    curve: np.ndarray  # slope, offset

    def chance(self, x: np.ndarray) -> np.ndarray:
        z = self.net.outcome(self.theta, x)[:, 0] * self.curve[0] + self.curve[1]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def chances(found: Sequence[Machine], x: np.ndarray) -> np.ndarray:
    """Chances (row, machine) by machines that read the same inputs."""
    out = np.empty((len(x), len(found)))
    for a in range(0, len(x), NEAR_ROWS):
        inputs = found[0].net.inputs(x[a : a + NEAR_ROWS])
        for j, m in enumerate(found):
            [(w, b)] = m.net.layers(m.theta)
            z = (inputs @ w + b)[:, 0] * m.curve[0] + m.curve[1]
            out[a : a + NEAR_ROWS, j] = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return out


def machines(rows: DataFrame | Held, wanted: Sequence[Net]) -> list[Machine]:
    """Fit hinge models, each also without each of ``PARTS`` parts of the rows, and curves over margins of unseen rows."""
    from dataclasses import replace

    nets = [replace(net, without=p) for net in wanted for p in (-1, *range(PARTS))]
    thetas = minimise(rows, nets)
    curves, of_fold = [], {}
    for i, net in enumerate(wanted):
        at = i * (PARTS + 1)
        mine = of_fold.setdefault(net.fold, [])
        curves.append(Net(net.fold, (len(mine),), 2, penalty=1e-6, target=net.target, seed=net.seed, max_iter=60))
        mine.append(Margin(tuple(nets[at + 1 : at + 1 + PARTS]), tuple(thetas[at + 1 : at + 1 + PARTS])))
    # Margins are the same in every pass: rows are lifted for them once.
    margins = _with_margins(rows, of_fold)
    if isinstance(margins, Held):
        fitted = minimise(margins, curves)
    else:
        margins = margins.persist()
        try:
            fitted = minimise(margins, curves)
        finally:
            margins.unpersist()
    return [Machine(net, thetas[i * (PARTS + 1)], fitted[i]) for i, net in enumerate(wanted)]
