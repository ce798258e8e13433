"""Many tree models grown in the same passes over a table of folds.

The table has a row for every (fold, training row). All trees of all models, folds and parameter points grow level by level
together: a pass routes each row down the trees of its fold, adds up what splits need to know per (tree, node, candidate
column, bin), sums that by tree in a shuffle, and sends back one split per node. The number of passes depends on depth
and rounds only, neither on the number of models, folds or points nor on the rows. Sizes of a forest and of a boosting run
are prefixes of the largest one, depths are cuts of the deepest one, so a grid needs no model twice.

Driver and broadcasts hold the trees, never rows. A task works on pieces of rows bounded by ``CELLS``.

The same passes run inside a task over the rows of one fold that it holds (``Held``); there they keep what the next pass needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from copy import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, BOOST_BINS = 255, 63  # cuts of a column at most; boosting adds up every column of every node
CELLS = 1 << 20  # (tree, row) pairs a task handles at a time
DENSE_CELLS, CACHED_CELLS = 1 << 20, 1 << 17  # sums a task keeps at most, and pairs it handles at a time where it does
DIRECT_TASKS, DIRECT_CELLS = 32, 4_000_000
BLOCK = 64  # trees whose splits are found together
ROW_SCHEMA = "fold int, rid long, label int, weight double, x array<double>"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# Poisson(1) counts by inverse distribution, the bootstrap of a table of any size.
_POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def uniform(*keys) -> np.ndarray:
    """Numbers in [0, 1) that depend on the keys alone (broadcast against each other)."""
    h = np.full(1, 0x9E3779B97F4A7C15, dtype=np.uint64)
    for k in keys:
        h = h + np.atleast_1d(np.asarray(k)).astype(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
        h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)) / 2.0**53


@dataclass(frozen=True)
class Member:
    """One model of one fold. ``columns`` are places in the row's vector.

    ``kind``: forest (bootstrap or not, cuts searched), extra (no bootstrap, cuts drawn per node), boost or ada.
    """

    fold: int
    columns: tuple[int, ...]
    kind: str = "forest"
    trees: int = 1  # rounds for boost and ada
    depth: int = 30
    leaf: int = 1
    per_node: int = 0  # candidate columns of a node, 0 for all
    bootstrap: bool = False
    weighted: bool = False
    rate: float = 1.0
    subsample: float = 1.0
    seed: int = 42
    first: int = 0  # number of its first tree, where the trees of a forest are grown in parts


@dataclass
class Trees:
    """Binary trees as arrays over (tree, node); node 0 is the root, a right child follows its left one."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    used: np.ndarray

    @classmethod
    def roots(cls, n: int, width: int) -> Trees:
        return cls(
            np.full((n, 1), -1, dtype=np.int16),
            np.zeros((n, 1)),
            np.zeros((n, 1), dtype=np.int32),
            np.zeros((n, 1, width)),
            np.ones(n, dtype=np.int64),
        )

    def widen(self, nodes: int) -> None:
        more = nodes - self.feature.shape[1]
        if more > 0:
            pad = lambda a, v: np.concatenate([a, np.full((len(a), more, *a.shape[2:]), v, a.dtype)], axis=1)
            self.feature, self.cut, self.child = pad(self.feature, -1), pad(self.cut, 0), pad(self.child, 0)
            self.value = pad(self.value, 0)

    def route(self, trees: slice, x: np.ndarray, depth: int, at: np.ndarray | None = None) -> np.ndarray:
        """Node (tree, row) in which each row of ``x`` ends after at most ``depth`` steps from the root or from ``at``."""
        feature, cut, child = self.feature[trees], self.cut[trees], self.child[trees]
        # Places in the flat arrays: gathers by one number are several times faster than by two. Leaves lead to themselves.
        first = np.arange(len(feature))[:, None] * feature.shape[1]
        row, flat = np.arange(len(x))[None, :] * x.shape[1], x.ravel()
        leaf, places = feature < 0, np.arange(feature.size).reshape(feature.shape)
        child = np.where(leaf, places, child + first).ravel()
        cut = np.where(leaf, np.inf, cut).ravel()
        column = np.maximum(feature, 0).astype(np.int64).ravel()
        at = np.repeat(first, len(x), axis=1) if at is None else at + first
        for _ in range(depth):
            to = child.take(at) + (flat.take(row + column.take(at)) > cut.take(at))
            if np.array_equal(to, at):
                break
            at = to
        return at - first

    def take(self, trees: slice) -> Trees:
        return Trees(*[a[trees] for a in (self.feature, self.cut, self.child, self.value, self.used)])


@dataclass
class Held:
    """Rows of folds that a task holds, as ``batches`` gives them, and what it keeps of them between passes."""

    parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    kept: dict = field(default_factory=dict)


def batches(data: Iterable[pa.RecordBatch] | Held) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(fold, row keys, classes, weights, matrix) of the rows of each batch, fold by fold."""
    if isinstance(data, Held):
        yield from data.parts
        return
    for batch in data:
        if not batch.num_rows:
            continue
        fold, rid, label, weight = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("fold", "rid", "label", "weight"))
        x = batch.column(batch.schema.names.index("x")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for f in np.unique(fold):
            mine = fold == f
            yield int(f), rid[mine], label[mine], weight[mine], x[mine]


@dataclass
class Gang:
    """Members of one kind, the trees they have so far, and how a row counts in each tree."""

    members: Sequence[Member]
    classes: int
    edges: dict[int, list[np.ndarray]]  # fold: cuts of every column
    priors: dict[int, np.ndarray]  # fold: share of every class
    trees: Trees = field(init=False)
    past: Trees | None = None  # boost and ada: the trees of earlier rounds, round after round
    rounds: int = 0
    alphas: np.ndarray | None = None  # ada: (round, member)
    alive: np.ndarray | None = None
    weighted: dict[int, np.ndarray] = field(default_factory=dict)
    tasks: int = 1

    def __post_init__(self) -> None:
        self.kind = self.members[0].kind
        self.each = [self.per_member(m) for m in self.members]
        self.first = np.concatenate([[0], np.cumsum(self.each)]).astype(int)
        self.member_of = np.repeat(np.arange(len(self.members)), self.each)
        self.fresh()

    def per_member(self, m: Member) -> int:
        if self.kind == "boost":
            return 1 if self.classes == 2 else self.classes
        return 1 if self.kind == "ada" else m.trees

    @property
    def width(self) -> int:
        """Numbers of a node, the last one its count."""
        return 3 if self.kind == "boost" else self.classes + 1

    @property
    def sent(self) -> int:
        """Numbers a row adds to its cell; elsewhere than in boosting a cell has a class, of which two are enough."""
        return 3 if self.kind == "boost" else 2

    def for_growth(self) -> Gang:
        """What tasks need to grow a level: all but the values of the trees in hand."""
        out = copy(self)
        out.trees = copy(self.trees)
        out.trees.value = self.trees.value[:, :, :0]
        return out

    def fresh(self) -> None:
        self.trees = Trees.roots(len(self.member_of), self.width)

    def slice(self, k: int) -> slice:
        return slice(self.first[k], self.first[k + 1])

    def margins(self, k: int, x: np.ndarray, rounds: int | None = None, known: tuple | None = None) -> np.ndarray:
        """Boosted scores (class, row) of a member after its first rounds; one row of scores for two classes.

        ``known``: rounds whose scores are known already, and these."""
        m = self.members[k]
        if known is not None:
            done, total = known
            for some in self.earlier(k, rounds, done):
                total = total + self._steps(some, m, x, total.shape)
            return total
        prior = self.priors[m.fold]
        if self.classes == 2:
            start = np.log(max(prior[1], 1e-12) / max(prior[0], 1e-12)) * np.ones((1, 1))
        else:
            start = np.log(np.maximum(prior, 1e-12))[:, None]
        total = np.repeat(start, len(x), axis=1)
        for some in self.earlier(k, rounds):
            total += self._steps(some, m, x, total.shape)
        return total

    @staticmethod
    def _steps(some: Trees, m: Member, x: np.ndarray, shape: tuple) -> np.ndarray:
        at = some.route(slice(None), x, m.depth)
        return m.rate * some.value[np.arange(len(at))[:, None], at, 0].reshape(-1, *shape).sum(axis=0)

    def earlier(self, k: int, rounds: int | None = None, done: int = 0) -> Iterator[Trees]:
        """Trees of a member's first rounds without those ``done``, all of one row's at once."""
        n = self.rounds if rounds is None else min(rounds, self.rounds)
        if n > done:
            places = (np.arange(done, n)[:, None] * len(self.member_of) + np.arange(self.first[k], self.first[k + 1])).ravel()
            yield self.past.take(places)

    def chosen(self, k: int, x: np.ndarray, rounds: int | None = None, done: int = 0) -> np.ndarray:
        """Class (round, row) that each stump of a member votes for, but those of the rounds ``done``."""
        for some in self.earlier(k, rounds, done):
            at = some.route(slice(None), x, 1)
            return some.value[np.arange(len(at))[:, None], at, :-1].argmax(axis=2)
        return np.zeros((0, len(x)), dtype=np.int64)

    def votes(self, k: int, x: np.ndarray, rounds: int | None = None) -> np.ndarray:
        """Sum of the stumps' votes (class, row) of a member."""
        best = self.chosen(k, x, rounds)
        return np.stack([(self.alphas[: len(best), k][:, None] * (best == c)).sum(axis=0) for c in range(self.classes)])

    def stats(self, k: int, rid: np.ndarray, label: np.ndarray, weight: np.ndarray, x: np.ndarray, memo: dict | None = None) -> np.ndarray:
        """(tree, row, number) that the rows of a piece add to their cells; ``memo`` holds their scores after earlier rounds."""
        m = self.members[k]
        n = len(x)
        if self.kind == "boost":
            f = self.margins(k, x, known=None if memo is None else memo.get("score"))
            if memo is not None:
                memo["score"] = self.rounds, f
            if self.classes == 2:
                p = 1 / (1 + np.exp(-f))
                g = (label == 1) - p
                h = p * (1 - p)
            else:
                p = np.exp(f - f.max(axis=0))
                p /= p.sum(axis=0)
                g = (np.arange(self.classes)[:, None] == label) - p
                h = np.abs(g) * (1 - np.abs(g)) * self.classes / (self.classes - 1)
            used = uniform(m.seed, self.rounds, rid) < m.subsample
            return np.stack([g * used, h * used, np.repeat(used[None, :] * 1.0, len(g), axis=0)], axis=2)
        if self.kind == "ada":
            wrong = self.wrong(k, label, x, None if memo is None else memo.get("score"))
            if memo is not None:
                memo["score"] = self.rounds, wrong
            w = np.exp(wrong)
        else:
            w = weight if m.weighted else np.ones(n)
        times = np.ones((self.each[k], n))
        if m.bootstrap:
            u = uniform(m.seed, m.first + np.arange(m.trees)[:, None], rid[None, :])
            times = np.searchsorted(_POISSON, u, side="right").astype(float)
        return np.stack([times * w, times], axis=2)

    def wrong(self, k: int, label: np.ndarray, x: np.ndarray, known: tuple | None = None) -> np.ndarray:
        """Logarithm of a row's boosting weight."""
        done, before = known or (0, 0.0)
        best = self.chosen(k, x, done=done)
        return before + (self.alphas[done : done + len(best), k][:, None] * (best != label)).sum(axis=0)

    def close(self, trees: Trees) -> None:
        """Keep a round's trees."""
        if self.past is None:
            self.past = trees
        else:
            nodes = max(self.past.feature.shape[1], trees.feature.shape[1])
            self.past.widen(nodes)
            trees.widen(nodes)
            pairs = zip(vars(self.past).values(), vars(trees).values(), strict=True)
            self.past = Trees(*[np.concatenate(p) for p in pairs])
        self.rounds += 1


@dataclass
class Frontier:
    """Nodes to be split in a pass, with their candidate columns and, where cuts are drawn, these."""

    tree: np.ndarray
    node: np.ndarray
    columns: np.ndarray  # (node, candidate)
    drawn: np.ndarray  # the candidates' places among the columns of their model
    place: np.ndarray  # (tree, node) -> number in the frontier, -1 for none
    cuts: np.ndarray | None = None


def _cells(gang: Gang, front: Frontier, level: int, ranges: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums per (frontier node, candidate, bin) of each task's rows, or the range of the columns in the nodes."""
    by_fold: dict[int, list[int]] = {}
    for k, m in enumerate(gang.members):
        by_fold.setdefault(m.fold, []).append(k)

    # Few cells are added up over all rows of a task, many leave it piece by piece.
    size = front.columns.size * (1 if ranges else _per_cell(gang, front))
    cells = CACHED_CELLS if size <= DENSE_CELLS else CELLS

    def run(data: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kept = None, data.kept if isinstance(data, Held) else None
        for part, (fold, rid, label, weight, x) in enumerate(batches(data)):
            bins = None
            if front.cuts is None and not ranges:
                bins = kept.get(part) if kept is not None else None
                if bins is None:
                    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(gang.edges[fold])], axis=1)
                if kept is not None:
                    kept[part] = bins
            for k in by_fold.get(fold, ()):
                trees = gang.slice(k)
                if not (front.place[trees] >= 0).any():
                    continue
                step = max(1, (cells if kept is None else CACHED_CELLS) // (gang.each[k] * front.columns.shape[1]))
                for a in range(0, len(x), step):
                    rows = slice(a, a + step)
                    memo = None if kept is None else kept.setdefault((part, k, a), {})
                    piece = _piece(gang, front, level, ranges, k, rid[rows], label[rows], weight[rows], x[rows], None if bins is None else bins[rows], memo)
                    if piece is None:
                        continue
                    if size > DENSE_CELLS:
                        keys, numbers = _ranges_of(*piece) if ranges else _sums_of(*piece)
                        yield _sent(gang, front, ranges, keys, numbers)
                        continue
                    if total is None:
                        total = np.repeat([[np.inf], [-np.inf]], size, axis=1) if ranges else np.zeros((gang.sent, size))
                    _add(total, ranges, *piece)
        if total is not None:
            keys = np.flatnonzero(total[1] >= total[0] if ranges else total[-1])
            if len(keys):
                yield _sent(gang, front, ranges, keys, np.ascontiguousarray(total[:, keys].T))

    return run


def _per_cell(gang: Gang, front: Frontier) -> int:
    """Keys of a (node, candidate): its bins, two where a cut is drawn, times the classes but in boosting."""
    return (BINS + 1 if front.cuts is None else 2) * (1 if gang.kind == "boost" else gang.classes)


def _standing(gang, level, k, rid, label, weight, x, memo) -> tuple[np.ndarray, np.ndarray]:
    """Node of every row in every tree and what the row adds there; rows that a task holds take one step from where they stood."""
    trees = gang.slice(k)
    if memo is None:
        return gang.trees.route(trees, x, level), gang.stats(k, rid, label, weight, x)
    if memo.get("round") != gang.rounds:
        memo.update(round=gang.rounds, level=0, at=np.zeros((gang.each[k], len(x)), dtype=np.int64), stats=gang.stats(k, rid, label, weight, x, memo))
    if memo["level"] < level:
        memo["at"] = gang.trees.route(trees, x, level - memo["level"], memo["at"])
        memo["level"] = level
    return memo["at"], memo["stats"]


def _piece(gang, front, level, ranges, k, rid, label, weight, x, bins, memo=None) -> tuple[np.ndarray, np.ndarray] | None:
    """Keys (entry, candidate) and their values, or the numbers (entry, number) that all candidates of an entry add."""
    trees = gang.slice(k)
    at, stats = _standing(gang, level, k, rid, label, weight, x, memo)
    where = front.place[trees].ravel().take(at + np.arange(at.shape[0])[:, None] * front.place.shape[1])
    chosen = np.flatnonzero((where >= 0) & (stats[:, :, -1] > 0))
    if not len(chosen):
        return None
    node, r = where.ravel().take(chosen).astype(np.int64), chosen % len(x)
    columns = front.columns.take(node, axis=0)
    slots = columns.shape[1]
    cell = node[:, None] * slots + np.arange(slots)
    at = columns + (r * x.shape[1])[:, None]
    if ranges:
        return cell, x.ravel().take(at)
    key = cell * (BINS + 1 if bins is not None else 2)
    key += x.ravel().take(at) > front.cuts.take(node, axis=0) if bins is None else bins.ravel().take(columns + (r * bins.shape[1])[:, None])
    if gang.kind != "boost":
        key = key * gang.classes + label.take(r)[:, None]
    return key, stats.reshape(-1, stats.shape[2]).take(chosen, axis=0)


def _add(total: np.ndarray, ranges: bool, keys: np.ndarray, numbers: np.ndarray) -> None:
    """Take a piece into the sums or ranges (number, key) of a task."""
    if ranges:
        np.minimum.at(total[0], keys.ravel(), numbers.ravel())
        np.maximum.at(total[1], keys.ravel(), numbers.ravel())
        return
    slots, flat = keys.shape[1], keys.ravel()
    low, span = flat.min(), np.ptp(flat) + 1
    flat = flat - low
    for s in range(len(total)):
        total[s, low : low + span] += np.bincount(flat, np.repeat(numbers[:, s], slots), span)


def _ranges_of(cell: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(cell.ravel(), kind="stable")
    keys, starts = np.unique(cell.ravel()[order], return_index=True)
    v = values.ravel()[order]
    return keys, np.stack([np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)], axis=1)


def _sums_of(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slots, key = keys.shape[1], keys.ravel()
    low, span = key.min(), np.ptp(key) + 1
    if span <= 4 * len(key):
        many = np.repeat(sums, slots, axis=0)
        numbers = np.stack([np.bincount(key - low, many[:, s], span) for s in range(many.shape[1])], axis=1)
        filled = np.flatnonzero(numbers[:, -1])
        return filled + low, numbers[filled]
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[starts], np.add.reduceat(sums[order // slots], starts, axis=0)


def _sent(gang: Gang, front: Frontier, ranges: bool, keys: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and their numbers as they leave a task, cut at the blocks of trees."""
    per_node = front.columns.shape[1] * (1 if ranges else _per_cell(gang, front))
    owner = front.tree[keys // per_node] // BLOCK
    if not ranges and front.cuts is not None:
        # Two bins so far, numbered as where cuts are searched from here on.
        classes = 1 if gang.kind == "boost" else gang.classes
        keys = (keys // (2 * classes) * (BINS + 1) + keys // classes % 2) * classes + keys % classes
    cuts = np.flatnonzero(np.diff(owner)) + 1 if len(owner) else []
    begins, ends = [0, *cuts], [*cuts, len(keys)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(owner[begins], type=pa.int64()),
            pa.array([keys[i:j].tobytes() for i, j in zip(begins, ends, strict=True)], type=pa.binary()),
            pa.array([numbers[i:j].tobytes() for i, j in zip(begins, ends, strict=True)], type=pa.binary()),
        ],
        names=["block", "keys", "numbers"],
    )


def _parts(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(b, dtype=np.int64) for b in table["keys"].to_pylist()])
    numbers = np.concatenate([np.frombuffer(b).reshape(-1, width) for b in table["numbers"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    return keys[order], numbers[order]


def _ranges(table: pa.Table) -> pa.Table:
    keys, numbers = _parts(table, 2)
    keys, starts = np.unique(keys, return_index=True)
    low, high = np.minimum.reduceat(numbers[:, 0], starts), np.maximum.reduceat(numbers[:, 1], starts)
    return pa.table({"key": keys, "low": low, "high": high})


def best_splits(keys: np.ndarray, numbers: np.ndarray, slots: int, boost: bool, node_leaf: np.ndarray) -> tuple:
    """Best split of every node from sorted cell keys and their numbers.

    Returns node, candidate, bin (rows of this bin and lower ones go left) and the numbers of both sides; ties go to the
    first candidate and the lowest bin. A side holds at least ``node_leaf[node]`` rows.
    """
    keys, starts = np.unique(keys, return_index=True)
    sums = np.add.reduceat(numbers, starts, axis=0)
    column = keys // (BINS + 1)
    first = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    sizes = np.diff(np.append(first, len(keys)))
    running = np.cumsum(sums, axis=0)
    before = np.where(first[:, None] > 0, running[first - 1], 0.0)
    left = running - np.repeat(before, sizes, axis=0)
    total = np.repeat(running[first + sizes - 1] - before, sizes, axis=0)
    right = total - left
    node = column // slots
    fits = (left[:, -1] >= node_leaf[node]) & (right[:, -1] >= node_leaf[node])
    fits[first + sizes - 1] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        if boost:
            nl, nr = left[:, -1], right[:, -1]
            gain = nl * nr / (nl + nr) * (left[:, 0] / nl - right[:, 0] / nr) ** 2
        else:
            wl, wr, w = (s[:, :-1].sum(axis=1) for s in (left, right, total))
            squares = lambda s: (s[:, :-1] ** 2).sum(axis=1)
            gain = squares(left) / wl + squares(right) / wr - squares(total) / w
            gain = np.where(gain > 1e-12 * w, gain, -np.inf)
    # Gains that differ by the order of summation alone are ties.
    gain = np.where(fits & np.isfinite(gain) & (gain > 0), gain, -np.inf).astype(np.float32)
    # The keys are sorted, so the cells of a node lie together.
    begins = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    most = np.repeat(np.maximum.reduceat(gain, begins), np.diff(np.append(begins, len(gain))))
    top = np.flatnonzero((gain == most) & (gain > -np.inf))
    top = top[np.append(True, node[top][1:] != node[top][:-1])[: len(top)]]
    return node[top], column[top] % slots, keys[top] % (BINS + 1), left[top], right[top]


def by_class(keys: np.ndarray, numbers: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells with a weight per class and their count, from (cell, class) keys with weight and count."""
    cells = keys // classes
    new = np.append(True, cells[1:] != cells[:-1])  # the keys are sorted
    which, n = np.cumsum(new) - 1, int(new.sum())
    sums = np.bincount(which * (classes + 1) + keys % classes, numbers[:, 0], n * (classes + 1)).reshape(n, -1)
    sums[:, -1] = np.bincount(which, numbers[:, 1], n)
    return cells[new], sums


def _splitter(slots: int, classes: int, node_leaf: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """``classes`` is 0 for boosting."""
    boost = classes == 0

    def run(table: pa.Table) -> pa.Table:
        keys, numbers = _parts(table, 3 if boost else 2)
        if not boost:
            keys, numbers = by_class(keys, numbers, classes)
        node, slot, b, left, right = best_splits(keys, numbers, slots, boost, node_leaf)
        sides = np.concatenate([left, right], axis=1)
        return pa.table({"node": node, "slot": slot, "bin": b, "sides": pa.array(list(sides), type=pa.list_(pa.float64()))})

    return run


def _level(rows: DataFrame | Held, gang: Gang, level: int) -> bool:
    """Split the nodes of one level in every tree; False when none is left to split."""
    trees, members = gang.trees, gang.members
    front = _frontier(gang, level)
    if front is None:
        return False
    if gang.kind == "extra":
        _draw_cuts(rows, gang, front, level)
    # Boosted trees have few nodes at a time: a few tasks' sums of them are added up here, more of them in a shuffle.
    direct = gang.kind in ("boost", "ada") and gang.tasks <= DIRECT_TASKS
    direct = direct and len(front.tree) * front.columns.shape[1] * BOOST_BINS * gang.tasks <= DIRECT_CELLS
    node_leaf = np.array([members[k].leaf for k in gang.member_of])[front.tree]
    slots = front.columns.shape[1]
    split = _splitter(slots, 0 if gang.kind == "boost" else gang.classes, node_leaf)
    out = _summed(rows, gang, front, level, False, split, "node long, slot long, bin long, sides array<double>", direct)
    if not out.num_rows:
        return False
    node, slot, b = (out[c].to_numpy() for c in ("node", "slot", "bin"))
    sides = out["sides"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    order = np.argsort(node)
    node, slot, b, sides = node[order], slot[order], b[order], sides[order]
    tree, at, column = front.tree[node], front.node[node], front.columns[node, slot]
    if front.cuts is not None:
        cut = front.cuts[node, slot]
    else:
        folds = np.array([members[k].fold for k in gang.member_of])[tree]
        cut = np.array([gang.edges[f][c][i] for f, c, i in zip(folds.tolist(), column.tolist(), b.tolist(), strict=True)])
    # Children are numbered in the order of their parents, so a depth is the same tree cut short.
    rank = np.arange(len(tree)) - np.repeat(np.flatnonzero(np.append(True, tree[1:] != tree[:-1])), np.unique(tree, return_counts=True)[1])
    left = trees.used[tree] + 2 * rank
    trees.widen(int(left.max()) + 2)
    trees.feature[tree, at], trees.cut[tree, at], trees.child[tree, at] = column, cut, left
    half = gang.width
    trees.value[tree, left], trees.value[tree, left + 1] = sides[:, :half], sides[:, half:]
    np.add.at(trees.used, tree, 2)
    if level == 0:
        trees.value[tree, 0] = sides[:, :half] + sides[:, half:]
    return True


def _frontier(gang: Gang, level: int) -> Frontier | None:
    trees = gang.trees
    depth = np.array([m.depth for m in gang.members])[gang.member_of]
    leaf = np.array([m.leaf for m in gang.members])[gang.member_of]
    open_trees = depth > level
    if gang.alive is not None:
        open_trees &= gang.alive[gang.member_of]
    if level == 0:
        tree, node = np.flatnonzero(open_trees), np.zeros(int(open_trees.sum()), dtype=np.int64)
    else:
        new = np.zeros(trees.feature.shape, dtype=bool)
        new[np.arange(len(new))[:, None], np.arange(new.shape[1])[None, :]] = (
            (np.arange(new.shape[1])[None, :] >= gang.level_start[:, None]) & (np.arange(new.shape[1])[None, :] < trees.used[:, None])
        )
        many = trees.value[:, :, -1] >= 2 * np.maximum(leaf, 1)[:, None]
        pure = (trees.value[:, :, :-1] > 0).sum(axis=2) <= 1 if gang.kind != "boost" else np.zeros(many.shape, dtype=bool)
        tree, node = np.nonzero(new & many & ~pure & open_trees[:, None])
    gang.level_start = trees.used.copy()
    if not len(tree):
        return None
    own = gang.member_of[tree]
    counts = np.array([m.per_node or len(m.columns) for m in gang.members])
    slots = int(counts[own].max())
    columns, drawn = np.zeros((2, len(tree), slots), dtype=np.int64)
    for k in np.unique(own):
        m, mine = gang.members[k], own == k
        names = np.array(m.columns)
        if m.per_node and m.per_node < len(names):
            local = tree[mine] - gang.first[k] + m.first
            u = uniform(m.seed + 1, local[:, None], node[mine][:, None], np.arange(len(names))[None, :])
            picked = np.sort(np.argsort(u, axis=1, kind="stable")[:, : m.per_node], axis=1)
        else:
            picked = np.repeat(np.arange(len(names))[None, :], int(mine.sum()), axis=0)
        # Members with fewer candidates repeat their last one, which can win nothing.
        picked = np.concatenate([picked, np.repeat(picked[:, -1:], slots - picked.shape[1], axis=1)], axis=1)
        columns[mine], drawn[mine] = names[picked], picked
    place = np.full(trees.feature.shape, -1, dtype=np.int32)
    place[tree, node] = np.arange(len(tree))
    return Frontier(tree, node, columns, drawn, place)


def _summed(rows: DataFrame | Held, gang: Gang, front: Frontier, level: int, ranges: bool, finish: Callable, schema: str, direct: bool) -> pa.Table:
    """What ``finish`` makes of the cells of all rows, by blocks of trees; at once where ``direct`` or the rows are held."""
    if isinstance(rows, Held):
        sent = list(_cells(gang, front, level, ranges)(rows))
        return finish(pa.Table.from_batches(sent)) if sent else pa.table({})
    shared = rows.sparkSession.sparkContext.broadcast((gang.for_growth(), front))

    def cells(data):
        yield from _cells(*shared.value, level, ranges)(data)

    sums = rows.mapInArrow(cells, "block long, keys binary, numbers binary")
    if direct:
        partial = sums.toArrow()
        out = finish(partial) if partial.num_rows else partial
    else:
        out = sums.groupBy("block").applyInArrow(finish, schema).toArrow()
    shared.destroy()
    return out


def _draw_cuts(rows: DataFrame | Held, gang: Gang, front: Frontier, level: int) -> None:
    """Cuts drawn evenly between the smallest and the largest value that a candidate column has in the node."""
    out = _summed(rows, gang, front, level, True, _ranges, "key long, low double, high double", False)
    slots = front.columns.shape[1]
    low, high = np.zeros(front.columns.shape), np.zeros(front.columns.shape)
    key = out["key"].to_numpy() if out.num_rows else np.zeros(0, dtype=np.int64)
    low[key // slots, key % slots], high[key // slots, key % slots] = (out["low"].to_numpy(), out["high"].to_numpy()) if len(key) else (0.0, 0.0)
    own = gang.member_of[front.tree]
    seeds = np.array([m.seed for m in gang.members])[own]
    local = front.tree - gang.first[own] + np.array([m.first for m in gang.members])[own]
    u = uniform((seeds + 2)[:, None], local[:, None], front.node[:, None], front.drawn)
    cut = low + u * (high - low)
    front.cuts = np.where(cut < high, cut, low)  # rounding must not send every row left


def bin_edges(rows: DataFrame, width: int, bins: int = BINS) -> dict[int, list[np.ndarray]]:
    """Per fold the cuts of every column: middles between neighbouring quantiles, at most ``bins`` of them."""
    shares = [float(s) for s in np.linspace(0, 1, bins + 1)]
    picked = [F.percentile_approx(F.col("x")[j], shares, 10_000).alias(f"q{j}") for j in range(width)]
    out = {}
    for r in rows.groupBy("fold").agg(*picked).collect():
        points = [np.unique(r[f"q{j}"]) for j in range(width)]
        out[r["fold"]] = [(p[1:] + p[:-1]) / 2 for p in points]
    return out


def class_shares(rows: DataFrame | Held, classes: int, amount: Column | None = None) -> dict[int, np.ndarray]:
    """Share of every class per fold, by rows or by an ``amount``, which is their weights where the rows are held."""
    out: dict[int, np.ndarray] = {}
    if isinstance(rows, Held):
        for fold, _, label, weight, _ in rows.parts:
            out[fold] = out.get(fold, 0) + np.bincount(label, None if amount is None else weight, classes)
        return {f: n / n.sum() for f, n in out.items()}
    for r in rows.groupBy("fold", "label").agg((F.count("*") if amount is None else amount).alias("n")).collect():
        out.setdefault(r["fold"], np.zeros(classes))[r["label"]] = r["n"]
    return {f: n / n.sum() for f, n in out.items()}


def bins_of(kind: str) -> int:
    return BINS if kind == "forest" else BOOST_BINS


def grow(rows: DataFrame | Held, members: Sequence[Member], classes: int, edges: dict | None = None) -> Gang:
    """Grow members of one kind together. ``rows`` has the columns of ``ROW_SCHEMA`` and is best kept in memory.

    Rows that a task holds come with the ``edges`` of their folds; what is kept of them belongs to one call."""
    if isinstance(rows, Held):
        rows = Held(rows.parts)
    width = max(c for m in members for c in m.columns) + 1
    needs = members[0].kind != "extra"
    gang = Gang(members, classes, (edges or bin_edges(rows, width, bins_of(members[0].kind))) if needs else {}, class_shares(rows, classes))
    gang.weighted = class_shares(rows, classes, 1 if isinstance(rows, Held) else F.sum("weight"))
    gang.tasks = 1 if isinstance(rows, Held) else rows.rdd.getNumPartitions()
    if gang.kind in ("forest", "extra"):
        level = 0
        while _level(rows, gang, level):
            level += 1
        # A root without a split got no sums: it votes by the classes' shares.
        for k, m in enumerate(members):
            mine = np.arange(gang.first[k], gang.first[k + 1])
            alone = mine[gang.trees.feature[mine, 0] < 0]
            gang.trees.value[alone, 0, :-1] = gang.weighted[m.fold] if m.weighted else gang.priors[m.fold]
        return gang
    rounds = max(m.trees for m in members)
    gang.alive = np.ones(len(members), dtype=bool)
    gang.alphas = np.zeros((0, len(members)))
    for t in range(rounds):
        gang.alive &= np.array([m.trees > t for m in members])
        if not gang.alive.any():
            break
        gang.fresh()
        level = 0
        while _level(rows, gang, level):
            level += 1
        _close_round(gang)
    return gang


def _close_round(gang: Gang) -> None:
    """Turn the sums of a round's leaves into what they add to a score."""
    trees = gang.trees
    if gang.kind == "boost":
        g, h = trees.value[:, :, 0], trees.value[:, :, 1]
        trees.value = np.where(np.abs(h) > 1e-150, g / np.where(h == 0, 1, h), 0.0)[:, :, None]
        gang.close(trees)
        return
    k = gang.classes
    alphas = np.zeros(len(gang.members))
    for i, m in enumerate(gang.members):
        if not gang.alive[i]:
            continue
        leaves = trees.value[i, 1:3, :-1] if trees.feature[i, 0] >= 0 else trees.value[i, :1, :-1]
        total = leaves.sum()
        err = 1 - leaves.max(axis=1).sum() / total if total > 0 else 1.0
        if err <= 1e-15:
            alphas[i], gang.alive[i] = 1.0, False
        elif err >= 1 - 1 / k:
            gang.alive[i] = False
        else:
            alphas[i] = m.rate * (np.log((1 - err) / err) + np.log(k - 1))
    gang.alphas = np.vstack([gang.alphas, alphas])
    gang.close(trees)


def probabilities(gang: Gang, k: int, x: np.ndarray, trees: int | None = None, depth: int | None = None) -> np.ndarray:
    """Class probabilities (row, class) of a member with its first trees or rounds and down to a depth."""
    m = gang.members[k]
    if gang.kind == "boost":
        f = gang.margins(k, x, trees)
        if gang.classes == 2:
            p = 1 / (1 + np.exp(-f[0]))
            return np.stack([1 - p, p], axis=1)
        p = np.exp(f - f.max(axis=0))
        return (p / p.sum(axis=0)).T
    if gang.kind == "ada":
        c = gang.classes
        votes, total = gang.votes(k, x, trees), gang.alphas[:trees, k].sum()
        if total <= 0:
            return np.repeat(gang.priors[m.fold][None, :], len(x), axis=0)
        score = (votes - (total - votes) / (c - 1)) / total
        score = score * (2 if c == 2 else 1) / (1 if c == 2 else c - 1)
        if c == 2:
            p = 1 / (1 + np.exp(-score[1]))
            return np.stack([1 - p, p], axis=1)
        p = np.exp(score - score.max(axis=0))
        return (p / p.sum(axis=0)).T
    part = gang.trees.take(slice(gang.first[k], gang.first[k] + (trees or m.trees)))
    out = np.zeros((len(x), gang.classes))
    shares = part.value[:, :, :-1]
    shares = (shares / np.maximum(shares.sum(axis=2, keepdims=True), 1e-300)).reshape(-1, gang.classes)
    first = np.arange(len(part.feature))[:, None] * part.feature.shape[1]
    step = max(1, CACHED_CELLS // len(part.feature))
    for a in range(0, len(x), step):
        at = part.route(slice(None), x[a : a + step], m.depth if depth is None else depth)
        out[a : a + step] = shares.take(at + first, axis=0).mean(axis=0)
    return out
