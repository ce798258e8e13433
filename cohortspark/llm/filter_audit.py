"""How filters of a corpus interact: what each removes in every order of application.

Every document gets a mask of the filters it fails; only counts of masks per part are kept. Per part a decision diagram
with counts is built: a level for each filter, a child for passing and one for failing, equal subgraphs shared, every node
with the sum of the documents below it. Adjacent levels are swapped until every order of the filters has been on top
once; in each order the path on which all filters pass yields the steps: the weight of its nodes is what is kept, the weight
of their failing children what is removed.

Nothing but counts is shuffled: a part has at most 2^k masks, so a diagram has a bounded size however large the part is.
``failing_repeat`` marks copies without collecting a group: a text's rows are counted per smallest id first.

Defined results: a null part is the empty string. Repeated rows count each. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Counts = tuple[int, ...]
NOTHING = -1  # the shared empty subgraph


class Diagram:
    """Counts of failure masks as an ordered diagram over ``order``, the top level first.

    A node is (passing child, failing child); a leaf is a tuple of counts. Levels are never skipped, since a skipped level
    would lose which half its documents belong to; subgraphs without documents are one shared node.
    """

    def __init__(self, order: Sequence[str], masks: dict[int, Counts], width: int) -> None:
        self.order = list(order)
        self.zero = (0,) * width
        self.nodes: list[tuple] = []
        self.weights: list[Counts] = []
        self.known: dict[tuple, int] = {}
        self.top = self.build(masks, 0)

    def build(self, masks: dict[int, Counts], level: int) -> int:
        """``masks`` has bit k for the filter of level k."""
        if not masks:
            return NOTHING
        if level == len(self.order):
            return self.node(("leaf", masks[0]), masks[0])
        fails = {m >> 1: n for m, n in masks.items() if m & 1}
        passes = {m >> 1: n for m, n in masks.items() if not m & 1}
        return self.inner(self.build(passes, level + 1), self.build(fails, level + 1))

    def node(self, key: tuple, weight: Counts) -> int:
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append(key)
            self.weights.append(weight)
        return self.known[key]

    def inner(self, passes: int, fails: int) -> int:
        if passes == fails == NOTHING:
            return NOTHING
        weight = tuple(a + b for a, b in zip(self.weight(passes), self.weight(fails), strict=True))
        return self.node((passes, fails), weight)

    def weight(self, node: int) -> Counts:
        return self.zero if node == NOTHING else self.weights[node]

    def children(self, node: int) -> tuple[int, int]:
        return (NOTHING, NOTHING) if node == NOTHING else self.nodes[node]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the one below it; nodes of the levels further down stay as they are."""
        seen: dict[tuple[int, int], int] = {}

        def rebuilt(node: int, depth: int) -> int:
            if node == NOTHING:
                return NOTHING
            if (node, depth) not in seen:
                passes, fails = self.children(node)
                if depth < level:
                    made = self.inner(rebuilt(passes, depth + 1), rebuilt(fails, depth + 1))
                else:
                    (pp, pf), (fp, ff) = self.children(passes), self.children(fails)
                    made = self.inner(self.inner(pp, fp), self.inner(pf, ff))
                seen[node, depth] = made
            return seen[node, depth]

        self.top = rebuilt(self.top, 0)
        self.order[level : level + 2] = self.order[level + 1], self.order[level]

    def all_pass(self) -> Iterator[tuple[str, Counts, Counts]]:
        """(filter, kept, removed) of every step of the order."""
        node = self.top
        for name in self.order:
            node, fails = self.children(node)
            yield name, self.weight(node), self.weight(fails)

    def failing(self) -> dict[str, tuple[Counts, Counts]]:
        """For each filter what fails it and what fails it only."""
        out, passing = {}, self.top
        for depth, name in enumerate(self.order):
            fails = self.children(passing)[1]
            only = fails
            for _ in self.order[depth + 1 :]:
                only = self.children(only)[0]
            out[name] = (self.total(depth), self.weight(only))
            passing = self.children(passing)[0]
        return out

    def total(self, depth: int) -> Counts:
        """Weight of the failing children of all nodes at ``depth``, each as often as paths reach it."""
        reached = {self.top: 1}
        for _ in range(depth):
            below: dict[int, int] = {}
            for node, times in reached.items():
                for child in self.children(node):
                    below[child] = below.get(child, 0) + times
            reached = below
        sums = list(self.zero)
        for node, times in reached.items():
            for k, n in enumerate(self.weight(self.children(node)[1])):
                sums[k] += times * n
        return tuple(sums)


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places of the swaps that lead from one order of n things through all others, each once (plain changes)."""
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        place = next(inner, None)
        if place is None:
            return
        yield place + (1 if down else 0)  # the largest thing stands at the front after a way down
        down = not down


def audit_part(names: Sequence[str], masks: dict[int, Counts], width: int) -> Iterator[tuple]:
    """Rows (order, step, kept, removed, redundant, unique_fails, shapley), kept and removed as tuples of all counts."""
    diagram = Diagram(names, masks, width)
    failing = diagram.failing()
    rows, shapley = [], dict.fromkeys(names, 0)
    for place in (None, *adjacent_swaps(len(names))):
        if place is not None:
            diagram.swap(place)
        order = "".join(diagram.order)
        for step, (name, kept, removed) in enumerate(diagram.all_pass(), 1):
            shapley[name] += removed[0]
            rows.append((order, step, name, kept, removed))
    for order, step, name, kept, removed in rows:
        fails, only = failing[name]
        yield order, step, kept, removed, fails[0] - removed[0], only[0], shapley[name]


def audit(counts: DataFrame, names: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """Steps of every order of the filters in every part.

    ``counts`` has part (string), mask (int, bit k: fails ``names[k]``), n and the further counts ``also`` (long); equal
    masks of a part are added up. ``names`` are single characters. Returns part, filter_order, step, kept, removed,
    redundant, unique_fails, ``<also>_lost`` for each further count, and shapley.
    """
    columns = ["n", *also]
    slim = counts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in columns])
    lost = [f"{c}_lost" for c in also]
    longs = ["kept", "removed", "redundant", "unique_fails", *lost, "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs)

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        values = zip(*(table[c].to_pylist() for c in columns), strict=True)
        masks = dict(zip(table["mask"].to_pylist(), values, strict=True))
        rows = [
            (part, order, step, kept[0], removed[0], redundant, only, *removed[1:], shapley)
            for order, step, kept, removed, redundant, only, shapley in audit_part(names, masks, len(columns))
        ]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(longs)]
        data = [pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.Table.from_arrays(data, names=["part", "filter_order", "step", *longs])

    return slim.groupBy("part").applyInArrow(run, schema)


def mask_of(failures: Sequence[Column]) -> Column:
    """Bit k is set where ``failures[k]`` holds; a null condition does not fail."""
    bits = [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failures)]
    return sum(bits[1:], bits[0]).cast("int")


def failing_repeat(rows: DataFrame, bit: int, also: Sequence[str] = ()) -> DataFrame:
    """Counts (part, mask, n, ``also``) in which a row whose text also has a smaller id fails the filter of ``bit``.

    ``rows`` has digest, doc_id, part, mask and the counts ``also``. A row without an id has no smaller one and is no smaller
    one. Rows of one id and text are counted first, then a text's rows per part with those of its smallest id apart, so
    no group of copies meets in one task; a text has as many rows as parts in the last step, where ids of parts are compared.
    """
    columns = ["n", *also]
    known = F.col("doc_id").isNotNull()
    single = rows.withColumn("n", F.lit(1).cast("long")).groupBy("digest", "part", "mask", "doc_id")
    single = single.agg(*[F.sum(c).alias(c) for c in columns])
    first = F.min(F.when(known, F.struct("doc_id", *columns)))
    keys = ["digest", "part", "mask"]
    per_part = single.groupBy(*keys).agg(
        first.alias("first"),
        *[F.sum(F.when(~known, F.col(c)).otherwise(0)).alias(f"{c}_unknown") for c in columns],
        *[F.sum(c).alias(c) for c in columns],
    )
    spared = F.coalesce(F.col("first.doc_id") == F.col("least"), F.lit(False))
    placed = per_part.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    spare = [(F.when(spared, F.col(f"first.{c}")).otherwise(0) + F.col(f"{c}_unknown")).alias(c) for c in columns]
    both = placed.select(
        "part",
        F.explode(
            F.array(
                F.struct("mask", *spare),
                F.struct(
                    F.col("mask").bitwiseOR(1 << bit).alias("mask"),
                    *[(F.col(c) - s).alias(c) for c, s in zip(columns, spare, strict=True)],
                ),
            )
        ).alias("x"),
    )
    return both.select("part", "x.*").where(F.col("n") > 0).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in columns])
