"""Models fitted in shared passes, against plain versions of one model on one table."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector

from cohortspark.ml import descent, gang, grove, selection, together, zoo
from cohortspark.ml.classifiers import AdaBoost, ExtraTrees, Perceptron, RBFClassifier
from cohortspark.ml.selection import Recipe


def made(n=150, d=3, classes=2, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    y = np.digitize(x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=n), [0.3, 1.0][: classes - 1])
    return x, y


def table(spark, tables, parts=3):
    rows = [(f, i, int(b), 1.0 + i % 3, a.tolist()) for f, (x, y) in tables.items() for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, gang.ROW_SCHEMA).repartition(parts)


def gini_best(x, y, w, classes, leaf):
    """Largest gain over all cuts of all columns."""
    best = (-1, None, None)
    square = lambda m: sum(w[m & (y == c)].sum() ** 2 for c in range(classes)) / w[m].sum()
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= leaf:
                gain = square(left) + square(~left) - square(np.ones(len(y), dtype=bool))
                if gain > best[0] + 1e-9:
                    best = (gain, j, cut)
    return best


def test_numbers_drawn_depend_on_their_keys_alone():
    u = gang.uniform(3, np.arange(50)[:, None], np.arange(2000)[None, :])
    assert np.array_equal(u[7:9, 5:8], gang.uniform(3, np.arange(7, 9)[:, None], np.arange(5, 8)[None, :]))
    assert abs(u.mean() - 0.5) < 0.005 and (0 <= u).all() and (u < 1).all()
    assert abs(np.corrcoef(u[0], u[1])[0, 1]) < 0.08


def test_one_tree_takes_the_best_cuts(spark):
    tables = {0: made(), 5: made(seed=1)}
    members = [gang.Member(f, (0, 1, 2), depth=2, leaf=4, weighted=True) for f in tables]
    grown = gang.grow(table(spark, tables), members, 2)
    for k, (x, y) in enumerate(tables.values()):
        w = 1.0 + np.arange(len(y)) % 3
        todo = [(0, np.ones(len(y), dtype=bool))]
        for node, mine in todo:
            gain, column, cut = gini_best(x[mine], y[mine], w[mine], 2, 4)
            have = grown.trees.feature[k, node]
            assert (have, grown.trees.cut[k, node]) == (column, pytest.approx(cut))
            left = mine & (x[:, column] <= cut)
            if node == 0:
                child = grown.trees.child[k, node]
                todo += [(child, left), (child + 1, mine & ~left)]
        p = gang.probabilities(grown, k, x)
        assert np.allclose(p.sum(axis=1), 1)


def test_smaller_forests_and_shallower_trees_are_parts(spark):
    rows = table(spark, {0: made(classes=3)})
    for kind in ("forest", "extra"):
        most = dict(kind=kind, leaf=2, per_node=2, bootstrap=kind == "forest")
        big = gang.grow(rows, [gang.Member(0, (0, 1, 2), trees=9, depth=6, **most)], 3)
        small = gang.grow(rows, [gang.Member(0, (0, 1, 2), trees=4, depth=3, **most)], 3)
        x, _ = made(seed=4)
        assert np.allclose(gang.probabilities(big, 0, x, 4, 3), gang.probabilities(small, 0, x))


def test_models_do_not_depend_on_their_company_or_the_partitions(spark):
    tables = {0: made(), 1: made(seed=2)}
    for kind, own in (("forest", {"trees": 5, "bootstrap": True}), ("extra", {"trees": 5}), ("boost", {"trees": 4, "depth": 2, "subsample": 0.7}), ("ada", {"trees": 6, "depth": 1})):
        member = gang.Member(1, (0, 2), kind, **{"depth": 4, **own})
        alone = gang.grow(table(spark, {1: tables[1]}, 1), [member], 2)
        both = gang.grow(table(spark, tables, 4), [gang.Member(0, (0, 1), kind, **{"depth": 3, **own} if kind != "ada" else own), member], 2)
        x = tables[0][0]
        assert np.allclose(gang.probabilities(alone, 0, x), gang.probabilities(both, 1, x)), kind


def test_drawn_cuts_lie_inside_their_nodes(spark):
    x, y = made(300)
    grown = gang.grow(table(spark, {0: (x, y)}), [gang.Member(0, (0, 1, 2), "extra", 20, 5, per_node=1)], 2)
    trees = grown.trees
    cuts = set()
    for t in range(20):
        nodes = {0: np.ones(len(x), dtype=bool)}
        for depth in range(5):
            at = trees.route(slice(t, t + 1), x, depth)[0]
            for node in np.unique(at):
                f = trees.feature[t, node]
                if f >= 0:
                    values = x[at == node, f]
                    assert values.min() <= trees.cut[t, node] < values.max()
                    cuts.add(trees.cut[t, node])
        del nodes
    assert len(cuts) > 100  # drawn, not taken from a common list of cuts


def plain_boost(x, y, rounds, depth, rate, leaf):
    prior = np.log(y.mean() / (1 - y.mean()))
    f = np.full(len(y), prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = (y == 1) - p, p * (1 - p)

        def grow(mine, left_depth):
            best = (1e-12, None, None)
            for j in range(x.shape[1]) if left_depth else ():
                values = np.unique(x[mine, j])
                for cut in (values[1:] + values[:-1]) / 2:
                    a, b = mine & (x[:, j] <= cut), mine & (x[:, j] > cut)
                    if min(a.sum(), b.sum()) >= leaf:
                        gain = a.sum() * b.sum() / mine.sum() * (g[a].mean() - g[b].mean()) ** 2
                        if gain > best[0] + 1e-12:
                            best = (gain, j, cut)
            if best[1] is None:
                f[mine] += rate * g[mine].sum() / h[mine].sum()
            else:
                for side in (x[:, best[1]] <= best[2], x[:, best[1]] > best[2]):
                    grow(mine & side, left_depth - 1)

        grow(np.ones(len(y), dtype=bool), depth)
    return 1 / (1 + np.exp(-f))


def test_boosting_rounds_as_the_plain_version(spark):
    x, y = made(60, 2)
    grown = gang.grow(table(spark, {0: (x, y)}), [gang.Member(0, (0, 1), "boost", 5, 2, 3, rate=0.3)], 2)
    for rounds in (1, 3, 5):
        assert np.allclose(gang.probabilities(grown, 0, x, rounds)[:, 1], plain_boost(x, y, rounds, 2, 0.3, 3))


def test_boosting_of_three_classes_learns(spark):
    x, y = made(300, 3, 3)
    grown = gang.grow(table(spark, {0: (x, y)}), [gang.Member(0, (0, 1, 2), "boost", 15, 3, rate=0.3)], 3)
    assert (gang.probabilities(grown, 0, x).argmax(axis=1) == y).mean() > 0.9


def test_ada_rounds_as_the_plain_version(spark):
    x, y = made(60, 2)
    grown = gang.grow(table(spark, {0: (x, y)}), [gang.Member(0, (0, 1), "ada", 4, 1, rate=0.5)], 2)
    w = np.ones(len(y))
    for t in range(4):
        _, j, cut = gini_best(x, y, w, 2, 1)
        left = x[:, j] <= cut
        guess = np.where(left, w[left & (y == 1)].sum() > w[left & (y == 0)].sum(), w[~left & (y == 1)].sum() > w[~left & (y == 0)].sum())
        err = w[guess != y].sum() / w.sum()
        alpha = 0.5 * np.log((1 - err) / err)
        assert grown.alphas[t, 0] == pytest.approx(alpha)
        w = w * np.exp(alpha * (guess != y))


NETS = [
    descent.Net(0, (0, 1, 2), 2, penalty=0.7, weighted=True),
    descent.Net(0, (0, 2), 3, penalty=0.7),
    descent.Net(0, (0, 1, 2), 3, (5, 4), 0.3),
    descent.Net(0, (0, 1, 2), 2, (4,), 0.3),
    descent.Net(0, (0, 1), 2, loss="hinge", lift=descent.Fourier(0.5, 7), target=1),
]


@pytest.mark.parametrize("net", NETS)
def test_gradients(net):
    x, y = made(40, 3, net.classes)
    rng = np.random.default_rng(1)
    theta, w = net.start() + 0.1 * rng.normal(size=len(net.start())), rng.uniform(0.5, 2, 40)
    value = lambda t: net.penalised(t, *net.loss_and_gradient(t, net.inputs(x), y, w))
    gradient = value(theta)[1]
    for k in range(len(theta)):
        step = np.zeros(len(theta))
        step[k] = 1e-6
        assert gradient[k] == pytest.approx((value(theta + step)[0] - value(theta - step)[0]) / 2e-6, abs=2e-4)


def test_smooth_models_end_where_the_gradient_vanishes(spark):
    x, y = made(120, 3, 3)
    rows = table(spark, {0: (x, y), 1: (x, (y > 0).astype(int))})
    nets = [descent.Net(0, (0, 1, 2), 3), descent.Net(1, (0, 1, 2), 2, penalty=0.1)]
    ends = descent.minimise(rows, nets, tolerance=1e-3)
    for net, theta in zip(nets, ends, strict=True):
        label = y if net.classes == 3 else (y > 0).astype(int)
        _, gradient = net.penalised(theta, *net.loss_and_gradient(theta, net.inputs(x), label, np.ones(len(y))))
        assert np.abs(gradient).max() < 1e-2


def test_few_numbers_of_many_tasks_are_added_without_a_shuffle(spark, monkeypatch):
    x, y = made(120)
    net = descent.Net(0, (0, 1, 2), 2, (4,))
    theta = net.start()
    rows = table(spark, {0: (x, y)}, 6)
    monkeypatch.setattr(descent, "DIRECT_TASKS", 2)
    shuffled, by = [], type(rows).groupBy

    def counted(self, *cols):
        shuffled.append(cols)
        return by(self, *cols)

    monkeypatch.setattr(type(rows), "groupBy", counted)
    (few,) = descent._sums(rows, [net], {0: theta}, 6).values()
    assert not shuffled
    monkeypatch.setattr(descent, "DIRECT_CELLS", 6 * len(theta) - 1)
    (many,) = descent._sums(rows, [net], {0: theta}, 6).values()
    assert shuffled
    want = net.loss_and_gradient(theta, net.inputs(x), y, np.ones(len(y)))
    for found in (few, many):
        assert np.isclose(found[0], want[0]) and np.allclose(found[1], want[1])


def test_perceptron_settles(monkeypatch):
    """The end may lie on a kink of a rectified unit, where the gradient is no zero but no step along it gains much."""
    x, y = made(120)
    net = descent.Net(0, (0, 1, 2), 2, (4,), 1.0, max_iter=2000)
    value = lambda theta: net.loss_and_gradient(theta, net.inputs(x), y, np.ones(len(y)))
    monkeypatch.setattr(descent, "_sums", lambda rows, nets, at, *_: {k: value(t) for k, t in at.items()})

    class Rows:
        class rdd:  # noqa: N801
            getNumPartitions = staticmethod(lambda: 1)

    (theta,) = descent.minimise(Rows, [net], tolerance=1e-3)
    loss, gradient = net.penalised(theta, *value(theta))
    for step in 10.0 ** -np.arange(1, 8):
        there = theta - step * gradient
        assert net.penalised(there, *value(there))[0] > loss * (1 - 1e-3)
    assert loss < 0.6 * net.penalised(net.start(), *value(net.start()))[0]


def test_machine_separates_a_ring(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = ((x**2).sum(axis=1) > 1.4).astype(int)
    net = descent.Net(0, (0, 1), 2, penalty=0.1, loss="hinge", lift=descent.Fourier(0.5), target=1)
    (machine,) = descent.machines(table(spark, {0: (x, y)}), [net])
    chance = machine.chance(x)
    assert ((chance > 0.5) == y).mean() > 0.93 and abs(chance.mean() - y.mean()) < 0.05


def test_curves_pass_over_margins_and_not_over_lifted_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    net = descent.Net(0, (0, 1, 2), 2, loss="hinge", lift=descent.Fourier(0.5, 9), target=1, max_iter=5)
    widths, minimise = [], descent.minimise
    monkeypatch.setattr(descent, "minimise", lambda rows, *rest: (widths.append(len(rows.first()["x"])), minimise(rows, *rest))[1])
    descent.machines(table(spark, {0: (x, (x[:, 0] > 0).astype(int))}), [net])
    assert widths == [3, 1]


def test_a_task_sends_its_cells_once():
    x, y = made(40)
    grown = gang.Gang([gang.Member(0, (0, 1, 2), "extra", 2, 3)], 2, {}, {})
    front = gang._frontier(grown, 0)
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64()]
    values = [np.zeros(40), np.arange(40), y, np.ones(40)]
    columns = [pa.array(v).cast(t) for v, t in zip(values, kinds, strict=True)]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array(x.tolist())], names=["fold", "rid", "label", "weight", "x"])
    sent = list(gang._cells(grown, front, 0, True)([batch, batch]))
    assert len(sent) == 1
    found = gang._ranges(pa.Table.from_batches(sent)).to_pydict()
    assert found["low"] == [*x.min(axis=0)] * 2 and found["high"] == [*x.max(axis=0)] * 2


@pytest.mark.parametrize(
    "estimator", [AdaBoost(rounds=3), ExtraTrees(trees=5), Perceptron(hidden=[3], maxIter=20), RBFClassifier(size=16)]
)
def test_estimators_save_and_score_alike(spark, estimator, tmp_path):
    x, y = made(80)
    df = spark.createDataFrame([(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "sample_id long, label int, v array<double>")
    df = df.withColumn("features", array_to_vector("v"))
    model = estimator.fit(df)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = type(model).load(str(tmp_path / "model"))
    first = model.transform(df).orderBy("sample_id").select("probability", "prediction").collect()
    assert first == again.transform(df).orderBy("sample_id").select("probability", "prediction").collect()
    assert np.mean([r.prediction == b for r, b in zip(first, y, strict=True)]) > 0.7


def test_f1_of_counts():
    assert together.f1(np.array([[3, 1], [2, 4]]), True) == pytest.approx(8 / 11)
    assert together.f1(np.array([[3, 0, 0], [1, 0, 0], [0, 0, 0]]), False) == pytest.approx((6 / 7) / 2)
    assert together.f1(np.zeros((2, 2)), True) == 0


def test_search_scores_every_point_by_models_of_its_own_fold(spark):
    """A grid in shared passes gives what one fit per fold and point gives."""
    x, y = made(90, 3)
    df = spark.createDataFrame([(i, int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "sample_id long, label int, a double, b double, c double")
    recipe = Recipe(features=["a", "b", "c"], classes=["n", "p"], ratios=None, impute=False, select_k="all")
    entry = zoo.binary_models()["ExtraTrees"]
    entry.grid = {"trees": [3, 6], "depth": [None, 3]}
    with selection.shared_folds():
        grid, means = selection.grid_scores(recipe, df, entry, [2, "all"], folds=3, repeats=1)
        with selection._folds_for(recipe, df, 3, 1) as folded:
            for params, mean in zip(grid, means, strict=True):
                alone = [selection._alone(recipe, folded, entry, params, f) for f in range(3)]
                assert mean == pytest.approx(np.mean(alone))
    assert len(grid) == 8


def test_models_in_tasks_score_as_in_passes(spark, monkeypatch):
    """Folds that fit a task are fitted there, without a pass over the table, and score alike."""
    x, y = made(120, 3, classes=3)
    rows = [(i, int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "sample_id long, label int, a double, b double, c double")
    recipe = Recipe(features=["a", "b", "c"], classes=["l", "m", "n"], ratios=None, impute=False, select_k="all")
    points = {
        "RandomForest": [{"trees": 7, "depth": 4}, {"trees": 4, "depth": None}],
        "ExtraTrees": [{"trees": 7, "depth": None}],
        "GradientBoosting": [{"rounds": 5, "depth": 2}],
        "AdaBoost": [{"rounds": 6}],
        "LogisticRegression": [{"C": 1.0}],
        "SVC_RBF": [{"size": 16}],
    }
    models, passes = zoo.multiclass_models(), []
    level, sums = gang._level, descent._sums
    monkeypatch.setattr(gang, "_level", lambda *a: (passes.append("level"), level(*a))[1])
    monkeypatch.setattr(descent, "_sums", lambda *a: (passes.append("sums"), sums(*a))[1])
    monkeypatch.setattr(together, "HELD_NUMBERS", 2000)  # forests in several parts
    with selection.shared_folds(), selection._folds_for(recipe, df, 2, 2) as folded:
        for name, some in points.items():
            group = {i: (models[name], p) for i, p in enumerate(some)}
            monkeypatch.setattr(together, "HELD_CELLS", 1 << 22)
            monkeypatch.setattr(together, "HELD_INPUTS", 1 << 24)
            passes.clear()
            in_tasks = selection._together(recipe, folded, group, range(5))
            assert not passes, name
            monkeypatch.setattr(together, "HELD_CELLS", 0)
            monkeypatch.setattr(together, "HELD_INPUTS", 0)
            assert in_tasks == pytest.approx(selection._together(recipe, folded, group, range(5))), name
            assert passes and len(in_tasks) == 5 * len(some)


@pytest.mark.parametrize("mode", ["knn", "median"])
def test_folds_are_prepared_together_as_one_by_one(spark, monkeypatch, mode):
    rng = np.random.default_rng(3)
    rows = [
        (f"s{i}", i % 3 == 0, *[None if u < 0.2 else round(float(v), 1) for u, v in zip(rng.random(3), rng.normal(size=3) + i % 2, strict=True)])
        for i in range(90)
    ]
    df = spark.createDataFrame(rows + rows[:9], "sample_id string, case boolean, a double, b double, c double").selectExpr("*", "int(case) AS label")
    recipe = Recipe(features=["a", "b", "c"], classes=["n", "p"], ratios=None, clip_cols=None, impute_mode=mode, select_k="all")
    one_by_one = selection.prepared
    with monkeypatch.context() as m:
        m.setattr(selection, "prepared", None)
        folded = selection._folded(recipe, df, 3, 2)
    assert folded.whole == 6 and folded.width == 3
    flat = lambda got: sorted((r[0], r[1], None if r[2] is None else round(r[2], 9), *[round(v, 6) for v in r[3]]) for r in got)
    with selection._fold_tables(recipe, df, 3, 2) as parts:
        for f, (inside, outside) in enumerate([*parts[:4], (df, None)]):
            f = f if outside is not None else folded.whole
            with one_by_one(recipe, inside, outside, temporary=True) as done:
                for part, held in ((done.train, False), (done.test, True)):
                    if part is None:
                        continue
                    weight = "weight" if not held else "1.0 AS weight"
                    want = part.selectExpr("sample_id", "label", weight, "scaled").collect()
                    have = folded.rows.where(f"fold = {f} AND held = {held}").select("id", "label", "weight", "x").collect()
                    assert flat(have) == flat(want), (f, held)
    folded.close()


def test_machines_over_held_rows_read_their_inputs_together(monkeypatch):
    x, y = made(60)
    lift = descent.Fourier(0.5, 12)
    nets = [descent.Net(0, (0, 2), 2, loss="hinge", weighted=p == 1, lift=lift, without=p, target=1) for p in (-1, 0, 1)]
    rid, weight = np.arange(60), 1.0 + np.arange(60) % 3
    thetas = {k: np.random.default_rng(k).normal(size=13) for k in range(3)}
    alone = [
        net.loss_and_gradient(thetas[k], net.inputs(x), y, (weight if net.weighted else 1.0) * (descent.part_of(rid, net.seed) != net.without))
        for k, net in enumerate(nets)
    ]
    monkeypatch.setattr(descent.Net, "loss_and_gradient", None)
    found = descent._sums(gang.Held([(0, rid, y, weight, x)]), nets, thetas, 1)
    for k, (loss, gradient) in enumerate(alone):
        assert found[k][0] == pytest.approx(loss) and np.allclose(found[k][1], gradient)


@pytest.mark.parametrize("classes", [2, 4])
def test_trees_of_held_rows_split_as_those_of_the_passes(classes, monkeypatch):
    """Rows in hand are counted where nodes are few and sorted where they are many; both split as the passes do."""
    x, y = made(1500, 4, 3)
    y = y + (np.arange(1500) % 7 == 0) if classes == 4 else np.minimum(y, 1)
    rid, weight = np.arange(1500) * 7919, np.linspace(0.5, 2, classes)[y]
    held = gang.Held([(3, rid, y, weight, x)])
    edges = [(u[1:] + u[:-1]) / 2 for u in (np.unique(np.quantile(c, np.linspace(0, 1, 60), method="nearest")) for c in x.T)]
    calls = []
    for name in ("_counted", "_sorted"):
        own = getattr(grove._Level, name)
        monkeypatch.setattr(grove._Level, name, lambda *a, own=own, name=name: (calls.append(name), own(*a))[1])
    kinds = {
        "forest": {"trees": 7, "depth": 30, "per_node": 2, "bootstrap": True, "weighted": True},
        "extra": {"trees": 7, "depth": 9, "leaf": 3, "per_node": 2, "weighted": True},
        "boost": {"trees": 6, "depth": 3, "leaf": 3, "rate": 0.3, "subsample": 0.7},
    }
    for kind, own in kinds.items():
        member = gang.Member(3, (0, 2, 3), kind, **own)
        now, was = grove.grow(held, member, classes, None if kind == "extra" else edges), gang.grow(held, [member], classes, {3: edges})
        for trees, depth in ((None, None), (4, 3)) if kind != "boost" else ((None, None), (4, None)):
            have, want = (gang.probabilities(g, 0, x, trees, depth) for g in (now, was))
            assert np.allclose(have, want), (kind, trees)
    assert set(calls) == {"_counted", "_sorted"}


def test_rows_that_weigh_differently_within_a_class_take_the_passes():
    x, y = made(90, 2)
    held = gang.Held([(0, np.arange(90), y, 1.0 + np.arange(90) % 3, x)])
    member = gang.Member(0, (0, 1), "extra", 3, 4, weighted=True)
    have, want = (gang.probabilities(g, 0, x) for g in (grove.grow(held, member, 2, None), gang.grow(held, [member], 2)))
    assert grove.Rows.of(held.parts, 2, None) is None and np.allclose(have, want)


def test_neighbours_in_tasks_vote_as_those_of_jobs(spark, monkeypatch):
    """Ties and copies included; a fold too large for a task is searched by its own jobs."""
    x, y = made(80, 2, classes=3)
    x = np.round(x)  # many rows are equally far
    rows = [(f"s{i % 70}", int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "sample_id string, label int, a double, b double")
    recipe = Recipe(features=["a", "b"], classes=["l", "m", "n"], ratios=None, impute=False, select_k="all")
    points = {"KNN": (zoo.multiclass_models()["KNN"], {})}
    alone, fits = [], selection._alone
    monkeypatch.setattr(selection, "_alone", lambda *a: (alone.append(a[4]), fits(*a))[1])
    with selection.shared_folds(), selection._folds_for(recipe, df, 3, 1) as folded:
        in_tasks = selection._cv_scores(recipe, folded, points, True)
        assert not alone
        monkeypatch.setattr(together, "HELD_COMPARED", 0)
        by_jobs = selection._cv_scores(recipe, folded, points, True)
    assert sorted(alone) == [0, 1, 2, 3] and not in_tasks[2]
    assert in_tasks[0]["KNN"] == pytest.approx(by_jobs[0]["KNN"]) and in_tasks[1]["KNN"] == pytest.approx(by_jobs[1]["KNN"])


def test_machines_of_several_penalties_lift_their_rows_once(monkeypatch):
    x, y = made(60)
    spec = [together.Smooth(penalty=p, weighted=True, kernel=True, gamma=0.5, size=12) for p in (1.0, 0.1)]
    held = lambda: gang.Held([(0, np.arange(60), y, np.ones(60), x)])
    jobs = lambda points: together.net_jobs(points, lambda f, n: (0, 1), [0], 2, 42, lambda f, c: 1.0)
    alone = {}
    for i, one in enumerate(spec):
        [job] = jobs({i: one})
        alone |= dict(job.guesses(held(), x, 2))
    [both] = jobs(dict(enumerate(spec)))
    lifted, call = [], descent.Fourier.__call__
    monkeypatch.setattr(descent.Fourier, "__call__", lambda self, rows: (lifted.append(len(rows)), call(self, rows))[1])
    found = dict(both.guesses(held(), x, 2))
    assert len(both.nets) == 2 and all(np.array_equal(found[i], alone[i]) for i in alone)
    assert lifted[0] == 60 and len(lifted) < 1 + 2 * (2 + descent.PARTS)
