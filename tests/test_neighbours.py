import numpy as np
import pytest

from cohortspark.operators import neighbours
from cohortspark.operators.neighbours import NeighbourIndex


def frames(spark, x, q):
    donors = spark.createDataFrame([(i, [float(v) for v in r], int(i % 2)) for i, r in enumerate(x)], "donor_id int, vec array<double>, label int")
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "query_id int, vec array<double>")
    return donors, queries


def brute(x, q, k, target=None):
    d = neighbours.distances(q, x)
    out = {}
    for i in range(len(q)):
        usable = [j for j in range(len(x)) if np.isfinite(d[i, j]) and (target is None or not np.isnan(x[j, target]))]
        out[i] = sorted(usable, key=lambda j: (d[i, j], j))[:k]
    return out


def holes(rng, x, share):
    x = x.copy()
    x[rng.random(x.shape) < share] = np.nan
    return x


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "target", "rank").collect():
        out.setdefault((r["query_id"], r["target"]), []).append(r["donor_id"])
    return out


# Small blocks and query slices make every path run: several cells, blocks, slices and both rounds.
@pytest.mark.parametrize("share", [0.0, 0.15])
def test_nearest_rows_equal_brute_force(spark, share):
    rng = np.random.default_rng(7)
    # A third of the donors are copies of one row.
    x = np.vstack([rng.normal(size=(200, 3)) + rng.choice([0, 8], size=(200, 1)), np.tile([[1.0, 1.0, 1.0]], (100, 1))])
    x, q = holes(rng, x, share), holes(rng, rng.normal(size=(60, 3)) * 4, share)
    donors, queries = frames(spark, x, q)
    index = NeighbourIndex(donors, 3, pivots=9, block_rows=20, query_rows=15)
    assert index.cells.blocks.sum() > neighbours.FEW_BLOCKS
    got = collected(index.join(queries, 5, target_missing=False, carry=["label"]))
    want = brute(x, q, 5)
    assert {k: v for (k, _), v in got.items()} == {k: v for k, v in want.items() if v}


def test_missing_cells_look_up_rows_that_have_them(spark):
    rng = np.random.default_rng(8)
    x, q = holes(rng, rng.normal(size=(150, 4)), 0.2), holes(rng, rng.normal(size=(40, 4)), 0.4)
    donors, queries = frames(spark, x, q)
    index = NeighbourIndex(donors, 4, pivots=5, block_rows=25)
    got = collected(index.join(queries, 5, target_missing=True))
    for t in range(4):
        want = brute(x, q, 5, t)
        for i in range(len(q)):
            if np.isnan(q[i, t]) and want[i]:
                assert got[i, t] == want[i]
            else:
                assert (i, t) not in got


def test_rare_patterns_share_a_cell(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_PATTERNS", 2)
    rng = np.random.default_rng(9)
    x, q = holes(rng, rng.normal(size=(120, 4)), 0.3), rng.normal(size=(20, 4))
    donors, queries = frames(spark, x, q)
    index = NeighbourIndex(donors, 4, pivots=4, block_rows=30)
    assert not index.cells.uniform.all()
    got = collected(index.join(queries, 3, target_missing=False))
    assert {k: v for (k, _), v in got.items()} == brute(x, q, 3)


def test_boxes_rule_blocks_out(spark):
    rng = np.random.default_rng(10)
    x = np.vstack([rng.normal(size=(50, 2)) + 100 * i for i in range(8)])
    donors, queries = frames(spark, x, x[:5])
    index = NeighbourIndex(donors, 2, pivots=8, block_rows=10)
    low, _ = index.cells.reach(x[:5])
    assert (low > 1000).any()
    got = collected(index.join(queries, 2, target_missing=False))
    assert {k: v for (k, _), v in got.items()} == brute(x, x[:5], 2)


def test_vote_tie_goes_to_the_smaller_class(spark):
    donors, queries = frames(spark, np.array([[0.0], [1.0]]), np.array([[0.5]]))
    row = neighbours.knn_vote(NeighbourIndex(donors, 1), queries, 2, 2).first()
    assert row["votes"] == [0.5, 0.5] and row["prediction"] == 0.0


def test_copies_beyond_k_do_not_matter(spark):
    x = np.vstack([np.tile([[0.0, np.nan]], (40, 1)), np.array([[1.0, 2.0], [3.0, 4.0]])])
    donors, queries = frames(spark, x, np.array([[0.0, 0.0], [3.0, 4.0]]))
    fewer = neighbours.limit_copies(donors, 3)
    assert fewer.count() == 5
    got = collected(NeighbourIndex(fewer, 2).join(queries, 3, target_missing=False))
    assert {k: v for (k, _), v in got.items()} == brute(x, np.array([[0.0, 0.0], [3.0, 4.0]]), 3)


def test_tiny_values_keep_their_order(spark):
    """A fixed number of decimals would make both donors equal and pick the wrong one."""
    donors = spark.createDataFrame([(1, [3e-5]), (2, [1e-5])], "donor_id bigint, vec array<double>")
    queries = spark.createDataFrame([(9, [1e-5])], "query_id bigint, vec array<double>")
    assert neighbours.NeighbourIndex(donors, 1).join(queries, 1, False).first()["donor_id"] == 2


def test_nearest_keeps_ties_in_order_and_nothing_beyond_the_bound():
    d = np.array([[3.0, 1.0, 1.0, np.inf, 2.0], [np.inf, 5.0, 4.0, 5.0, 5.0], [1.0, 2.0, 3.0, 4.0, 5.0]])
    row, column = neighbours.nearest(d, 3, np.array([np.inf, np.inf, 1.5]))
    assert list(zip(row.tolist(), column.tolist())) == [(0, 1), (0, 2), (0, 4), (1, 2), (1, 1), (1, 3), (2, 0)]


def test_distances_of_columns_that_one_side_lacks():
    rng = np.random.default_rng(3)
    q, x = holes(rng, rng.normal(size=(20, 5)), 0.1), holes(rng, rng.normal(size=(90, 5)), 0.1)
    q[:, 1] = np.nan
    d = neighbours.distances(q, x)
    with np.errstate(invalid="ignore"):
        gaps = (q[:, None, :] - x[None, :, :]) ** 2
    common = np.isfinite(gaps).sum(axis=2)
    plain = np.where(common, np.nansum(gaps, axis=2) * 5 / np.maximum(common, 1), np.inf)
    assert np.allclose(d, plain)


@pytest.mark.parametrize("pivots", [1, 6])
def test_neighbours_by_fold_equal_brute_force_outside_of_each(spark, pivots):
    rng = np.random.default_rng(11)
    x = holes(rng, rng.normal(size=(160, 2)) + rng.choice([0, 8], size=(160, 1)), 0.15)
    q = holes(rng, rng.normal(size=(25, 2)) * 4, 0.4)
    own = rng.integers(0, 3, size=(160, 2))
    rows = [(i, [float(v) for v in a], [int(f) for f in o]) for i, (a, o) in enumerate(zip(x, own, strict=True))]
    donors = spark.createDataFrame(rows, "donor_id int, vec array<double>, _folds array<int>")
    index = NeighbourIndex(donors, 2, pivots=pivots, block_rows=20 if pivots > 1 else 200)
    assert (index.cells.blocks.sum() > neighbours.FEW_BLOCKS) == (pivots > 1)
    got = collected(index.join(frames(spark, x, q)[1], 3, target_missing=True, folds=(3, 2)))
    sets = [own[:, r] != f for r in range(2) for f in range(3)] + [np.ones(160, dtype=bool)]
    want = {}
    for s, inside in enumerate(sets):
        places = np.flatnonzero(inside)
        for t in range(2):
            for i, near in brute(x[places], q, 3, t).items():
                if np.isnan(q[i, t]) and near:
                    want[i, s * 2 + t] = places[near].tolist()
    assert got == want and len(want) > 50


def test_queries_meet_few_blocks_and_only_those_that_can_fill_them(spark, monkeypatch):
    """Rows like the query lack what it lacks: its near block must be another's, or nothing bounds the distances."""
    rng = np.random.default_rng(11)
    x = rng.uniform(0, 100, size=(600, 3))
    x[::2, 2] = np.nan
    q = rng.uniform(0, 100, size=(80, 3))
    q[:, 2] = np.nan
    donors, queries = frames(spark, x, q)
    index = NeighbourIndex(donors, 3, pivots=30, block_rows=40)
    asked, compare = [], NeighbourIndex._compare

    def counted(self, routed, *args):
        asked.append(routed.count())
        return compare(self, routed, *args)

    monkeypatch.setattr(NeighbourIndex, "_compare", counted)
    got = collected(index.join(queries, 5, target_missing=True))
    want = brute(x, q, 5, 2)
    assert got == {(i, 2): v for i, v in want.items()}
    assert asked[0] == len(q)
    assert asked[1] < len(q) * index.cells.blocks.sum() / 5


def test_a_coordinate_that_no_donor_has_does_not_open_every_block(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.uniform(0, 100, size=(300, 4))
    x[:, 3] = np.nan
    q = rng.uniform(0, 100, size=(40, 4))
    q[:, 2:] = np.nan
    donors, queries = frames(spark, x, q)
    index = NeighbourIndex(donors, 4, pivots=30, block_rows=40)
    asked, compare = [], NeighbourIndex._compare

    def counted(self, routed, *args):
        asked.append(routed.count())
        return compare(self, routed, *args)

    monkeypatch.setattr(NeighbourIndex, "_compare", counted)
    got = collected(index.join(queries, 5, target_missing=True))
    assert got == {(i, 2): v for i, v in brute(x, q, 5, 2).items()}
    assert asked[1] < len(q) * index.cells.blocks.sum() / 2


def test_routing_is_dealt_by_its_work(spark, monkeypatch):
    rng = np.random.default_rng(13)
    donors, queries = frames(spark, rng.normal(size=(300, 2)), rng.normal(size=(90, 2)))
    index = NeighbourIndex(donors, 2, pivots=10, block_rows=40)
    monkeypatch.setattr(neighbours, "ROUTE_PAIRS", 100, raising=False)
    parts, compare = [], NeighbourIndex._compare

    def counted(self, routed, *args):
        parts.append(routed.rdd.getNumPartitions())
        return compare(self, routed, *args)

    monkeypatch.setattr(NeighbourIndex, "_compare", counted)
    got = collected(index.join(queries.repartition(1), 3, target_missing=False))
    assert len(got) == 90
    assert parts == [9, 9]
