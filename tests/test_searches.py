"""The registered model searches ask for the published models, folds, repeats and grids; nothing is fitted here."""

from unittest.mock import MagicMock

import pytest

import __spark_entry__ as contract
from cohortspark.ml import selection, zoo
from cohortspark.operators import splits
from cohortspark.plans import catalogue


@pytest.fixture
def asked(monkeypatch):
    calls = []
    monkeypatch.setattr(catalogue, "samples", lambda *_: None)
    monkeypatch.setattr(catalogue, "vector_columns", lambda *_: (None, ["v"]))
    monkeypatch.setattr(
        selection, "screen_models",
        lambda recipe, df, models, folds=splits.FOLDS, repeats=splits.REPEATS: calls.append((recipe, set(models), folds, repeats)),
    )
    monkeypatch.setattr(
        selection, "grid_scores",
        lambda recipe, df, entry, select=None, folds=splits.FOLDS, repeats=splits.REPEATS: (
            calls.append((recipe, select, folds, repeats)) or (entry.points(select), [0.0] * len(entry.points(select)))
        ),
    )
    return calls


@pytest.mark.parametrize(("name", "models", "repeats"), [("leaderboard", zoo.binary_models, 5), ("leaderboard_multiclass", zoo.multiclass_models, 3)])
def test_leaderboards_rank_all_models(asked, name, models, repeats):
    contract.queries()[name](None, "")
    [(recipe, names, folds, n)] = asked
    assert (names, folds, n) == (set(models()), 5, repeats) and recipe.impute


def test_grid_search_covers_every_grid(asked):
    spark = MagicMock()
    contract.queries()["grid_search"](spark, "")
    tuned = {n: e for n, e in zoo.binary_models().items() if e.grid}
    assert [x[1:] for x in asked] == [(zoo.SELECT_GRID, 5, 5)] * len(tuned)
    rows = spark.createDataFrame.call_args[0][0]
    assert {r[0] for r in rows} == set(tuned) and len(rows) == sum(len(e.points(zoo.SELECT_GRID)) for e in tuned.values())
