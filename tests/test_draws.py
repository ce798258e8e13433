import math
import random

import pytest

from cohortspark import session
from cohortspark.operators import draws, upstream
from cohortspark.plans import catalogue, views
from tests.conftest import SMALL, rows


@pytest.mark.parametrize("total, part, n", [(12, 5, 4), (60, 1, 30), (40, 39, 7), (200, 90, 150), (9, 9, 3), (9, 0, 3)])
def test_inversion_follows_the_distribution_function(total, part, n):
    low, high = max(0, n - (total - part)), min(part, n)
    reached = 0.0
    for k in range(low, high + 1):
        share = math.comb(part, k) * math.comb(total - part, n - k) / math.comb(total, n)
        if share > 1e-9:
            assert draws.hypergeometric(total, part, n, reached + share / 2) == k
        reached += share
    assert draws.hypergeometric(total, part, n, 0.0) == low


def test_split_follows_the_law_of_single_draws():
    """Chi-square of the joint draws of three cells against the multivariate law."""
    counts, n, runs = [4, 3, 5], 5, 6000
    rng = random.Random(5)
    seen = {}
    for i in range(runs):
        keys = sorted(f"{rng.getrandbits(128):032x}" for _ in counts)
        got = tuple(draws.split(f"run{i}", keys, counts, n, 0))
        assert sum(got) == n and all(0 <= g <= c for g, c in zip(got, counts, strict=True))
        seen[got] = seen.get(got, 0) + 1
    chi, cells = 0.0, 0
    for a in range(5):
        for b in range(4):
            c = n - a - b
            if 0 <= c <= 5:
                want = runs * math.comb(4, a) * math.comb(3, b) * math.comb(5, c) / math.comb(12, n)
                chi += (seen.pop((a, b, c), 0) - want) ** 2 / want
                cells += 1
    assert not seen and chi < cells + 5 * math.sqrt(2 * cells)


def test_equal_keys_and_long_common_digits_are_split():
    keys = ["a" * 32, "a" * 32, "a" * 31 + "b"]
    got = draws.split("x", keys, [5, 5, 5], 7, 0)
    assert sum(got) == 7 and max(got) <= 5


def test_cells_with_very_many_reads_cost_one_row(spark):
    counts = spark.createDataFrame(
        [("a", "t1", 3_000_000_000), ("a", "t2", 1_000_000_000), ("a", "t3", 1)], "sample_id string, taxon string, reads bigint"
    )
    got = {r["taxon"]: r["reads"] for r in upstream.rarefy(counts, 100_000).collect()}
    assert sum(got.values()) == 100_000
    assert abs(got["t1"] - 75_000) < 6 * math.sqrt(100_000 * 0.75 * 0.25)


def test_missing_repeated_and_empty_cells(spark):
    table = [(None, "t", 4), (None, None, 4), ("a", "t", 2), ("a", "t", 3), ("a", "u", 0), ("a", "v", -1), ("a", "w", None), ("", "t", 1)]
    counts = spark.createDataFrame([(*r, 9) for r in table], "sample_id string, taxon string, reads bigint, _n int")
    assert rows(upstream.rarefy(counts, 5).where("sample_id = 'a'")) == [("a", "t", 5)]
    assert rows(upstream.rarefy(counts, 8)) == [(None, "t", 4), (None, None, 4)]
    assert upstream.rarefy(counts.limit(0), 5).count() == 0


def test_cuts_into_tasks_do_not_change_the_draw(spark, monkeypatch):
    rng = random.Random(2)
    table = [(s, f"t{i}", rng.randint(1, 9)) for s, n in (("deep", 900), ("flat", 30), (None, 40)) for i in range(n)]
    counts = spark.createDataFrame(table, "sample_id string, taxon string, reads bigint")
    plain = rows(upstream.rarefy(counts, 50))
    for name, value in (("CELLS_PER_TASK", 3), ("HOP_DIGITS", 1)):
        monkeypatch.setattr(draws, name, value)
    assert rows(upstream.rarefy(counts.repartition(5), 50)) == plain
    assert sum(r[2] for r in plain if r[0] == "deep") == 50


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "most"), [("relative_abundance", 1), ("rarefy", 1), ("shannon", 1), ("rarefied_shannon", 4), ("assemble_samples", 4)])
def test_count_tables_move_texts_and_no_tokens(spark, name, most):
    """Texts are dealt by sample, joins aside nothing else is."""
    plan = plan_of(catalogue.queries()[name](spark, SMALL))
    assert plan.count("Exchange hashpartitioning") <= most and "taxon#" not in "".join(
        line for line in plan.splitlines() if "Exchange" in line
    )


def test_a_large_sample_is_cut_into_few_parts(spark, monkeypatch):
    """One cell more than fit a task: 16 parts, not one for every cell."""
    calls = []
    plain = draws._split_groups

    def seen(nodes, by, keep, n=None):
        calls.append(nodes.groupBy(*by).count().count())
        return plain(nodes, by, keep, n)

    monkeypatch.setattr(draws, "CELLS_PER_TASK", 400)
    monkeypatch.setattr(draws, "_split_groups", seen)
    counts = spark.createDataFrame([("a", f"t{i}", 2) for i in range(401)], "sample_id string, taxon string, reads bigint")
    out = upstream.rarefy(counts, 50)
    assert sum(r["reads"] for r in out.collect()) == 50 and max(calls) <= 16


def test_hot_samples_get_the_same_counts_and_shares(spark, tmp_path, monkeypatch):
    texts = [(None, "a b a"), (1, "a  b c c"), (1, "a"), (None, "b"), (2, None), (3, ""), (4, "x " * 40)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = views.token_counts(spark, str(tmp_path))
    plain, shares = rows(counts), rows(upstream.relative_abundance(counts))
    assert (None, "a", 2) in plain and (1, "a", 2) in plain and len(plain) == 6
    monkeypatch.setattr(views, "HOT_TEXT_BYTES", 3)
    monkeypatch.setattr(session, "HOT_ROWS", 1)
    counts = views.token_counts(spark, str(tmp_path))
    assert rows(counts) == plain and rows(upstream.relative_abundance(counts)) == shares
