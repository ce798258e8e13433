"""Registered queries of the subpackage against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from cohortspark.llm import queries as llm
from tests.conftest import SMALL

TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(name, spark, duck):
    got = llm.queries()[name](spark, SMALL)
    cols = sorted(got.columns)
    answer = duck.execute(llm.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == cols
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in answer.fetchall()]
    have = [tuple(plain(r[c]) for c in cols) for r in got.collect()]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_one_query_for_each_operator():
    assert [sum(q.startswith(f"op{n}_") for q in llm.queries()) for n in range(1, 14)] == [1] * 13
