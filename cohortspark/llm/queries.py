"""All registered queries of this subpackage."""

from __future__ import annotations

from cohortspark.llm import (  # noqa: F401
    op01_chat,
    op02_topk,
    op03_html,
    op04_toxicity,
    op05_decontaminate,
    op06_licenses,
    op07_sharding,
    op08_mixing,
    op09_near_dup,
    op10_langid,
    op11_runs,
    op12_filter_audit,
    op13_bpe,
)
from cohortspark.llm.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
