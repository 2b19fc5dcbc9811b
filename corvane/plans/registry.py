"""All queries of the core library and their SQL."""

from __future__ import annotations

from corvane.plans import q_corpus, q_more, q_reports, q_rules, q_search, q_tables  # noqa: F401
from corvane.plans.queries import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
