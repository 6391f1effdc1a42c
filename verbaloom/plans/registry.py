"""Every query of the library by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe_queries, metric_queries, text_queries  # noqa: F401

FLAGSHIP = "bpe_balance_score"


def queries() -> dict:
    return dict(text_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(text_queries.SQL)
