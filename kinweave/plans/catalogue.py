"""All queries of record linkage."""

from __future__ import annotations

from . import model_queries, pair_queries, statistics_queries, text_queries  # noqa: F401
from .base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
