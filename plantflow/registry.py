"""The queries of the network engine and their SQL."""

from __future__ import annotations

from .plans.oracle import ORACLE
from .plans.queries import QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
