"""All core queries and their DuckDB statements."""

from __future__ import annotations

from tracewell.plans import api, clustering, detection, extensions, layering, loads, relational, runs  # noqa: F401
from tracewell.plans.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
