"""Names of the engine's queries, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from pulsewarden.plans.queries import SQL, Q


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
